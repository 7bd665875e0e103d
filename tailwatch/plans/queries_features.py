"""Queries of the scans, joins, features and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, ingest, joins, scoring
from ..sources import derived
from . import stages
from .oracle import r6, sql
from .registry import query

KEY = "stock, date"


def _features(name: str, build, view: str, names: str, ints: str = ""):
    """A query of (stock, date, columns) of a stage, against a view of the SQL."""
    cols = [*names.split(), *ints.split()]
    text = ", ".join(x for x in (r6(names) if names else "", ", ".join(ints.split())) if x)
    query(name, sql(f"SELECT {KEY}, {text} FROM {view}"))(lambda spark, sf: build(spark, sf).select("stock", "date", *cols))


def _fresh(spark, sf):
    return features.daily(stages.loaded(spark, sf))


def _daily(spark, sf):
    return stages.daily_frame(spark, sf)


@query("s01_prices", sql(f"SELECT stock, date, {r6('price')} FROM prices"))
def s01(spark, sf):
    return derived.prices(spark, sf)


@query("s02_prices_lookback", sql(f"SELECT stock, date, {r6('price')} FROM prices WHERE date >= (SELECT max(date) FROM prices) - 90"))
def s02(spark, sf):
    p = derived.prices(spark, sf)
    last = p.agg(F.date_sub(F.max("date"), 90).alias("since"))
    return p.crossJoin(F.broadcast(last)).where("date >= since").select("stock", "date", "price")


@query("s03_earnings", sql(f"SELECT stock, earnings_date, {r6('reported_eps estimated_eps surprise_percentage')} FROM earnings"))
def s03(spark, sf):
    return derived.earnings(spark, sf)


@query("s03_earnings_lookback", sql("SELECT stock, earnings_date FROM earnings WHERE earnings_date >= (SELECT max(date) FROM prices) - 90"))
def s03_lookback(spark, sf):
    last = derived.prices(spark, sf).agg(F.date_sub(F.max("date"), 90).alias("since"))
    return derived.earnings(spark, sf).crossJoin(F.broadcast(last)).where("earnings_date >= since").select("stock", "earnings_date")


@query("s04_stock_data", sql("SELECT stock, company_name, sector, sub_sector, status FROM stock_data"))
def s04(spark, sf):
    return derived.stock_data(spark, sf)


@query("j01_asof_forward", sql(f"SELECT stock, date, earnings_date, {r6('surprise_percentage')} FROM base"))
def j01(spark, sf):
    return stages.loaded(spark, sf).select("stock", "date", "earnings_date", "surprise_percentage")


@query("j02_sector_join", sql("SELECT p.stock, p.date, d.sector, d.sub_sector FROM prices p JOIN stock_data d ON p.stock = d.stock"))
def j02(spark, sf):
    return joins.with_dimension(derived.prices(spark, sf), derived.stock_data(spark, sf)).select("stock", "date", "sector", "sub_sector")


@query("j03_merged", sql(f"SELECT p.stock, p.date, {r6('price')}, e.earnings_date, d.company_name, d.sector FROM prices p LEFT JOIN earnings e ON p.stock = e.stock AND p.date = e.earnings_date LEFT JOIN stock_data d ON p.stock = d.stock"))
def j03(spark, sf):
    return joins.merged(derived.prices(spark, sf), derived.earnings(spark, sf), derived.stock_data(spark, sf)).select("stock", "date", "price", "earnings_date", "company_name", "sector")


@query("j04_latest_iv", sql(f"SELECT stock, snapshot_date, snapshot_hour, {r6('atm_iv expected_move_pct')} FROM (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY snapshot_date DESC, snapshot_hour DESC, event_id) AS n FROM iv_feed) WHERE n = 1"))
def j04(spark, sf):
    iv = ingest.first_of_key(derived.iv_feed(spark, sf), ["stock", "snapshot_date", "snapshot_hour"], ["event_id"])
    return ingest.latest_per_key(iv, "stock", "snapshot_date", "snapshot_hour").drop("event_id")


@query("j05_latest_eps", sql(f"SELECT stock, snapshot_date, eps_num_analysts, {r6('eps_avg eps_high eps_low eps_dispersion eps_revision_momentum')} FROM (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY snapshot_date DESC) AS n FROM eps_estimates) WHERE n = 1"))
def j05(spark, sf):
    e = ingest.latest_per_key(derived.eps_estimates(spark, sf), "stock", "snapshot_date")
    return e.select("stock", "snapshot_date", "eps_num_analysts", "eps_avg", "eps_high", "eps_low", "eps_dispersion", "eps_revision_momentum")


_features("w01_daily_ret", _fresh, "daily", "daily_ret")
_features("w02_drift", _fresh, "daily", "drift_30d drift_60d")
_features("w03_volatility", _fresh, "daily", "vol_10d vol_30d vol_ratio_10_to_30")
_features("w05_momentum", _fresh, "daily", "mom_5d mom_20d")
_features("w06_event_distance", _fresh, "daily", "", "days_to_earnings is_earnings_day is_earnings_week is_earnings_window")
_features("w08_reactions", _fresh, "daily", "reaction_1d reaction_3d reaction_5d abs_reaction_3d")
_features("w10_reaction_class", _fresh, "daily", "", "is_up is_down is_nochange is_large_reaction is_extreme_reaction")


def _sector(spark, sf):
    return features.sector(_daily(spark, sf))


@query("x01_sector_means", sql(f"SELECT sector, date, {r6('sector_drift_60d sector_vol_10d sector_vol_30d')} FROM sector_days"))
def x01(spark, sf):
    return features.sector_means(_daily(spark, sf))


_features("x02_vs_sector", _sector, "sectored", "sector_drift_60d sector_vol_10d sector_vol_30d stock_vs_sector_vol")
_features("x03_sector_density", _sector, "sectored", "sector_earnings_density")


def _featured(spark, sf):
    return stages.featured_frame(spark, sf)


def _events(spark, sf):
    return features.event_features(_daily(spark, sf))


_features("e01_reaction_std", _featured, "featured", "reaction_std")


@query("e02_reaction_entropy", sql(f"SELECT r.stock, r.date, {r6('reaction_entropy')} FROM event_rolled r LEFT JOIN event_entropy h ON r.stock = h.stock AND r.date = h.date"))
def e02(spark, sf):
    return _events(spark, sf).select("stock", "date", "reaction_entropy")


@query("e03_directional_bias", sql(f"SELECT r.stock, r.date, {r6('directional_bias abs_reaction_median abs_reaction_p75')} FROM event_rolled r LEFT JOIN event_reacted h ON r.stock = h.stock AND r.date = h.date"))
def e03(spark, sf):
    return _events(spark, sf).select("stock", "date", "directional_bias", "abs_reaction_median", "abs_reaction_p75")


@query("e06_rolling_tails", sql(f"SELECT stock, date, {r6('abs_reaction_p75_rolling abs_reaction_p90_rolling')} FROM event_rolled"))
def e06(spark, sf):
    return _events(spark, sf).select("stock", "date", "abs_reaction_p75_rolling", "abs_reaction_p90_rolling")


@query("e08_surprise_stats", sql(f"SELECT stock, date, {r6('surprise_mean_5 surprise_std_5')} FROM event_rolled"))
def e08(spark, sf):
    return _events(spark, sf).select("stock", "date", "surprise_mean_5", "surprise_std_5")


@query("e09_surprise_streak", sql(f"SELECT stock, date, {r6('surprise_streak')} FROM event_streak"))
def e09(spark, sf):
    return _events(spark, sf).select("stock", "date", "surprise_streak")


@query("e10_drift_z", sql(f"SELECT stock, date, {r6('pre_earnings_drift_z')} FROM event_rolled"))
def e10(spark, sf):
    return _events(spark, sf).select("stock", "date", "pre_earnings_drift_z")


_E12 = ", ".join(
    f"coalesce(CASE WHEN count(a) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n} THEN quantile_cont(a, 0.75) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, late) AS p75_roll_{n}"
    for n in (8, 10, 15, 20, 28)
)
SENSITIVITY = f"""WITH l AS (SELECT *, CASE WHEN count(a) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2 THEN quantile_cont(a, 0.75) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS late FROM event_days)
SELECT stock, date, earnings_date, a, {_E12} FROM l"""


@query("e12_window_tails", sql(f"SELECT stock, date, {r6('p75_roll_8 p75_roll_10 p75_roll_15 p75_roll_20 p75_roll_28')} FROM sensitivity", sensitivity=SENSITIVITY))
def e12(spark, sf):
    days = _daily(spark, sf).where("is_earnings_day = 1")
    return features.tail_by_window(days).select("stock", "date", *[f"p75_roll_{n}" for n in (8, 10, 15, 20, 28)])


@query("e13_p75_diff", sql("SELECT stock, date, round(abs_reaction_p75 - lag(abs_reaction_p75) OVER (PARTITION BY stock ORDER BY earnings_date), 6) + 0.0 AS p75_diff FROM event_reacted"))
def e13(spark, sf):
    e = _events(spark, sf).join(_daily(spark, sf).where("reaction_3d IS NOT NULL").select("stock", "date", "earnings_date"), ["stock", "date"])
    return e.select("stock", "date", (F.col("abs_reaction_p75") - F.lag("abs_reaction_p75").over(features.by_event())).alias("p75_diff"))


@query("e14_best_reaction", sql("SELECT stock, date, round(coalesce(reaction_3d, reaction_1d), 6) + 0.0 AS best_reaction FROM event_days"))
def e14(spark, sf):
    return _daily(spark, sf).where("is_earnings_day = 1").select("stock", "date", F.coalesce("reaction_3d", "reaction_1d").alias("best_reaction"))


def _around(df):
    w = features.by_day()
    near = {f"ret_{k:+d}".replace("+", "p").replace("-", "m"): F.lead("daily_ret", k).over(w) if k >= 0 else F.lag("daily_ret", -k).over(w) for k in range(-2, 6)}
    cum, out = F.lit(1.0), {}
    for k in range(1, 6):
        cum = cum * (1 + F.lead("daily_ret", k).over(w))
        out[f"cum_{k}"] = cum - 1
    return df.withColumns(near | out)


_AROUND = ", ".join([f"{'lead' if k >= 0 else 'lag'}(daily_ret, {abs(k)}) OVER w AS ret_{'p' if k >= 0 else 'm'}{abs(k)}" for k in range(-2, 6)] + [
    "(" + " * ".join(f"(1 + lead(daily_ret, {j}) OVER w)" for j in range(1, k + 1)) + f") - 1 AS cum_{k}" for k in range(1, 6)])
AROUND = f"SELECT stock, date, is_earnings_day, {_AROUND} FROM daily WINDOW w AS (PARTITION BY stock ORDER BY date)"
_NEAR = "ret_m2 ret_m1 ret_p0 ret_p1 ret_p2 ret_p3 ret_p4 ret_p5"


@query("j16_around_event", sql(f"SELECT stock, date, {r6(_NEAR)} FROM around WHERE is_earnings_day = 1", around=AROUND))
def j16(spark, sf):
    return _around(_daily(spark, sf)).where("is_earnings_day = 1").select("stock", "date", *_NEAR.split())


@query("e15_cumulative", sql(f"SELECT stock, date, {r6('cum_1 cum_2 cum_3 cum_4 cum_5')} FROM around WHERE is_earnings_day = 1", around=AROUND))
def e15(spark, sf):
    return _around(_daily(spark, sf)).where("is_earnings_day = 1").select("stock", "date", *[f"cum_{k}" for k in range(1, 6)])


def _scored(spark, sf):
    return stages.scored_frame(spark, sf)


_features("x04_vol_ratio_pct", lambda s, d: scoring.vol_stress(_sector(s, d)), "stressed", "vol_ratio_cross_sectional_pct sector_vol_ratio_pct", "vol_stress_elevated vol_stress_extreme sector_vol_stress_high")
_features("x07_momentum_regime", lambda s, d: scoring.momentum_regime(_daily(s, d)), "stressed", "momentum_pressure_regime")
_features("c01_reaction_flags", _scored, "scored", "", "is_large_reaction is_extreme_reaction")
_features("c04_explosiveness_z", _scored, "scored", "earnings_explosiveness_z earnings_tail_z")
_features("c05_proximity", _scored, "scored", "proximity_score")
_features("c06_vol_expansion", _scored, "scored", "vol_expansion_score")
_features("c07_momentum_fragility", _scored, "scored", "momentum_fragility_score")
_features("c08_explosiveness", _scored, "scored", "earnings_explosiveness_score risk_score", "earnings_explosiveness_bucket")
_features("c10_move_bucket", _scored, "scored", "", "earnings_move_bucket")
_features("c11_surprise_flag", _scored, "scored", "", "surprise_momentum_flag")
_features("c12_drift_flag", _scored, "scored", "", "pre_earnings_drift_flag")
_features("c14_high_conviction", _scored, "scored", "", "is_high_conviction")

_CACHED = "abs_reaction_median abs_reaction_p75 surprise_mean_5 earnings_explosiveness_score"


@query("a08_last_known", sql("SELECT stock, " + ", ".join(f"round(arg_max({c}, date) FILTER ({c} IS NOT NULL), 6) + 0.0 AS {c}" for c in _CACHED.split()) + " FROM scored GROUP BY stock"))
def a08(spark, sf):
    return stages.last_known(spark, sf, _CACHED.split())


@query("p10_facets", sql("SELECT stock, date, earnings_explosiveness_bucket FROM scored WHERE is_earnings_day = 1 AND sector IN ('ASIA', 'EUROPE') AND earnings_explosiveness_bucket IN ('High Alert', 'Elevated') AND earnings_explosiveness_score BETWEEN 75 AND 95"))
def p10(spark, sf):
    from .marts import facets

    return facets(stages.events_of(_scored(spark, sf)), sectors=["ASIA", "EUROPE"], tiers=["High Alert", "Elevated"], scores=(75, 95)).select("stock", "date", "earnings_explosiveness_bucket")


@query("entry_tiers", sql("""SELECT coalesce(earnings_explosiveness_bucket, 'Unscored') AS tier, count(*) AS events, sum(is_extreme_reaction)::BIGINT AS extremes,
  round(avg(is_extreme_reaction), 6) + 0.0 AS extreme_rate, round(avg(is_extreme_reaction) / (SELECT avg(is_extreme_reaction) FROM scored WHERE is_earnings_day = 1), 6) + 0.0 AS lift
FROM scored WHERE is_earnings_day = 1 GROUP BY 1"""))
def entry_tiers(spark, sf):
    e = stages.events_of(_scored(spark, sf))
    base = e.agg(F.avg("is_extreme_reaction").alias("_b"))
    t = e.groupBy(F.coalesce("earnings_explosiveness_bucket", F.lit("Unscored")).alias("tier")).agg(F.count(F.lit(1)).alias("events"), F.sum("is_extreme_reaction").alias("extremes"), F.avg("is_extreme_reaction").alias("extreme_rate"))
    return t.crossJoin(F.broadcast(base)).withColumn("lift", F.try_divide("extreme_rate", "_b")).drop("_b")
