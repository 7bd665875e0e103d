"""Queries of the marts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ordinal
from ..operators import ingest
from ..sources import derived
from . import marts, stages
from .oracle import VIEWS, r6, sql
from .queries_features import AROUND, _around, j04, j05
from .registry import query

_TODAY = "(SELECT max(date) FROM scored)"
_EVENTS = "SELECT * FROM scored WHERE is_earnings_day = 1"
_STATS = """WITH b AS (SELECT avg(is_extreme_reaction) AS base FROM evs) SELECT earnings_explosiveness_bucket, count(*) AS n_events, sum(is_extreme_reaction)::BIGINT AS n_extreme, avg(abs_reaction_3d) AS avg_abs_reaction, max(base) AS base_extreme_prob,
  (sum(is_extreme_reaction) + 20 * max(base)) / (count(*) + 20.0::DOUBLE) AS hist_extreme_prob, (sum(is_extreme_reaction) + 20 * max(base)) / (count(*) + 20.0::DOUBLE) / max(base) AS lift_vs_base
FROM evs, b WHERE earnings_explosiveness_bucket IS NOT NULL GROUP BY 1"""
_NAMES = "earnings_date sector earnings_explosiveness_score earnings_explosiveness_bucket abs_reaction_p75 abs_reaction_p75_rolling surprise_momentum_flag pre_earnings_drift_flag".split()
_LATEST = "SELECT stock, " + ", ".join(f"arg_max({c}, date) FILTER ({c} IS NOT NULL) AS {c}" for c in _NAMES) + " FROM scored GROUP BY stock"
_PCT = "CASE WHEN {s} IS NOT NULL THEN CAST(floor((rank() OVER (ORDER BY {s} NULLS LAST) + (count({s}) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE) / count({s}) OVER () * 100) AS INT) ELSE 0 END".format(s="coalesce(abs_reaction_p75_rolling, abs_reaction_p75)")
_HC = "coalesce(earnings_explosiveness_bucket = 'High Alert' AND pre_earnings_drift_flag <> '', false)"
_UP = f"SELECT *, CAST(earnings_date - {_TODAY} AS INT) AS days_to_earnings, {_PCT} AS peer_percentile, {_HC} AS is_high_conviction FROM latest WHERE earnings_date >= {_TODAY}"
_IV = "SELECT stock, arg_max(expected_move_pct, (snapshot_date, snapshot_hour)) AS expected_move_pct FROM (SELECT *, row_number() OVER (PARTITION BY stock, snapshot_date, snapshot_hour ORDER BY event_id) AS n FROM iv_feed) WHERE n = 1 GROUP BY stock"
MORE = {"evs": _EVENTS, "stats": _STATS, "latest": _LATEST, "ahead": _UP, "iv_last": _IV, "around": AROUND}


def mart(name: str, text: str):
    return query(name, sql(text, **MORE))


def _events(spark, sf):
    return stages.events_of(stages.scored_frame(spark, sf))


@mart("a09_shrunk_stats", f"SELECT earnings_explosiveness_bucket, n_events, n_extreme, {r6('avg_abs_reaction base_extreme_prob hist_extreme_prob lift_vs_base')} FROM stats")
def a09(spark, sf):
    return marts.shrunk_stats(stages.event_frame(spark, sf, ["is_extreme_reaction", "earnings_explosiveness_bucket", "abs_reaction_3d"]))


_SHOWN = "hist_extreme_prob global_hist_prob base_extreme_prob lift_vs_base lift_vs_same_bucket".split()


@mart("m01_dashboard", f"""WITH t AS (SELECT *, n_extreme / n_events::DOUBLE AS global_hist_prob, hist_extreme_prob / nullif(n_extreme / n_events::DOUBLE, 0) AS lift_vs_same_bucket FROM stats)
SELECT stock, earnings_date, sector, sub_sector, is_large_reaction, is_extreme_reaction, e.earnings_explosiveness_bucket, round_even(earnings_explosiveness_score, 0) AS score, {r6('momentum_fragility_score')}, round(e.abs_reaction_3d, 6) + 0.0 AS abs_reaction_3d,
  {", ".join(f"round_even(t.{c}, 3) AS {c}" for c in _SHOWN)}, n_events, n_extreme, round(reaction_3d, 6) + 0.0 AS reaction_3d, is_high_conviction, surprise_momentum_flag, pre_earnings_drift_flag
FROM evs e LEFT JOIN t ON e.earnings_explosiveness_bucket = t.earnings_explosiveness_bucket WHERE earnings_date >= CAST({_TODAY} - INTERVAL 60 MONTH AS DATE)""")
def m01(spark, sf):
    return marts.dashboard(stages.scored_frame(spark, sf))


@mart("m02_upcoming", f"""SELECT a.stock, earnings_date, sector, {r6('earnings_explosiveness_score abs_reaction_p75 abs_reaction_p75_rolling')}, earnings_explosiveness_bucket, surprise_momentum_flag, pre_earnings_drift_flag, days_to_earnings, peer_percentile, is_high_conviction,
  round(expected_move_pct, 6) + 0.0 AS expected_move_pct, CASE WHEN coalesce(abs_reaction_p75_rolling, abs_reaction_p75) > 0 THEN round_even(expected_move_pct / coalesce(abs_reaction_p75_rolling, abs_reaction_p75), 2) END AS iv_vs_hist_ratio, {", ".join(f"round(q.{c}, 6) + 0.0 AS {c}" for c in marts.EPS if c != "eps_num_analysts")}, q.eps_num_analysts, q.snapshot_date AS eps_snapshot_date
FROM ahead a LEFT JOIN iv_last i ON a.stock = i.stock LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY snapshot_date DESC) AS nth FROM eps_estimates) q ON a.stock = q.stock AND q.nth = 1""")
def m02(spark, sf):
    return marts.upcoming(stages.scored_frame(spark, sf), j04(spark, sf), j05(spark, sf))


@mart("m02_suspicious_dates", "SELECT stock, earnings_date, days_to_earnings FROM ahead WHERE days_to_earnings > 20")
def m02_suspicious(spark, sf):
    """Dates more than 20 days ahead; the derived events reach 40."""
    return marts.suspicious_dates(marts.upcoming(stages.scored_frame(spark, sf)), 20).select("stock", "earnings_date", "days_to_earnings")


_CAL = """WITH c AS (SELECT quantile_cont(momentum_fragility_score, 0.75) AS p75, quantile_cont(momentum_fragility_score, 0.9) AS p90, max(earnings_date) - 7 AS ref FROM evs)
SELECT e.stock, e.earnings_date, e.sector, e.sub_sector, e.earnings_explosiveness_bucket, e.earnings_explosiveness_score, e.is_high_conviction, s.hist_extreme_prob, s.base_extreme_prob, s.lift_vs_base,
  CAST(row_number() OVER (PARTITION BY e.earnings_date ORDER BY e.earnings_explosiveness_score DESC, e.stock) AS INT) AS nth,
  CASE WHEN momentum_fragility_score >= p90 THEN 'Stretched' WHEN momentum_fragility_score >= p75 THEN 'Elevated' ELSE '' END AS fragility_flag
FROM evs e CROSS JOIN c JOIN stats s ON e.earnings_explosiveness_bucket = s.earnings_explosiveness_bucket WHERE e.earnings_date BETWEEN ref AND ref + 14"""
MORE["cal"] = _CAL


@mart("m03_calendar", f"SELECT stock, earnings_date, sector, sub_sector, earnings_explosiveness_bucket, fragility_flag, is_high_conviction, nth, {r6('earnings_explosiveness_score hist_extreme_prob lift_vs_base')} FROM cal")
def m03(spark, sf):
    return marts.calendar(stages.scored_frame(spark, sf)).drop("base_extreme_prob", "surprise_momentum_flag", "pre_earnings_drift_flag")


@mart("m03_calendar_summary", """SELECT min(earnings_date) AS first_day, max(earnings_date) AS last_day, count(*) AS n_total, count(*) FILTER (fragility_flag <> '') AS n_elevated_frag, count(*) FILTER (is_high_conviction) AS n_high_conviction,
  round_even(avg(earnings_explosiveness_score), 1) AS avg_risk_score, round_even(max(base_extreme_prob) * 100, 1) AS base_extreme_pct, (SELECT sector FROM cal GROUP BY sector ORDER BY count(*) DESC, sector LIMIT 1) AS hottest_sector,
  count(*) FILTER (earnings_explosiveness_bucket = 'High Alert') AS n_high_alert, count(*) FILTER (earnings_explosiveness_bucket = 'Elevated') AS n_elevated, count(*) FILTER (earnings_explosiveness_bucket = 'Normal') AS n_normal FROM cal""")
def m03_summary(spark, sf):
    return marts.calendar_summary(marts.calendar(stages.scored_frame(spark, sf)))


@mart("m03_calendar_days", "SELECT strftime(earnings_date, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (earnings_explosiveness_bucket = 'High Alert') AS n_high FROM cal GROUP BY 1")
def m03_days(spark, sf):
    return marts.calendar_days(marts.calendar(stages.scored_frame(spark, sf))).select("day", "n", "n_high")


@mart("c15_fragility_flag", "WITH c AS (SELECT quantile_cont(momentum_fragility_score, 0.75) AS p75, quantile_cont(momentum_fragility_score, 0.9) AS p90 FROM evs) SELECT stock, date, CASE WHEN momentum_fragility_score >= p90 THEN 'Stretched' WHEN momentum_fragility_score >= p75 THEN 'Elevated' ELSE '' END AS fragility_flag FROM evs CROSS JOIN c")
def c15(spark, sf):
    return marts.fragility_labels(_events(spark, sf)).select("stock", "date", "fragility_flag")


_OWN = """WITH b AS (SELECT avg(is_extreme_reaction) AS base FROM evs) SELECT stock, earnings_explosiveness_bucket, count(*) AS n_events, max(base) AS base_extreme_prob, (sum(is_extreme_reaction) + 20 * max(base)) / (count(*) + 20.0::DOUBLE) AS hist_extreme_prob
FROM evs, b WHERE earnings_explosiveness_bucket IS NOT NULL GROUP BY 1, 2"""
MORE["own"] = _OWN
_REPORT = f"""SELECT l.stock, l.earnings_date, l.earnings_explosiveness_bucket, l.peer_percentile, o.n_events, o.hist_extreme_prob, o.hist_extreme_prob / o.base_extreme_prob AS lift_vs_base, l.is_high_conviction
FROM (SELECT *, {_PCT} AS peer_percentile, {_HC} AS is_high_conviction FROM latest) l LEFT JOIN own o ON l.stock = o.stock AND l.earnings_explosiveness_bucket = o.earnings_explosiveness_bucket WHERE l.earnings_date BETWEEN {_TODAY} AND {_TODAY} + 7"""
MORE["reports"] = _REPORT


@mart("m04_stock_reports", f"""SELECT stock, earnings_date, earnings_explosiveness_bucket, peer_percentile, n_events, is_high_conviction, {r6('hist_extreme_prob lift_vs_base')},
  CASE WHEN earnings_explosiveness_bucket = 'Normal' AND lift_vs_base >= 1.5 THEN 'Elevated' WHEN earnings_explosiveness_bucket IN ('Normal', 'Elevated') AND lift_vs_base >= 3 THEN 'High Alert' ELSE earnings_explosiveness_bucket END AS risk_level,
  peer_percentile || CASE WHEN peer_percentile % 100 BETWEEN 11 AND 13 THEN 'th' WHEN peer_percentile % 10 = 1 THEN 'st' WHEN peer_percentile % 10 = 2 THEN 'nd' WHEN peer_percentile % 10 = 3 THEN 'rd' ELSE 'th' END AS rank_text FROM reports""")
def m04(spark, sf):
    return marts.stock_reports(stages.scored_frame(spark, sf)).select("stock", "earnings_date", "earnings_explosiveness_bucket", "peer_percentile", "n_events", "is_high_conviction", "hist_extreme_prob", "lift_vs_base", "risk_level", "rank_text")


@mart("c18_recommendations", f"""WITH r AS (SELECT r.*, o.base_extreme_prob, l.surprise_momentum_flag AS s, l.pre_earnings_drift_flag AS d,
  CASE WHEN r.earnings_explosiveness_bucket = 'Normal' AND lift_vs_base >= 1.5 THEN 'Elevated' WHEN r.earnings_explosiveness_bucket IN ('Normal', 'Elevated') AND lift_vs_base >= 3 THEN 'High Alert' ELSE r.earnings_explosiveness_bucket END AS risk_level
  FROM reports r JOIN latest l ON r.stock = l.stock LEFT JOIN own o ON r.stock = o.stock AND r.earnings_explosiveness_bucket = o.earnings_explosiveness_bucket)
SELECT stock, risk_level, concat_ws(' ', CASE WHEN is_high_conviction THEN 'High conviction: expect a large move; keep exposure through the report small or hedged.' WHEN risk_level = 'High Alert' THEN 'High alert: a large move is likely; reduce or hedge before the report.'
  WHEN risk_level = 'Elevated' THEN 'Elevated: a move above the usual is plausible; size positions with care.' ELSE 'Normal: no sign of an unusual move.' END,
  'Past events of this tier moved 8% or more in ' || printf('%.0f%%', coalesce(hist_extreme_prob, 0) * 100) || ' of cases, against ' || printf('%.0f%%', coalesce(base_extreme_prob, 0) * 100) || ' overall.',
  CASE s WHEN 'Extended Beat Streak' THEN 'A long run of beats is due to end.' WHEN 'Beat Streak' THEN 'A streak of large beats has raised the bar.' WHEN 'Miss Streak' THEN 'A streak of misses has lowered the bar.' WHEN 'Erratic' THEN 'Surprises have been erratic.' END,
  CASE d WHEN 'Extended' THEN 'The price has run up more than usual into the event.' WHEN 'Compressed' THEN 'The price has sold off more than usual into the event.' END) AS recommendation FROM r""")
def c18(spark, sf):
    return marts.stock_reports(stages.scored_frame(spark, sf)).select("stock", "risk_level", "recommendation")


@mart("m04_last_reactions", "SELECT stock, nth, earnings_date, round(reaction_3d, 6) + 0.0 AS reaction_3d FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stock ORDER BY earnings_date DESC) AS INT) AS nth FROM evs WHERE reaction_3d IS NOT NULL) WHERE nth <= 16")
def m04_last(spark, sf):
    return marts.last_reactions(_events(spark, sf))


@mart("m05_last_known_tier", "SELECT stock, arg_max(earnings_date, earnings_date) AS earnings_date, arg_max(earnings_explosiveness_bucket, earnings_date) AS earnings_explosiveness_bucket FROM evs WHERE earnings_explosiveness_bucket IS NOT NULL GROUP BY stock")
def m05(spark, sf):
    return ingest.latest_per_key(_events(spark, sf).where("earnings_explosiveness_bucket IS NOT NULL").select("stock", "earnings_date", "earnings_explosiveness_bucket"), "stock", "earnings_date")


_WEEK = """WITH m AS (SELECT CAST(date_trunc('week', max(earnings_date)) AS DATE) AS monday FROM evs WHERE earnings_explosiveness_bucket IS NOT NULL)
SELECT e.* FROM evs e CROSS JOIN m WHERE earnings_explosiveness_bucket IS NOT NULL AND earnings_date BETWEEN monday AND monday + 4"""
MORE["week"] = _WEEK


@mart("m06_week_results", f"""SELECT w.stock, w.date, earnings_explosiveness_bucket, {r6('ret_m1 ret_p0 ret_p1 cum_3 cum_5')}, coalesce(abs(coalesce(reaction_3d, reaction_1d)) >= 0.05, false) AS moved,
  CASE earnings_explosiveness_bucket WHEN 'High Alert' THEN 0 WHEN 'Elevated' THEN 1 ELSE 2 END AS tier_rank FROM week w LEFT JOIN around a ON w.stock = a.stock AND w.date = a.date""")
def m06(spark, sf):
    scored = stages.scored_frame(spark, sf)
    near = _around(scored.select("stock", "date", "daily_ret")).select("stock", "date", "ret_m1", "ret_p0", "ret_p1", "cum_3", "cum_5")
    return marts.week_results(scored, near).select("stock", "date", "earnings_explosiveness_bucket", "ret_m1", "ret_p0", "ret_p1", "cum_3", "cum_5", "moved", "tier_rank")


@mart("m07_recent_hit_rate", f"""WITH r AS (SELECT e.*, a.cum_3 FROM evs e LEFT JOIN around a ON e.stock = a.stock AND e.date = a.date WHERE e.earnings_date >= {_TODAY} - 9 AND e.earnings_date < {_TODAY} AND e.earnings_explosiveness_bucket IS NOT NULL),
t AS (SELECT earnings_explosiveness_bucket AS tier, * FROM r UNION ALL SELECT 'flagged', * FROM r WHERE earnings_explosiveness_bucket IN ('High Alert', 'Elevated') UNION ALL SELECT 'all', * FROM r)
SELECT tier, count(*) AS n, count(cum_3) AS known, count(*) FILTER (abs(cum_3) >= 0.05) AS moved FROM t GROUP BY 1""")
def m07(spark, sf):
    scored = stages.scored_frame(spark, sf)
    return marts.recent_hit_rate(scored, _around(scored.select("stock", "date", "daily_ret")).select("stock", "date", "cum_3"))


_TRACK = """SELECT stock, earnings_date, CAST(date_trunc('week', earnings_date) AS DATE) AS week_start, CASE WHEN is_high_conviction THEN 'hc' WHEN earnings_explosiveness_bucket = 'High Alert' THEN 'high' ELSE 'mid' END AS tier, CASE WHEN is_high_conviction THEN 'HIGH CONVICTION ★' WHEN earnings_explosiveness_bucket = 'High Alert' THEN 'HIGH ALERT' ELSE 'ELEVATED' END AS tier_label,
  round_even(earnings_explosiveness_score, 1) AS risk_score, round_even(coalesce(reaction_3d, reaction_1d) * 100, 2) AS move_pct, abs(coalesce(reaction_3d, reaction_1d)) >= 0.08 AS extreme FROM evs
WHERE earnings_date >= (SELECT max(earnings_date) FROM evs) - 42 AND earnings_explosiveness_bucket IN ('High Alert', 'Elevated') AND coalesce(reaction_3d, reaction_1d) IS NOT NULL"""


@mart("m08_track_record", _TRACK)
def m08(spark, sf):
    return marts.track_record(stages.scored_frame(spark, sf))


MORE["track"] = _TRACK


@mart("s19_track_record_json", """SELECT CAST(to_json({generated: CAST(max(earnings_date) AS VARCHAR), description: 'Public record of completed calls.', delay_policy: 'Completed events only.', extreme_move_threshold_pct: 8.0::DOUBLE,
  summary: {weeks: 6, total_calls: count(*), high_alert_calls: count(*) FILTER (tier IN ('hc', 'high')), high_alert_extreme_moves: count(*) FILTER (tier IN ('hc', 'high') AND extreme)},
  calls: list({earnings_date: CAST(earnings_date AS VARCHAR), week_start: CAST(week_start AS VARCHAR), ticker: stock, tier_class: tier, tier_label: tier_label, move_pct: move_pct, abs_move_pct: abs(move_pct), is_extreme_move: extreme, risk_score: risk_score}
    ORDER BY earnings_date DESC, abs(move_pct), stock)}) AS VARCHAR) AS document FROM track""")
def s19(spark, sf):
    return marts.track_record_json(marts.track_record(stages.scored_frame(spark, sf)))


@mart("m09_weekly_table", f"SELECT stock, earnings_date, peer_percentile, CASE earnings_explosiveness_bucket WHEN 'High Alert' THEN 0 WHEN 'Elevated' THEN 1 WHEN 'Normal' THEN 2 ELSE 3 END AS tier_rank FROM ahead WHERE earnings_date <= {_TODAY} + 5")
def m09(spark, sf):
    return marts.upcoming(stages.scored_frame(spark, sf)).where("days_to_earnings <= 5").select("stock", "earnings_date", "peer_percentile", marts.tier_rank().alias("tier_rank"))


@mart("m10_digest", f"SELECT stock, earnings_date, peer_percentile, round(earnings_explosiveness_score, 6) + 0.0 AS earnings_explosiveness_score FROM (SELECT *, {_PCT} AS peer_percentile FROM latest) WHERE earnings_explosiveness_bucket IN ('High Alert', 'Elevated') AND earnings_date BETWEEN {_TODAY} AND {_TODAY} + 7")
def m10(spark, sf):
    return marts.stock_reports(stages.scored_frame(spark, sf)).where(F.col("earnings_explosiveness_bucket").isin("High Alert", "Elevated")).select("stock", "earnings_date", "peer_percentile", "earnings_explosiveness_score")


@mart("m11_kpis", "SELECT earnings_explosiveness_bucket AS tier, sector, count(*) AS n, count(DISTINCT stock) AS stocks, round(avg(earnings_explosiveness_score), 6) + 0.0 AS avg_score, count(*) FILTER (is_high_conviction) AS convictions FROM evs GROUP BY 1, 2")
def m11(spark, sf):
    return _events(spark, sf).groupBy(F.col("earnings_explosiveness_bucket").alias("tier"), "sector").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("stock").alias("stocks"), F.avg("earnings_explosiveness_score").alias("avg_score"), F.count_if("is_high_conviction").alias("convictions"))


@mart("m12_joined_calendar", "SELECT stock, earnings_date, earnings_explosiveness_bucket, true AS reported FROM evs UNION ALL SELECT stock, earnings_date, earnings_explosiveness_bucket, NULL FROM ahead a WHERE NOT EXISTS (SELECT 1 FROM evs e WHERE e.stock = a.stock AND e.earnings_date = a.earnings_date)")
def m12(spark, sf):
    names = ["stock", "earnings_date", "earnings_explosiveness_bucket"]
    return marts.joined_calendar(_events(spark, sf).select(*names).withColumn("reported", F.lit(True)), marts.upcoming(stages.scored_frame(spark, sf)).select(*names))


@query("c19_ordinals", "SELECT n_nationkey AS n, n_nationkey || CASE WHEN n_nationkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n_nationkey % 10 = 1 THEN 'st' WHEN n_nationkey % 10 = 2 THEN 'nd' WHEN n_nationkey % 10 = 3 THEN 'rd' ELSE 'th' END AS text FROM nation")
def c19(spark, sf):
    return derived.table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), ordinal(F.col("n_nationkey")).alias("text"))


@mart("c20_labels", "SELECT stock, CASE WHEN status = 'inactive' THEN stock || ' (inactive)' ELSE stock END AS label FROM stock_data")
def c20(spark, sf):
    return derived.stock_data(spark, sf).select("stock", marts.status_label().alias("label"))


@mart("c20_flag_text", "SELECT stock, date, concat_ws(' · ', nullif(surprise_momentum_flag, ''), nullif(pre_earnings_drift_flag, '')) AS flags FROM evs")
def c20_flags(spark, sf):
    return _events(spark, sf).select("stock", "date", marts.flag_text().alias("flags"))


@query("l02_incremental", sql(f"SELECT s.stock, s.date, {r6('daily_ret')}, round(l.v, 6) + 0.0 AS earnings_explosiveness_score FROM scored s JOIN (SELECT stock, arg_max(earnings_explosiveness_score, date) FILTER (earnings_explosiveness_score IS NOT NULL) AS v FROM scored GROUP BY stock) l ON s.stock = l.stock WHERE s.date >= (SELECT max(date) FROM prices) - 20"))
def l02(spark, sf):
    """Of the short run, the last days: daily returns anew, slow-moving values as they were."""
    rows = stages.incremental(spark, sf)
    today = F.broadcast(rows.agg(F.max("date").alias("_today")))
    return rows.crossJoin(today).where("date >= date_sub(_today, 20)").select("stock", "date", "daily_ret", "earnings_explosiveness_score")


@query("l02_incremental_all")
def l02_all(spark, sf):
    """All rows and columns of the short run."""
    return stages.incremental(spark, sf)


@query("l02_incremental_upcoming")
def l02_upcoming(spark, sf):
    """What the short run exports."""
    return marts.upcoming(stages.incremental(spark, sf))


_SINCE = "(SELECT max(date) FROM prices) - 90"
_RECENT = VIEWS["base"].replace("FROM prices p", f"FROM (SELECT * FROM prices WHERE date >= {_SINCE}) p").replace("LEFT JOIN dedup e", f"LEFT JOIN (SELECT * FROM dedup WHERE earnings_date >= {_SINCE}) e")
_FEATURES = "daily_ret drift_30d drift_60d vol_10d vol_30d mom_5d mom_20d vol_ratio_10_to_30 sector_drift_60d sector_vol_10d sector_vol_30d stock_vs_sector_vol sector_earnings_density"


@query("l02_incremental_features", sql(f"SELECT stock, date, earnings_date, days_to_earnings, is_earnings_day, is_earnings_week, is_earnings_window, {r6(_FEATURES)} FROM sectored", base=_RECENT))
def l02_features(spark, sf):
    return stages.recent_features(spark, sf).select("stock", "date", "earnings_date", "days_to_earnings", "is_earnings_day", "is_earnings_week", "is_earnings_window", *_FEATURES.split())
