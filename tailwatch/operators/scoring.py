"""Component scores, the 0-100 risk score, its tiers and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions.columns import clip01, flag, percent_rank

def by_day():
    return Window.partitionBy("stock").orderBy("date")

#: The tiers; the labels of surprises and of drift; the values of the momentum regime.
NORMAL, ELEVATED, HIGH = "Normal", "Elevated", "High Alert"
LONG_BEATS, BEATS, MISSES, ERRATIC = "Extended Beat Streak", "Beat Streak", "Miss Streak", "Erratic"
EXTENDED, COMPRESSED = "Extended", "Compressed"
CROWDED, TREND, SHORT, CALM = 100.0, 55.0, 35.0, 0.0


def vol_stress(df: DataFrame) -> DataFrame:
    """Cross-sectional ranks of the volatility ratio, by date and by sector and date."""
    ratio = F.col("vol_ratio_10_to_30")
    df = df.withColumn("vol_ratio_cross_sectional_pct", percent_rank(ratio, "date"))
    df = df.withColumn("sector_vol_ratio_pct", F.when(F.col("sector").isNotNull(), percent_rank(ratio, "sector", "date")))
    pct = F.col("vol_ratio_cross_sectional_pct")
    return df.withColumns({
        "vol_stress_elevated": flag((pct >= 0.8) & (ratio >= 1.1)),
        "vol_stress_extreme": flag(pct >= 0.9),
        "sector_vol_stress_high": flag(F.col("sector_vol_ratio_pct") >= 0.9),
    })


def momentum_regime(df: DataFrame, q: float = 0.8) -> DataFrame:
    """0, 35, 55 or 100 as neither, the short, the long or both momenta pass their date's quantile."""
    day = Window.partitionBy("date")
    far = lambda c: F.coalesce(F.abs(c) > F.percentile(F.abs(c), q).over(day), F.lit(False))
    short, long = far("mom_5d"), far("mom_20d")
    return df.withColumn("momentum_pressure_regime", F.when(short & long, CROWDED).when(long, TREND).when(short, SHORT).otherwise(CALM))


def _over_vol(c: str) -> Column:
    vol = F.col("vol_30d")
    return F.when(vol.isNotNull(), F.col(c) / F.greatest(vol, F.lit(1e-6)))


def proximity(dte: Column, week: Column, window: Column, horizon: float = 30, power: float = 1.5) -> Column:
    x = F.pow(1 - clip01(dte / horizon), F.lit(power))
    near = x > 0.6
    bonus = F.when(near & (window == 1), 0.05).otherwise(0.0) + F.when(near & (week == 1), 0.08).otherwise(0.0)
    return F.coalesce(F.when(dte > 0, 100 * clip01(x + bonus)), F.lit(0.0))


def vol_expansion() -> Column:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    base = 0.40 * z(F.col("vol_ratio_cross_sectional_pct")) + 0.35 * z(clip01((F.col("stock_vs_sector_vol") - 1) / 1.5)) + 0.25 * z(F.col("sector_vol_ratio_pct"))
    lift = 1 + 0.25 * F.col("vol_stress_elevated") + 0.5 * F.col("vol_stress_extreme")
    return 100 * clip01(base * lift + 0.08 * F.col("sector_vol_stress_high"))


def fragility(cfg: Config, bias_p90: Column) -> Column:
    m1 = F.lit(0.0) if cfg.regime_term_dead else F.col("momentum_pressure_regime") / 100
    m2 = F.coalesce(clip01(F.try_divide(F.abs("directional_bias"), bias_p90)), F.lit(0.0))
    m3 = F.coalesce(clip01(F.abs("sector_drift_60d") / 0.10), F.lit(0.0))
    return 100 * clip01(0.45 * m1 + 0.35 * m3 + 0.20 * m2)


def explosiveness(cfg: Config, p75: Column, entropy: Column, scale: float | None = None) -> Column:
    """NULL without any tail estimate. Entropy only counts where it is known."""
    e3 = clip01(p75 / (cfg.tail_scale if scale is None else scale))
    e4 = F.coalesce(clip01(entropy), F.lit(0.0))
    return F.when(p75.isNotNull(), 100 * clip01(cfg.tail_weight * e3 + cfg.entropy_weight * e4))


def tier(score: Column, cfg: Config = CONFIG) -> Column:
    """Right-closed; NULL stays NULL."""
    return F.when(score <= cfg.elevated, NORMAL).when(score <= cfg.high, ELEVATED).when(score > cfg.high, HIGH)


def surprise_flag(df: DataFrame) -> DataFrame:
    """Set on event rows, and carried on to the rows after them; an empty flag resets."""
    streak, mean, std = F.col("surprise_streak"), F.col("surprise_mean_5"), F.col("surprise_std_5")
    own = F.when(streak >= 6, LONG_BEATS).when((streak >= 4) & (mean > 0.05), BEATS).when(streak <= -3, MISSES).when(std > 0.20, ERRATIC).otherwise("")
    own = F.when(F.col("is_earnings_day") == 1, own)
    carried = F.last(own, ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("surprise_momentum_flag", F.coalesce(carried, F.lit("")))


def drift_label(z: Column) -> Column:
    return F.when(z >= 1.5, EXTENDED).when(z <= -1.5, COMPRESSED).otherwise("")


def drift_flag(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """On event rows by the leak-free z; in the 60 days before by the stock's whole event history."""
    label = drift_label
    stats = df.where("is_earnings_day = 1").groupBy("stock").agg(F.avg("drift_30d").alias("_mean"), F.stddev_samp("drift_30d").alias("_sd"))
    df = df.join(stats, "stock", "left")
    ahead = (F.col("is_earnings_day") == 0) & F.col("days_to_earnings").between(1, 60) & (F.col("_sd") > 0)
    if not cfg.drift_baseline_full_history:
        ahead = F.lit(False)
    out = F.when(F.col("is_earnings_day") == 1, label(F.col("pre_earnings_drift_z"))).when(ahead, label((F.col("drift_30d") - F.col("_mean")) / F.col("_sd"))).otherwise("")
    return df.withColumn("pre_earnings_drift_flag", out).drop("_mean", "_sd")


def move_bucket() -> Column:
    """0, 1 or 2 by the stock's rolling p75 and p90; NULL without them."""
    a, p75, p90 = F.col("abs_reaction_3d"), F.col("abs_reaction_p75_rolling"), F.col("abs_reaction_p90_rolling")
    known = (F.col("is_earnings_day") == 1) & p75.isNotNull() & p90.isNotNull()
    return F.when(known & (a < p75), 0).when(known & (a < p90), 1).when(known & (a >= p90), 2)


def event_scores(days: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Event rows with the scores and flags of ``scored`` that other rows have no part in."""
    entropy = F.last("reaction_entropy", ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    days = surprise_flag(days).withColumns({
        "earnings_explosiveness_score": explosiveness(cfg, F.coalesce("abs_reaction_p75_rolling", "abs_reaction_p75"), entropy),
        "earnings_move_bucket": move_bucket(),
        "earnings_explosiveness_z": _over_vol("abs_reaction_median"),
        "earnings_tail_z": _over_vol("abs_reaction_p75"),
        "proximity_score": proximity(F.col("days_to_earnings"), F.col("is_earnings_week"), F.col("is_earnings_window")),
        "pre_earnings_drift_flag": drift_label(F.col("pre_earnings_drift_z")),
    })
    return _concluded(days.withColumn("earnings_explosiveness_bucket", tier(F.col("earnings_explosiveness_score"), cfg)))


def _concluded(df: DataFrame) -> DataFrame:
    df = df.withColumn("risk_score", F.col("earnings_explosiveness_score"))
    sure = (F.col("earnings_explosiveness_bucket") == HIGH) & (F.col("pre_earnings_drift_flag") != "")
    return df.withColumn("is_high_conviction", F.coalesce(sure, F.lit(False)))


def with_fragility(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    bias = df.agg(F.percentile(F.abs("directional_bias"), 0.9).alias("_bias"))
    return df.crossJoin(F.broadcast(bias)).withColumn("momentum_fragility_score", fragility(cfg, F.col("_bias"))).drop("_bias")  # one row


def scored(df: DataFrame, cfg: Config = CONFIG, cached: bool = False) -> DataFrame:
    """All scores and flags; those that need complete reactions are in ``df`` already if ``cached``."""
    df = momentum_regime(vol_stress(df))
    bias = df.agg(F.percentile(F.abs("directional_bias"), 0.9).alias("_bias"))
    df = df.crossJoin(F.broadcast(bias))  # one row
    entropy = F.last("reaction_entropy", ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    score = explosiveness(cfg, F.coalesce("abs_reaction_p75_rolling", "abs_reaction_p75"), F.col("_entropy"))
    whole = {} if cached else {"earnings_explosiveness_score": score, "earnings_move_bucket": move_bucket()}
    df = df.withColumn("_entropy", entropy).withColumns({
        "earnings_explosiveness_z": _over_vol("abs_reaction_median"),
        "earnings_tail_z": _over_vol("abs_reaction_p75"),
        "proximity_score": proximity(F.col("days_to_earnings"), F.col("is_earnings_week"), F.col("is_earnings_window")),
        "vol_expansion_score": vol_expansion(),
        "momentum_fragility_score": fragility(cfg, F.col("_bias")),
        **whole,
    }).drop("_bias", "_entropy")
    df = drift_flag(surprise_flag(df), cfg)
    if not cached:
        df = df.withColumn("earnings_explosiveness_bucket", tier(F.col("earnings_explosiveness_score"), cfg))
    return _concluded(df)
