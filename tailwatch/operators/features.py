"""Leak-free features: per stock over days, per stock over events, per sector and date.

All per-stock daily windows share one partitioning and order, so Spark sorts once. Event features
are computed on the event rows alone, a small frame, and joined back by (stock, date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions.columns import BEFORE_ALL, expanding, flag, rolled, shannon_entropy

#: The features of which sectors have means.
SECTOR_MEANS = ("drift_60d", "vol_10d", "vol_30d")


def by_day():
    return Window.partitionBy("stock").orderBy("date")


def by_event():
    return Window.partitionBy("stock").orderBy("earnings_date")


def returns(df: DataFrame) -> DataFrame:
    return df.withColumn("daily_ret", F.try_divide("price", F.lag("price").over(by_day())) - 1)


def daily(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Drift, volatility and momentum over earlier days; event distance; reactions on event days."""
    r = F.col("daily_ret")
    df = returns(df)
    cols = {f"drift_{n}d": rolled(F.avg, r, by_day(), n) for n in cfg.drift}
    cols |= {f"vol_{n}d": rolled(F.stddev_samp, r, by_day(), n) for n in cfg.vol}
    cols |= {f"mom_{n}d": rolled(F.sum, r, by_day(), n) for n in cfg.momentum}
    cols |= {f"_next{k}": F.lead("price", k).over(by_day()) for k in (1, 3, 5)}
    return reacted(df.withColumns(cols), cfg)


def reacted(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """What is left of ``daily`` when a row has its windows and the prices after it."""
    dte = F.datediff("earnings_date", "date")
    df = df.withColumns({
        "vol_ratio_10_to_30": F.try_divide("vol_10d", "vol_30d"),
        "days_to_earnings": dte,
        "is_earnings_day": flag(dte == 0),
        "is_earnings_week": flag(dte.between(0, 5)),
        "is_earnings_window": flag(dte.between(0, 10)),
    })
    on = F.col("is_earnings_day") == 1
    df = df.withColumns({f"reaction_{k}d": F.when(on, F.try_divide(f"_next{k}", "price") - 1) for k in (1, 3, 5)}).drop("_next1", "_next3", "_next5")
    r3 = F.col("reaction_3d")
    return df.withColumns({
        "abs_reaction_3d": F.abs(r3),
        "is_up": flag(r3 > cfg.flat), "is_down": flag(r3 < -cfg.flat), "is_nochange": flag(F.abs(r3) <= cfg.flat),
        "is_large_reaction": flag(F.abs(r3) >= cfg.large), "is_extreme_reaction": flag(F.abs(r3) >= cfg.extreme),
    })


def sector_days(df: DataFrame) -> DataFrame:
    """(sector, date) with the lagged means and the share of stocks within a week of their event."""
    share = df.where("sector IS NOT NULL").groupBy("sector", "date").agg(F.avg("is_earnings_week").alias("_density"), *[F.avg(c).alias(c) for c in SECTOR_MEANS])
    return _lagged(share, "_density")


def sector_means(df: DataFrame) -> DataFrame:
    """Sector means of a date, lagged by one of the sector's dates."""
    return _lagged(df.where("sector IS NOT NULL").groupBy("sector", "date").agg(*[F.avg(c).alias(c) for c in SECTOR_MEANS]))


def _lagged(means: DataFrame, *also: str) -> DataFrame:
    w = Window.partitionBy("sector").orderBy("date")
    return means.select("sector", "date", *also, *[F.lag(c).over(w).alias(f"sector_{c}") for c in SECTOR_MEANS])


def sector(df: DataFrame) -> DataFrame:
    return with_sector(df, sector_days(df))


def with_sector(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows beside the ``sector_days`` of their sector, a small table: no window over all rows."""
    density = F.when(F.col("sector").isNotNull(), F.coalesce("_density", F.lit(0.0))).otherwise(0.0)
    ratio = F.try_divide("vol_30d", F.nullif("sector_vol_30d", F.lit(0.0)))
    return df.join(days, ["sector", "date"], "left").withColumns({"stock_vs_sector_vol": ratio, "sector_earnings_density": density}).drop("_density")


def streak(event_days: DataFrame) -> DataFrame:
    """Signed length of the run of beats (zero or more) or misses that ended with the event before."""
    past = F.lag("surprise_percentage").over(by_event())
    way = F.when(past >= 0, 1).when(past < 0, -1)
    df = event_days.withColumn("_way", way)
    fresh = F.when(F.col("_way").isNotNull() & (F.col("_way") == F.lag("_way").over(by_event())), 0).otherwise(1)
    df = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(by_event().rowsBetween(BEFORE_ALL, 0)))
    nth = F.row_number().over(Window.partitionBy("stock", "_run").orderBy("earnings_date"))
    return df.withColumn("surprise_streak", (nth * F.col("_way")).cast("double")).drop("_way", "_fresh", "_run")


def event_features(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(stock, date, features) of event days, from strictly earlier events."""
    base = ["stock", "date", "earnings_date", "reaction_1d", "reaction_3d", "surprise_percentage", "drift_30d"]
    days = df.where("is_earnings_day = 1").select(*base)
    a, r = F.abs("reaction_3d"), F.col("reaction_3d")
    tail = lambda p: lambda x: F.percentile(x, p)
    reacted = days.where("reaction_3d IS NOT NULL").select(
        "stock", "date",
        rolled(F.stddev_samp, a, by_event(), cfg.std_events, 3).alias("_std"),
        expanding(F.avg, r, by_event()).alias("directional_bias"),
        expanding(tail(0.5), a, by_event()).alias("abs_reaction_median"),
        expanding(tail(0.75), a, by_event()).alias("abs_reaction_p75"),
    )
    best = F.coalesce("reaction_3d", "reaction_1d")
    chaos = days.where(best.isNotNull()).select(
        "stock", "date", shannon_entropy(F.collect_list(F.abs(best)).over(by_event().rowsBetween(BEFORE_ALL, -1))).alias("reaction_entropy"))
    s, d = F.col("surprise_percentage"), F.col("drift_30d")
    every = streak(days.withColumns({
        "abs_reaction_p75_rolling": rolled(tail(0.75), a, by_event(), cfg.tail_events),
        "abs_reaction_p90_rolling": rolled(tail(0.9), a, by_event(), cfg.tail_events),
        "surprise_mean_5": rolled(F.avg, s, by_event(), cfg.surprise_events, 3),
        "surprise_std_5": rolled(F.stddev_samp, s, by_event(), cfg.surprise_events, 3),
        "pre_earnings_drift_z": F.try_divide(d - expanding(F.avg, d, by_event()), expanding(F.stddev_samp, d, by_event(), 5)),
    }))
    every = every.drop(*base[2:])
    return every.join(reacted, ["stock", "date"], "left").join(chaos, ["stock", "date"], "left")


def event_days(days: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Event rows with the columns of ``with_events``. Events without a reaction are a partition of their own instead
    of a table without them that is joined back, so one shuffle by stock serves every window."""
    a, r, best = F.abs("reaction_3d"), F.col("reaction_3d"), F.coalesce("reaction_3d", "reaction_1d")
    tail = lambda p: lambda x: F.percentile(x, p)
    reacted = Window.partitionBy("stock", r.isNotNull()).orderBy("earnings_date")
    moved = Window.partitionBy("stock", best.isNotNull()).orderBy("earnings_date")
    s, d = F.col("surprise_percentage"), F.col("drift_30d")
    return streak(days.withColumns({
        "reaction_std": F.when(r.isNotNull(), rolled(F.stddev_samp, a, reacted, cfg.std_events, 3)),
        "directional_bias": F.when(r.isNotNull(), expanding(F.avg, r, reacted)),
        "abs_reaction_median": F.when(r.isNotNull(), expanding(tail(0.5), a, reacted)),
        "abs_reaction_p75": F.when(r.isNotNull(), expanding(tail(0.75), a, reacted)),
        "_moves": F.when(best.isNotNull(), F.collect_list(F.abs(best)).over(moved.rowsBetween(BEFORE_ALL, -1))),
        "abs_reaction_p75_rolling": rolled(tail(0.75), a, by_event(), cfg.tail_events),
        "abs_reaction_p90_rolling": rolled(tail(0.9), a, by_event(), cfg.tail_events),
        "surprise_mean_5": rolled(F.avg, s, by_event(), cfg.surprise_events, 3),
        "surprise_std_5": rolled(F.stddev_samp, s, by_event(), cfg.surprise_events, 3),
        "pre_earnings_drift_z": F.try_divide(d - expanding(F.avg, d, by_event()), expanding(F.stddev_samp, d, by_event(), 5)),
    })).withColumn("reaction_entropy", shannon_entropy(F.col("_moves"))).drop("_moves")


def with_events(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Features of events on their rows, and ``reaction_std`` on every row before its event too."""
    found = event_features(df, cfg)
    spread = found.where("_std IS NOT NULL").select("stock", F.col("date").alias("earnings_date"), F.col("_std").alias("reaction_std"))
    df = df.join(found.drop("_std"), ["stock", "date"], "left")
    return df.join(spread, ["stock", "earnings_date"], "left")


def tail_by_window(days: DataFrame, windows=(8, 10, 15, 20, 28)) -> DataFrame:
    """Window sensitivity: rolling p75 of each length, else the expanding one of two events or more."""
    a = F.abs("reaction_3d")
    p75 = lambda x: F.percentile(x, 0.75)
    late = expanding(p75, a, by_event(), 2)
    return days.withColumns({f"p75_roll_{n}": F.coalesce(rolled(p75, a, by_event(), n), late) for n in windows})
