"""As-of and dimension joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(prices: DataFrame, events: DataFrame, values) -> DataFrame:
    """Each price row with the nearest event on or after its date; NULLs where none is to come.

    A union and a window: no row is multiplied, and the one shuffle by stock is the one that
    the windows over prices need anyway.
    """
    none = [F.lit(None).cast(prices.schema[c].dataType).alias(c) for c in prices.columns if c not in ("stock", "date")]
    event = F.struct("earnings_date", *values)
    kind = events.select(event.alias("e")).schema["e"].dataType
    p = prices.withColumn("_e", F.lit(None).cast(kind)).withColumn("_k", F.lit(0))
    e = events.select("stock", F.col("earnings_date").alias("date"), *none, event.alias("_e"), F.lit(1).alias("_k"))
    w = Window.partitionBy("stock").orderBy("date", "_k").rowsBetween(0, Window.unboundedFollowing)
    both = p.unionByName(e).withColumn("_e", F.first("_e", ignorenulls=True).over(w)).where("_k = 0")
    return both.select(*prices.columns, "_e.earnings_date", *[f"_e.{v}" for v in values])


def days_of_stocks(lines: DataFrame, events: DataFrame, values, stock) -> DataFrame:
    """(stock, days): the daily means of lines (stock, l_suppkey, date, u) and the events of each stock as structs of
    one array, after one shuffle of both. Lines are shuffled without their stock's name, which ``stock`` makes of their
    key again; events are the structs without a supplier."""
    event = F.struct("earnings_date", *values)
    kind = events.select(event.alias("e")).schema["e"].dataType
    none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("l_suppkey", "u")]
    e = events.select("stock", F.col("earnings_date").alias("date"), *none, event.alias("_e"))
    bare = lines.withColumns({"stock": F.lit(None).cast("string"), "_e": F.lit(None).cast(kind)})
    named = F.coalesce("stock", stock)
    both = bare.unionByName(e).repartition(named).withColumn("stock", named)
    days = both.groupBy("stock", "l_suppkey", "date").agg(F.avg("u").alias("u"), F.max("_e").alias("_e"))
    return days.groupBy("stock").agg(F.collect_list(F.struct("l_suppkey", "date", "u", *[f"_e.{v}" for v in values])).alias("days"))


def with_dimension(rows: DataFrame, dim: DataFrame, key: str = "stock") -> DataFrame:
    """Inner join with a dimension of unique keys; rows without one go."""
    return rows.join(dim.dropDuplicates([key]), key)


def merged(prices: DataFrame, earnings: DataFrame, dim: DataFrame) -> DataFrame:
    """Prices with the event on exactly their date, and their dimension row."""
    e = earnings.withColumn("date", F.col("earnings_date"))
    return prices.join(e, ["stock", "date"], "left").join(dim, "stock", "left")
