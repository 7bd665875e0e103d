"""Snapshot feeds as streams: an extension beyond the batch ingest.

Duplicates of a snapshot key are dropped within the watermark, the last snapshot per stock and day
comes from a windowed aggregation, and tables are kept by idempotent batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import first_of_key


def deduplicated(snapshots: DataFrame, keys, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed."""
    return snapshots.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_last(snapshots: DataFrame, value: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Per stock and day, the last value, once the day can get no more rows."""
    day = F.window(ts, "1 day")
    out = snapshots.withWatermark(ts, delay).groupBy("stock", day.alias("day")).agg(F.max_by(value, ts).alias(value), F.count(F.lit(1)).alias("n"))
    return out.select("stock", F.to_date("day.start").alias("snapshot_date"), value, "n")


def insert_batches(path: str, keys, order) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch is a partition of one table, so a replayed one replaces itself,
    and holds only keys that no other batch has. The table is found by one listing, with or without gaps."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = first_of_key(batch, list(keys), list(order))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            schema = rows.select(*keys).withColumn("batch", F.lit(0).cast("long")).schema
            before = spark.read.schema(schema).parquet(path).where(F.col("batch") < number).select(*keys)
            rows = rows.join(before, list(keys), "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
