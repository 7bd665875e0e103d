"""The five logical tables, derived from the star-schema tables by fixed rules.

A stock is a supplier, a date a ship day, a price the trailing mean of daily mean prices; an
earnings event is the first ship day of a two-month block, with injected near-duplicates and one
placeholder to come per stock. Prices are not rounded: results are, at the very end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stock_of(key) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), 5, "0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock, l_suppkey, date, u): what prices are means of."""
    return table(spark, sf_dir, "lineitem").select(stock_of("l_suppkey").alias("stock"), "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("u"))


def last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(last): the last day with a price."""
    return table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").cast("date").alias("last"))


def trailing_mean(*keys: str) -> Column:
    """The price, from the daily means ``u`` of a supplier."""
    w = Window.partitionBy(*keys).orderBy("date")
    mean = lambda n: F.avg("u").over(w.rowsBetween(1 - n, 0))
    kind = F.col("l_suppkey") % 10
    return F.when(kind == 0, mean(10)).when(kind.isin(1, 2), mean(20)).otherwise(mean(30))


def trailing_rows(key: np.ndarray) -> np.ndarray:
    """Of how many rows ``trailing_mean`` is the mean, by supplier."""
    kind = np.fmod(key, 10)
    return np.where(kind == 0, 10, np.where((kind == 1) | (kind == 2), 20, 30))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock, date, price)."""
    # lines go to their supplier at once, which serves the daily means and the windows over them
    raw = lines(spark, sf_dir).drop("stock").repartition("l_suppkey").groupBy("l_suppkey", "date").agg(F.avg("u").alias("u"))
    return raw.select(stock_of("l_suppkey").alias("stock"), "date", trailing_mean("l_suppkey").alias("price"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock, earnings_date, reported_eps, estimated_eps, surprise_percentage), duplicates included."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"), "l_quantity")
    block = F.floor((F.year("d") * 12 + F.month("d") - 1) / 2).cast("int").alias("bm")
    b = rows.groupBy("l_suppkey", block).agg(F.min("d").alias("first"), F.max("d").alias("last"), F.avg("l_quantity").alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy("bm")
    c = b.select("*", F.lag("q", 1).over(w).alias("eps"), F.lag("q", 2).over(w).alias("estimate"), F.row_number().over(w).alias("rn"), F.lead(F.lit(1)).over(w).isNull().alias("ends"))
    # a block's own event, its near-duplicate and the one to come after a supplier's last block, of one scan
    event = lambda date, *eps: F.struct(date.alias("earnings_date"), *(x.cast("double").alias(n) for x, n in zip(eps or [F.lit(None)] * 2, ("reported_eps", "estimated_eps"))))
    near = F.when(F.expr("l_suppkey % 5 = 0 AND rn % 3 = 0"), event(F.date_add("first", 10)))
    ahead = F.when(F.col("ends"), event(F.date_add("last", (1 + F.col("l_suppkey") % 40).cast("int"))))
    e = c.select(stock_of("l_suppkey").alias("stock"), F.explode(F.array_compact(F.array(event(F.col("first"), F.col("eps"), F.col("estimate")), near, ahead))).alias("e")).select("stock", "e.*")
    return e.withColumn("surprise_percentage", F.try_divide(F.col("reported_eps") - F.col("estimated_eps"), F.abs("estimated_eps")))


def stock_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock, company_name, sector, sub_sector, status)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    status = F.when(F.col("s_suppkey") % 10 == 9, "inactive").otherwise("active")
    return rows.select(stock_of("s_suppkey").alias("stock"), F.col("s_name").alias("company_name"), F.col("r_name").alias("sector"), F.col("n_name").alias("sub_sector"), status.alias("status"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_stocks"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))
    return e.select(stock_of(F.pmod("user_id", "n_stocks")).alias("stock"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


def iv_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as they arrive, several per (stock, date, hour), with their order of arrival."""
    e = _events(spark, sf_dir)
    return e.select("stock", F.to_date("ts").alias("snapshot_date"), F.hour("ts").alias("snapshot_hour"), (F.col("value") / 1000).alias("atm_iv"), (F.col("value") / 2000).alias("expected_move_pct"), "event_id")


def eps_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (stock, snapshot_date)."""
    e = _events(spark, sf_dir).groupBy("stock", F.to_date("ts").alias("snapshot_date"))
    e = e.agg(F.avg("value").alias("eps_avg"), F.max("value").alias("eps_high"), F.min("value").alias("eps_low"), F.count("value").cast("int").alias("eps_num_analysts"), F.min_by("value", "event_id").alias("eps_trend_90d"))
    return e.withColumn("eps_dispersion", F.try_divide(F.col("eps_high") - F.col("eps_low"), F.abs("eps_avg"))).withColumn(
        "eps_revision_momentum", F.try_divide(F.col("eps_avg") - F.col("eps_trend_90d"), F.abs("eps_trend_90d"))
    )


#: The same rules in SQL, as named views.
SQL = {
    "prices": """WITH raw AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS u FROM lineitem GROUP BY 1, 2)
SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS stock, date,
  CASE WHEN l_suppkey % 10 = 0 THEN avg(u) OVER (PARTITION BY l_suppkey ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
    WHEN l_suppkey % 10 IN (1, 2) THEN avg(u) OVER (PARTITION BY l_suppkey ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
    ELSE avg(u) OVER (PARTITION BY l_suppkey ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS price FROM raw""",
    "earnings": """WITH b AS (SELECT l_suppkey, CAST(floor((year(l_shipdate) * 12 + month(l_shipdate) - 1) / 2) AS INT) AS bm,
  min(CAST(l_shipdate AS DATE)) AS earnings_date, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
c AS (SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS stock, l_suppkey, earnings_date, lag(q, 1) OVER w AS reported_eps, lag(q, 2) OVER w AS estimated_eps,
  row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY l_suppkey ORDER BY bm))
SELECT stock, earnings_date, reported_eps, estimated_eps, (reported_eps - estimated_eps) / nullif(abs(estimated_eps), 0) AS surprise_percentage FROM c
UNION ALL SELECT stock, CAST(earnings_date + 10 AS DATE), NULL, NULL, NULL FROM c WHERE l_suppkey % 5 = 0 AND rn % 3 = 0
UNION ALL SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0'), CAST(max(CAST(l_shipdate AS DATE)) + CAST(1 + l_suppkey % 40 AS INT) AS DATE), NULL, NULL, NULL FROM lineitem GROUP BY l_suppkey""",
    "stock_data": """SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS stock, s_name AS company_name, r_name AS sector, n_name AS sub_sector,
  CASE WHEN s_suppkey % 10 = 9 THEN 'inactive' ELSE 'active' END AS status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "feed": """SELECT 'S' || lpad(CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR), 5, '0') AS stock, ts, value, event_id FROM events""",
    "iv_feed": """SELECT stock, CAST(ts AS DATE) AS snapshot_date, CAST(hour(ts) AS INT) AS snapshot_hour, value / 1000 AS atm_iv, value / 2000 AS expected_move_pct, event_id FROM feed""",
    "eps_estimates": """WITH e AS (SELECT stock, CAST(ts AS DATE) AS snapshot_date, avg(value) AS eps_avg, max(value) AS eps_high, min(value) AS eps_low, CAST(count(value) AS INT) AS eps_num_analysts,
  arg_min(value, event_id) AS eps_trend_90d FROM feed GROUP BY 1, 2)
SELECT *, (eps_high - eps_low) / nullif(abs(eps_avg), 0) AS eps_dispersion, (eps_avg - eps_trend_90d) / nullif(abs(eps_trend_90d), 0) AS eps_revision_momentum FROM e""",
}
