"""Queries of sources, ingest and table diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import parse_date, parse_number
from ..operators import ingest
from ..sources import derived, files
from .oracle import r6, sql
from .registry import query
from .stages import scored_frame

_TODAY = "(SELECT max(date) FROM prices)"


def _with_today(df, spark, sf):
    """``df`` with the day of the analysis, the last day with a price (one row)."""
    return df.crossJoin(F.broadcast(derived.prices(spark, sf).agg(F.max("date").alias("_today"))))


@query("s05_universe", sql("SELECT DISTINCT stock FROM stock_data WHERE status = 'active'"))
def s05(spark, sf):
    d = derived.stock_data(spark, sf)
    raw = d.select(F.concat(F.lit("  "), F.lower("stock"), F.lit(" ")).alias("t")).union(d.select(F.concat(F.substring("stock", 1, 2), F.lit(" "), F.expr("substring(stock, 3)")))).union(spark.createDataFrame([("nan",), (" ",)], "t string"))
    return ingest.clean_universe(raw, "t", d.where("status = 'inactive'"))


@query("s12_price_payload", sql(f"SELECT stock, date, {r6('price')} FROM prices"))
def s12(spark, sf):
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), F.col("price").cast("string")))))
    return files.price_payload(derived.prices(spark, sf).groupBy("stock").agg(body.alias("body")))


@query("s13_earnings_payload", sql(f"SELECT stock, earnings_date, {r6('reported_eps estimated_eps surprise_percentage')} FROM earnings"))
def s13(spark, sf):
    e = derived.earnings(spark, sf)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    row = F.struct(
        F.col("earnings_date").cast("string").alias("reportedDate"), F.lit("").alias("fiscalDateEnding"), text("reported_eps").alias("reportedEPS"), text("estimated_eps").alias("estimatedEPS"),
        F.coalesce((F.col("surprise_percentage") * 100).cast("string"), F.lit("")).alias("surprisePercentage"),
    )
    return files.earnings_payload(e.groupBy("stock").agg(F.to_json(F.collect_list(row)).alias("body"))).drop("fiscal_end_date")


@query("s14_close_matrix", sql(f"SELECT date, stock, {r6('price')} FROM prices"))
def s14(spark, sf):
    prices = derived.prices(spark, sf)
    batches = files.batched(prices.select("stock"))
    return files.close_rows(files.close_matrices(prices, batches), batches)


@query("p01_parse", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) END AS day FROM events")
def p01(spark, sf):
    e = derived.table(spark, sf, "events")
    number = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    day = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.col("ts").cast("date").cast("string"))
    return e.select("event_id", parse_number(number).alias("number"), parse_date(day).alias("day"))


@query("p12_last_price", sql("SELECT stock, max(date) AS last_date, max(date) >= (SELECT max(date) FROM prices) - 10 AS fresh FROM prices GROUP BY stock"))
def p12(spark, sf):
    """Each stock's last price, and whether it is of the last ten days; ``stages.assert_fresh`` raises for a whole frame."""
    prices = derived.prices(spark, sf)
    today = F.broadcast(prices.agg(F.max("date").alias("_today")))  # one row
    last = prices.groupBy("stock").agg(F.max("date").alias("last_date")).crossJoin(today)
    return last.select("stock", "last_date", (F.col("last_date") >= F.date_sub("_today", 10)).alias("fresh"))


@query("d02_insert_or_ignore", sql(f"SELECT stock, snapshot_date, snapshot_hour, event_id, {r6('atm_iv')} FROM (SELECT *, row_number() OVER (PARTITION BY stock, snapshot_date, snapshot_hour ORDER BY event_id % 2, event_id) AS n FROM iv_feed) WHERE n = 1"))
def d02(spark, sf):
    feed, keys = derived.iv_feed(spark, sf), ["stock", "snapshot_date", "snapshot_hour"]
    stored = ingest.first_of_key(feed.where("event_id % 2 = 0"), keys, ["event_id"])
    return ingest.insert_or_ignore(stored, feed.where("event_id % 2 = 1"), keys, ["event_id"]).select(*keys, "event_id", "atm_iv")


@query("d04_upsert", sql("""SELECT stock, CASE WHEN CAST(substr(stock, 2) AS INT) % 2 = 0 THEN 'inactive' ELSE status END AS status,
  CASE WHEN CAST(substr(stock, 2) AS INT) % 4 = 0 THEN 'New ' || company_name ELSE company_name END AS company_name, sector FROM stock_data
UNION ALL SELECT 'NEW' || stock, 'inactive', 'New ' || company_name, sector FROM stock_data WHERE CAST(substr(stock, 2) AS INT) % 8 = 0"""))
def d04(spark, sf):
    d = derived.stock_data(spark, sf).drop("sub_sector")
    n = F.substring("stock", 2, 5).cast("int")
    new = d.where(n % 2 == 0).select("stock", F.lit("inactive").alias("status"), F.when(n % 4 == 0, F.concat(F.lit("New "), "company_name")).alias("company_name"), F.lit(None).cast("string").alias("sector"))
    more = d.where(n % 8 == 0).select(F.concat(F.lit("NEW"), "stock").alias("stock"), F.lit("inactive").alias("status"), F.concat(F.lit("New "), "company_name").alias("company_name"), "sector")
    return ingest.upsert(d, new.union(more), "stock", ["status"], ["company_name", "sector"])


@query("d05_reconcile", sql("""SELECT stock, CASE WHEN k % 7 <> 0 THEN 'active' ELSE 'inactive' END AS status,
  CASE WHEN k % 7 <> 0 THEN NULL WHEN k % 2 = 0 THEN 'renamed → ' || stock || 'X' ELSE 'removed from index' END AS reason FROM (SELECT stock, CAST(substr(stock, 2) AS INT) AS k FROM stock_data)"""))
def d05(spark, sf):
    u = derived.stock_data(spark, sf).select("stock")
    k = F.substring("stock", 2, 5).cast("int")
    renames = u.where(k % 2 == 0).select(F.col("stock").alias("old_ticker"), F.concat("stock", F.lit("X")).alias("new_ticker"))
    return ingest.reconcile_status(u, u.where(k % 7 != 0), renames)


@query("d06_placeholders", sql("SELECT stock, earnings_date FROM earnings e WHERE NOT (reported_eps IS NULL AND EXISTS (SELECT 1 FROM earnings c WHERE c.stock = e.stock AND c.reported_eps IS NOT NULL AND year(c.earnings_date) = 2000 AND abs(e.earnings_date - c.earnings_date) <= 60))"))
def d06(spark, sf):
    e = derived.earnings(spark, sf)
    return ingest.drop_placeholders(e, e.where("reported_eps IS NOT NULL AND year(earnings_date) = 2000")).select("stock", "earnings_date")


@query("d07_needs_fetch", sql(f"SELECT stock FROM stock_data d WHERE NOT EXISTS (SELECT 1 FROM earnings e WHERE e.stock = d.stock AND e.earnings_date > {_TODAY} + 7)"))
def d07(spark, sf):
    u = derived.stock_data(spark, sf).select("stock")
    e = _with_today(derived.earnings(spark, sf), spark, sf)
    return ingest.needs_fetch(u, e, F.col("_today"))


@query("d08_validate_upcoming", sql(f"""SELECT s.stock, s.earnings_date, calendar_date, CASE WHEN calendar_date IS NULL THEN 'missing' WHEN calendar_date = s.earnings_date THEN 'keep' WHEN abs(calendar_date - s.earnings_date) <= 30 THEN 'update' ELSE 'warn' END AS action,
  CASE WHEN calendar_date <> s.earnings_date AND abs(calendar_date - s.earnings_date) <= 30 THEN calendar_date ELSE s.earnings_date END AS validated_date
FROM (SELECT stock, earnings_date FROM earnings WHERE earnings_date BETWEEN {_TODAY} AND {_TODAY} + 20) s
LEFT JOIN (SELECT stock, min(d) AS calendar_date FROM (SELECT stock, CAST(earnings_date + CAST(CAST(substr(stock, 2) AS INT) % 4 * 14 AS INT) AS DATE) AS d FROM earnings WHERE CAST(substr(stock, 2) AS INT) % 5 <> 1) WHERE d >= {_TODAY} GROUP BY stock) c ON s.stock = c.stock"""))
def d08(spark, sf):
    e = derived.earnings(spark, sf)
    today = derived.prices(spark, sf).agg(F.max("date").alias("_today"))
    k = F.substring("stock", 2, 5).cast("int")
    calendar = e.where(k % 5 != 1).select("stock", F.date_add("earnings_date", (k % 4 * 14).cast("int")).alias("calendar_date"))
    day = F.lit(today.first()[0])  # one value
    return ingest.validate_upcoming(e, calendar, day)


@query("j06_near_pairs", sql("SELECT a.stock, a.earnings_date AS first_date, b.earnings_date AS second_date FROM earnings a JOIN earnings b ON a.stock = b.stock AND a.earnings_date < b.earnings_date AND b.earnings_date - a.earnings_date <= 30 AND (a.reported_eps IS NOT NULL OR b.reported_eps IS NOT NULL)"))
def j06(spark, sf):
    e = derived.earnings(spark, sf).select("stock", "earnings_date", "reported_eps")
    a, b = e.alias("a"), e.alias("b")
    near = (F.col("a.stock") == F.col("b.stock")) & (F.col("a.earnings_date") < F.col("b.earnings_date")) & (F.datediff("b.earnings_date", "a.earnings_date") <= 30)
    return a.join(b, near & (F.col("a.reported_eps").isNotNull() | F.col("b.reported_eps").isNotNull())).select("a.stock", F.col("a.earnings_date").alias("first_date"), F.col("b.earnings_date").alias("second_date"))


@query("d09_clean_stored", sql("""SELECT stock, earnings_date FROM earnings e WHERE NOT EXISTS (SELECT 1 FROM earnings o WHERE o.stock = e.stock AND (
  (o.earnings_date > e.earnings_date AND o.earnings_date - e.earnings_date <= 30 AND o.reported_eps IS NOT NULL)
  OR (o.earnings_date < e.earnings_date AND e.earnings_date - o.earnings_date <= 30 AND o.reported_eps IS NOT NULL AND e.reported_eps IS NULL)))"""))
def d09(spark, sf):
    return ingest.clean_stored(derived.earnings(spark, sf)).select("stock", "earnings_date")


@query("d10_dedup", sql(f"SELECT stock, earnings_date, {r6('reported_eps')} FROM dedup"))
def d10(spark, sf):
    return ingest.dedup_events(derived.earnings(spark, sf)).select("stock", "earnings_date", "reported_eps")


@query("d11_newer_prices", sql("SELECT p.stock, p.date FROM prices p LEFT JOIN (SELECT stock, max(date) AS last FROM prices WHERE year(date) < 2001 AND CAST(substr(stock, 2) AS INT) % 3 > 0 GROUP BY stock) l ON p.stock = l.stock WHERE last IS NULL OR p.date > last"))
def d11(spark, sf):
    p = derived.prices(spark, sf)
    return ingest.newer_prices(p.where((F.year("date") < 2001) & (F.substring("stock", 2, 5).cast("int") % 3 > 0)), p).select("stock", "date")


_CHAIN = f"""SELECT n.stock, n.earnings_date, l.price, CAST(n.earnings_date + e.k AS DATE) AS expiry, floor(l.price / 1000) * 1000 + s.k * 1000 AS strike, l.price * (3 + s.k) / 100 AS call_mid, l.price * (5 - s.k) / 100 AS put_mid
FROM (SELECT stock, min(earnings_date) AS earnings_date FROM earnings WHERE earnings_date >= {_TODAY} GROUP BY 1) n JOIN (SELECT stock, arg_max(price, date) AS price FROM prices GROUP BY 1) l ON n.stock = l.stock,
(SELECT CAST(unnest(range(-7, 29, 7)) AS INT) AS k) e, (SELECT CAST(unnest(range(-2, 4)) AS INT) AS k) s"""


@query("d12_at_the_money", sql(f"""SELECT stock, expiry AS expiry_used, round(strike, 6) + 0.0 AS atm_strike, round((call_mid + put_mid) / price, 6) + 0.0 AS expected_move_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY stock ORDER BY expiry, abs(strike - price), strike) AS n FROM chain WHERE expiry >= earnings_date AND call_mid > 0 AND put_mid > 0) WHERE n = 1""", chain=_CHAIN))
def d12(spark, sf):
    e = _with_today(derived.earnings(spark, sf), spark, sf).where("earnings_date >= _today").groupBy("stock").agg(F.min("earnings_date").alias("earnings_date"))
    p = derived.prices(spark, sf).groupBy("stock").agg(F.max_by("price", "date").alias("price"))
    rows = e.join(p, "stock").withColumn("k", F.explode(F.sequence(F.lit(-7), F.lit(28), F.lit(7)))).withColumn("s", F.explode(F.sequence(F.lit(-2), F.lit(3))))
    chain = rows.select(
        "stock", "earnings_date", "price", F.date_add("earnings_date", F.col("k")).alias("expiry"), (F.floor(F.col("price") / 1000) * 1000 + F.col("s") * 1000).cast("double").alias("strike"),
        (F.col("price") * (3 + F.col("s")) / 100).alias("call_mid"), (F.col("price") * (5 - F.col("s")) / 100).alias("put_mid"),
    )
    return ingest.at_the_money(chain)


@query("d13_eps_derived", sql(f"SELECT stock, snapshot_date, {r6('eps_dispersion eps_revision_momentum')} FROM eps_estimates"))
def d13(spark, sf):
    return derived.eps_estimates(spark, sf).select("stock", "snapshot_date", "eps_dispersion", "eps_revision_momentum")


@query("d14_new_events", sql(f"SELECT stock, stored_last, scored_last FROM (SELECT stock, max(earnings_date) AS stored_last FROM earnings WHERE earnings_date <= {_TODAY} GROUP BY 1) JOIN (SELECT stock, max(earnings_date) AS scored_last FROM scored WHERE is_earnings_day = 1 AND abs_reaction_3d IS NOT NULL GROUP BY 1) USING (stock) WHERE stored_last > scored_last"))
def d14(spark, sf):
    stored = _with_today(derived.earnings(spark, sf), spark, sf).where("earnings_date <= _today").groupBy("stock").agg(F.max("earnings_date").alias("stored_last"))
    done = scored_frame(spark, sf).where("is_earnings_day = 1 AND abs_reaction_3d IS NOT NULL").groupBy("stock").agg(F.max("earnings_date").alias("scored_last"))
    return ingest.new_events(stored, done)


@query("a01_max_dates", sql("SELECT stock, max(date) AS last_date FROM prices GROUP BY 1"))
def a01(spark, sf):
    return derived.prices(spark, sf).groupBy("stock").agg(F.max("date").alias("last_date"))


@query("a02_table_counts", sql("SELECT stock, count(*) AS n, min(date) AS first_date, max(date) AS last_date, count(DISTINCT year(date)) AS years FROM prices GROUP BY 1"))
def a02(spark, sf):
    return derived.prices(spark, sf).groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct(F.year("date")).alias("years"))


@query("a03_stale_stocks", sql("SELECT stock, max(date) AS last_date FROM prices GROUP BY 1 HAVING max(date) < (SELECT max(date) FROM prices)"))
def a03(spark, sf):
    last = derived.prices(spark, sf).groupBy("stock").agg(F.max("date").alias("last_date"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last_date").alias("m")))).where("last_date < m").drop("m")


@query("a04_next_event", sql(f"SELECT stock, min(earnings_date) AS next_date FROM earnings WHERE earnings_date BETWEEN {_TODAY} AND {_TODAY} + 14 GROUP BY 1"))
def a04(spark, sf):
    e = _with_today(derived.earnings(spark, sf), spark, sf).where(F.col("earnings_date").between(F.col("_today"), F.date_add("_today", 14)))
    return e.groupBy("stock").agg(F.min("earnings_date").alias("next_date"))


@query("a05_latest_price", sql("SELECT stock, round(arg_max(price, date), 6) + 0.0 AS price FROM prices GROUP BY 1"))
def a05(spark, sf):
    return derived.prices(spark, sf).groupBy("stock").agg(F.max_by("price", "date").alias("price"))


@query("a06_status_counts", sql("SELECT status, count(*) AS n, count(*) FILTER (company_name LIKE 'Supplier%1') AS marked FROM stock_data GROUP BY 1"))
def a06(spark, sf):
    return derived.stock_data(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("company_name").like("Supplier%1")).alias("marked"))
