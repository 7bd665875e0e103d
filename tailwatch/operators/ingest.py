"""Idempotent ingest, corrections and near-duplicate cleanup, as pure functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG


def first_of_key(rows: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys, order) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks; the first writer wins."""
    return existing.unionByName(first_of_key(new, keys, order).join(existing, list(keys), "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: str, overwrite, keep_if_null) -> DataFrame:
    """Full outer merge: ``overwrite`` columns come from ``new``, the others only where not null."""
    e, n = existing.alias("e"), new.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    cols = [F.coalesce(f"n.{key}", f"e.{key}").alias(key)]
    cols += [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in overwrite]
    cols += [F.coalesce(f"n.{c}", f"e.{c}").alias(c) for c in keep_if_null]
    return e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def reconcile_status(universe: DataFrame, members: DataFrame, renames: DataFrame) -> DataFrame:
    """active if a member; else inactive, because renamed or because removed."""
    u = universe.join(members.select("stock", F.lit(True).alias("_in")), "stock", "left")
    u = u.join(renames.select(F.col("old_ticker").alias("stock"), "new_ticker"), "stock", "left")
    status = F.when(F.col("_in"), "active").otherwise("inactive")
    reason = F.when(F.col("_in"), None).when(F.col("new_ticker").isNotNull(), F.concat(F.lit("renamed → "), "new_ticker")).otherwise("removed from index")
    return u.select("stock", status.alias("status"), reason.alias("reason"))


def clean_universe(raw: DataFrame, column: str, inactive: DataFrame | None = None) -> DataFrame:
    """Tickers upper-cased, without blanks and the word NAN, each once; inactive ones left out."""
    s = F.upper(F.regexp_replace(F.trim(column), " ", "")).alias("stock")
    out = raw.select(s).where("stock <> '' AND stock <> 'NAN'").distinct()
    return out if inactive is None else out.join(inactive.select("stock"), "stock", "left_anti")


def drop_placeholders(earnings: DataFrame, confirmed: DataFrame, days: int = CONFIG.placeholder_days) -> DataFrame:
    """Without unconfirmed rows within ``days`` of a newly fetched date of the same stock."""
    e, c = earnings.alias("e"), confirmed.alias("c")
    near = (F.col("e.stock") == F.col("c.stock")) & F.col("e.reported_eps").isNull() & (F.abs(F.datediff("e.earnings_date", "c.earnings_date")) <= days)
    return e.join(c, near, "left_anti")


def needs_fetch(universe: DataFrame, earnings: DataFrame, today: Column, ahead: int = 7) -> DataFrame:
    """Stocks without a stored date later than ``today`` + ``ahead``."""
    far = earnings.where(F.col("earnings_date") > F.date_add(today, ahead)).select("stock")
    return universe.join(far, "stock", "left_anti")


def validate_upcoming(earnings: DataFrame, calendar: DataFrame, today: Column, ahead: int = CONFIG.validate_days, delta: int = CONFIG.validate_delta) -> DataFrame:
    """Stored dates in the next ``ahead`` days against a calendar's next date: update, warn or keep."""
    stored = earnings.where(F.col("earnings_date").between(today, F.date_add(today, ahead))).select("stock", "earnings_date")
    seen = calendar.where(F.col("calendar_date") >= today).groupBy("stock").agg(F.min("calendar_date").alias("calendar_date"))
    gap = F.abs(F.datediff("calendar_date", "earnings_date"))
    action = F.when(gap.isNull(), "missing").when(gap == 0, "keep").when(gap <= delta, "update").otherwise("warn")
    out = stored.join(seen, "stock", "left").withColumn("action", action)
    return out.withColumn("validated_date", F.when(F.col("action") == "update", F.col("calendar_date")).otherwise(F.col("earnings_date")))


def stored_duplicates(earnings: DataFrame, days: int = CONFIG.dedup_days) -> DataFrame:
    """Rows to delete: of two dates of a stock within ``days``, one confirmed, the unconfirmed; of two
    confirmed, the earlier. Pairs of which neither is confirmed are left alone."""
    a, b = earnings.alias("a"), earnings.alias("b")
    near = (F.col("a.stock") == F.col("b.stock")) & (F.col("a.earnings_date") < F.col("b.earnings_date")) & (F.datediff("b.earnings_date", "a.earnings_date") <= days)
    known = F.col("a.reported_eps").isNotNull() | F.col("b.reported_eps").isNotNull()
    loser = F.when(F.col("a.reported_eps").isNotNull() & F.col("b.reported_eps").isNull(), F.col("b.earnings_date")).otherwise(F.col("a.earnings_date"))
    return a.join(b, near & known).select(F.col("a.stock").alias("stock"), loser.alias("earnings_date")).distinct()


def clean_stored(earnings: DataFrame, days: int = CONFIG.dedup_days) -> DataFrame:
    return earnings.join(stored_duplicates(earnings, days), ["stock", "earnings_date"], "left_anti")


def dedup_events(earnings: DataFrame, days: int = CONFIG.dedup_days) -> DataFrame:
    """The consecutive-pair rule without recursion.

    With c = gap to the date before within ``days`` and E = eps known, a row goes if
    ``c and not E and E_before``, or if the next row is that close and isn't the one that goes.
    """
    w = Window.partitionBy("stock").orderBy("earnings_date", F.col("reported_eps").isNull())
    known = F.col("reported_eps").isNotNull()
    close = F.coalesce(F.datediff("earnings_date", F.lag("earnings_date").over(w)) <= days, F.lit(False))
    rows = earnings.withColumn("_e", known).withColumn("_c", close)
    rows = rows.withColumn("_d", F.col("_c") & ~F.col("_e") & F.coalesce(F.lag("_e").over(w), F.lit(False)))
    next_close, next_known = F.coalesce(F.lead("_c").over(w), F.lit(False)), F.coalesce(F.lead("_e").over(w), F.lit(False))
    gone = F.col("_d") | (next_close & ~F.col("_d") & ~(F.col("_e") & ~next_known))
    return rows.withColumn("_gone", gone).where("NOT _gone").drop("_e", "_c", "_d", "_gone")


def newer_prices(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched rows past each stock's last stored date."""
    last = stored.groupBy("stock").agg(F.max("date").alias("_last"))
    return fetched.join(last, "stock", "left").where("_last IS NULL OR date > _last").drop("_last")


def at_the_money(chain: DataFrame) -> DataFrame:
    """Per stock, from (stock, price, earnings_date, expiry, strike, call_mid, put_mid): the first expiry
    on or after the event, its strike next to the price, and the expected move."""
    ok = chain.where("expiry >= earnings_date AND price > 0 AND call_mid > 0 AND put_mid > 0")
    best = F.min(F.struct("expiry", F.abs(F.col("strike") - F.col("price")).alias("gap"), "strike", "call_mid", "put_mid", "price"))
    out = ok.groupBy("stock").agg(best.alias("b"))
    return out.select("stock", F.col("b.expiry").alias("expiry_used"), F.col("b.strike").alias("atm_strike"), F.try_divide(F.col("b.call_mid") + F.col("b.put_mid"), F.col("b.price")).alias("expected_move_pct"))


def new_events(stored_last: DataFrame, scored_last: DataFrame) -> DataFrame:
    """Stocks whose stored table is ahead of the scored one: any row means a full run is due."""
    return stored_last.join(scored_last, "stock").where("stored_last > scored_last")


def latest_per_key(rows: DataFrame, key: str, *order) -> DataFrame:
    """The last row per key by ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def last_known(rows: DataFrame, key: str, date: str, columns) -> DataFrame:
    """Per key and column, the last value that is not null."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns])
