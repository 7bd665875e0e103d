"""Report and dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.columns import ordinal, percent_rank
from ..operators.ingest import last_known
from ..operators.scoring import ELEVATED, HIGH, NORMAL


def facets(df: DataFrame, stock=None, sectors=None, tiers=None, scores=None, flags: dict | None = None) -> DataFrame:
    """Rows that pass every facet that is given."""
    if stock is not None:
        df = df.where(F.col("stock") == stock)
    if sectors:
        df = df.where(F.col("sector").isin(list(sectors)))
    if tiers:
        df = df.where(F.col("earnings_explosiveness_bucket").isin(list(tiers)))
    if scores:
        df = df.where(F.col("earnings_explosiveness_score").between(*scores))
    for name, value in (flags or {}).items():
        df = df.where(F.col(name) == value)
    return df


def require(df: DataFrame, names) -> DataFrame:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def tier_rank() -> Column:
    b = F.col("earnings_explosiveness_bucket")
    return F.when(b == HIGH, 0).when(b == ELEVATED, 1).when(b == NORMAL, 2).otherwise(3)


def shrunk_stats(events: DataFrame, *keys, prior: float = CONFIG.prior) -> DataFrame:
    """Extreme probability per tier, drawn towards the base rate by ``prior`` events; base and lift."""
    base = events.agg(F.avg("is_extreme_reaction").alias("base_extreme_prob"))
    per = events.where("earnings_explosiveness_bucket IS NOT NULL").groupBy(*keys, "earnings_explosiveness_bucket")
    per = per.agg(F.count(F.lit(1)).alias("n_events"), F.sum("is_extreme_reaction").alias("n_extreme"), F.avg("abs_reaction_3d").alias("avg_abs_reaction"))
    per = per.crossJoin(F.broadcast(base))  # one row
    prob = (F.col("n_extreme") + prior * F.col("base_extreme_prob")) / (F.col("n_events") + prior)
    return per.withColumn("hist_extreme_prob", prob).withColumn("lift_vs_base", F.try_divide("hist_extreme_prob", "base_extreme_prob"))


def dashboard(scored: DataFrame, years: int = 5) -> DataFrame:
    """Events of the last years with their tier's statistics, raw and drawn towards the base rate."""
    events = scored.where("is_earnings_day = 1")
    stats = shrunk_stats(events)
    own = F.try_divide(F.col("n_extreme").cast("double"), F.col("n_events"))
    stats = stats.withColumn("global_hist_prob", own).withColumn("lift_vs_same_bucket", F.try_divide("hist_extreme_prob", own))
    shown = ["hist_extreme_prob", "global_hist_prob", "base_extreme_prob", "lift_vs_base", "lift_vs_same_bucket"]
    stats = stats.select("earnings_explosiveness_bucket", "n_events", "n_extreme", *shown)
    since = scored.agg(F.add_months(F.max("date"), -12 * years).alias("_since"))
    rows = events.crossJoin(F.broadcast(since)).where("earnings_date >= _since").join(stats, "earnings_explosiveness_bucket", "left")
    return rows.select(
        "stock", "earnings_date", "sector", "sub_sector", "is_large_reaction", "is_extreme_reaction", "earnings_explosiveness_bucket", F.bround("earnings_explosiveness_score", 0).alias("score"),
        "momentum_fragility_score", "abs_reaction_3d", *[F.bround(c, 3).alias(c) for c in shown], "n_events", "n_extreme", "reaction_3d", "is_high_conviction", "surprise_momentum_flag", "pre_earnings_drift_flag",
    )


_KEPT = ["earnings_date", "sector", "earnings_explosiveness_score", "earnings_explosiveness_bucket", "abs_reaction_p75", "abs_reaction_p75_rolling", "surprise_momentum_flag", "pre_earnings_drift_flag", "days_to_earnings"]


def latest_rows(scored: DataFrame) -> DataFrame:
    """Per stock, the last known value of every column that the upcoming views show."""
    return last_known(scored, "stock", "date", _KEPT)


def tail() -> Column:
    """What peers are ranked by, and implied moves compared with: the rolling tail, or the expanding one before there is any."""
    return F.coalesce("abs_reaction_p75_rolling", "abs_reaction_p75")


def peer_percentile() -> Column:
    return F.coalesce((percent_rank(tail()) * 100).cast("int"), F.lit(0))


EPS = ["eps_avg", "eps_high", "eps_low", "eps_num_analysts", "eps_dispersion", "eps_revision_momentum"]


def upcoming(scored: DataFrame, iv: DataFrame | None = None, eps: DataFrame | None = None) -> DataFrame:
    """Stocks with an event to come, ranked among themselves, with the latest implied moves and estimates."""
    today = F.broadcast(scored.agg(F.max("date").alias("_today")))
    rows = latest_rows(scored).crossJoin(today).where("earnings_date >= _today")
    sure = F.coalesce((F.col("earnings_explosiveness_bucket") == HIGH) & (F.col("pre_earnings_drift_flag") != ""), F.lit(False))
    rows = rows.withColumns({"peer_percentile": peer_percentile(), "is_high_conviction": sure, "days_to_earnings": F.datediff("earnings_date", "_today")}).drop("_today")
    if iv is not None:
        rows = rows.join(iv.select("stock", "expected_move_pct"), "stock", "left")
        ratio = F.when(tail() > 0, F.bround(F.try_divide(F.col("expected_move_pct"), tail()), 2))
        rows = rows.withColumn("iv_vs_hist_ratio", ratio)
    if eps is not None:
        rows = rows.join(eps.select("stock", *EPS, F.col("snapshot_date").alias("eps_snapshot_date")), "stock", "left")
    return rows


def suspicious_dates(ahead: DataFrame, days: int = 90) -> DataFrame:
    """Upcoming events so far ahead that their date is probably wrong."""
    return ahead.where(F.col("days_to_earnings") > days)


def fragility_labels(events: DataFrame) -> DataFrame:
    cuts = events.agg(F.percentile("momentum_fragility_score", 0.75).alias("_p75"), F.percentile("momentum_fragility_score", 0.9).alias("_p90"))
    s = F.col("momentum_fragility_score")
    label = F.when(s >= F.col("_p90"), "Stretched").when(s >= F.col("_p75"), "Elevated").otherwise("")
    return events.crossJoin(F.broadcast(cuts)).withColumn("fragility_flag", label).drop("_p75", "_p90")


def calendar(scored: DataFrame, window_days: int = 14, back_days: int = 7) -> DataFrame:
    """Event rows of a window that starts ``back_days`` before the last event, with statistics and labels, by day and falling score."""
    events = scored.where("is_earnings_day = 1")
    ref = F.broadcast(events.agg(F.date_sub(F.max("earnings_date"), back_days).alias("_ref")))
    rows = fragility_labels(events).crossJoin(ref).where("earnings_date BETWEEN _ref AND date_add(_ref, %d) AND earnings_explosiveness_bucket IS NOT NULL" % window_days)
    stats = shrunk_stats(events).select("earnings_explosiveness_bucket", "hist_extreme_prob", "base_extreme_prob", "lift_vs_base")
    day = Window.partitionBy("earnings_date").orderBy(F.col("earnings_explosiveness_score").desc(), "stock")
    return rows.join(stats, "earnings_explosiveness_bucket", "left").select(
        "stock", "earnings_date", "sector", "sub_sector", "earnings_explosiveness_bucket", "earnings_explosiveness_score", "fragility_flag", "is_high_conviction", "surprise_momentum_flag", "pre_earnings_drift_flag",
        "hist_extreme_prob", "base_extreme_prob", "lift_vs_base", F.row_number().over(day).alias("nth"),
    ).orderBy("earnings_date", "nth")


def calendar_summary(rows: DataFrame) -> DataFrame:
    """One row over a calendar: its days, counts, average score, busiest sector (of equal ones the first by name) and base rate."""
    per = rows.where("sector IS NOT NULL").groupBy("sector").count()
    top = F.broadcast(per.agg(F.min_by("sector", F.struct(-F.col("count"), "sector")).alias("hottest_sector")))  # one row
    tier = F.col("earnings_explosiveness_bucket")
    return rows.agg(
        F.min("earnings_date").alias("first_day"), F.max("earnings_date").alias("last_day"), F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("fragility_flag") != "").alias("n_elevated_frag"),
        F.count_if("is_high_conviction").alias("n_high_conviction"), F.bround(F.avg("earnings_explosiveness_score"), 1).alias("avg_risk_score"), F.bround(F.max("base_extreme_prob") * 100, 1).alias("base_extreme_pct"),
        *[F.count_if(tier == t).alias(n) for t, n in ((HIGH, "n_high_alert"), (ELEVATED, "n_elevated"), (NORMAL, "n_normal"))],
    ).crossJoin(top)


def calendar_days(rows: DataFrame) -> DataFrame:
    """One row a day: its events as an ordered array, and counts."""
    entry = F.struct("stock", "earnings_explosiveness_bucket", F.bround("earnings_explosiveness_score", 1).alias("score"))
    return rows.groupBy(F.date_format("earnings_date", "yyyy-MM-dd").alias("day")).agg(
        F.to_json(F.sort_array(F.collect_list(entry))).alias("entries"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("earnings_explosiveness_bucket") == HIGH).alias("n_high"))


def effective_tier() -> Column:
    """A tier raised by the stock's own lift; the first rule that fits wins."""
    b, lift = F.col("earnings_explosiveness_bucket"), F.col("lift_vs_base")
    return F.when((b == NORMAL) & (lift >= 1.5), ELEVATED).when(b.isin(NORMAL, ELEVATED) & (lift >= 3), HIGH).otherwise(b)


def tier_class() -> Column:
    b = F.col("earnings_explosiveness_bucket")
    return F.when(F.col("is_high_conviction"), "hc").when(b == HIGH, "high").when(b == ELEVATED, "mid").otherwise("low")


def tier_label() -> Column:
    """What a tier is called in public: high conviction within high alert."""
    return F.element_at(F.create_map(*[F.lit(x) for x in ("hc", "HIGH CONVICTION ★", "high", "HIGH ALERT", "mid", "ELEVATED", "low", "NORMAL")]), tier_class())


def last_reactions(events: DataFrame, n: int = 16) -> DataFrame:
    """The last ``n`` reactions of each stock."""
    w = Window.partitionBy("stock").orderBy(F.col("earnings_date").desc())
    return events.where("reaction_3d IS NOT NULL").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("stock", "nth", "earnings_date", "reaction_3d")


def stock_reports(scored: DataFrame, ahead: int = 7) -> DataFrame:
    """Per stock with an event in the next ``ahead`` days: own shrunk statistics, tier, rank and text."""
    events = scored.where("is_earnings_day = 1")
    own = shrunk_stats(events, "stock").select("stock", "earnings_explosiveness_bucket", "hist_extreme_prob", "base_extreme_prob", "lift_vs_base", "n_events")
    everyone = latest_rows(scored)
    ranked = everyone.withColumn("peer_percentile", peer_percentile())
    today = F.broadcast(scored.agg(F.max("date").alias("_today")))
    rows = ranked.crossJoin(today).where("earnings_date BETWEEN _today AND date_add(_today, %d)" % ahead).drop("_today")
    rows = rows.join(own, ["stock", "earnings_explosiveness_bucket"], "left")
    sure = F.coalesce((F.col("earnings_explosiveness_bucket") == HIGH) & (F.col("pre_earnings_drift_flag") != ""), F.lit(False))
    rows = rows.withColumn("is_high_conviction", sure).withColumn("risk_level", effective_tier())
    return rows.withColumn("rank_text", ordinal(F.col("peer_percentile"))).withColumn("recommendation", recommendation())


def recommendation() -> Column:
    """A sentence on the tier, and one for each flag that is set."""
    pct = lambda c: F.format_string("%.0f%%", F.coalesce(F.col(c), F.lit(0.0)) * 100)
    facts = F.concat(F.lit("Past events of this tier moved 8% or more in "), pct("hist_extreme_prob"), F.lit(" of cases, against "), pct("base_extreme_prob"), F.lit(" overall."))
    level = F.col("risk_level")
    head = (
        F.when(F.col("is_high_conviction"), "High conviction: expect a large move; keep exposure through the report small or hedged.")
        .when(level == HIGH, "High alert: a large move is likely; reduce or hedge before the report.")
        .when(level == ELEVATED, "Elevated: a move above the usual is plausible; size positions with care.")
        .otherwise("Normal: no sign of an unusual move.")
    )
    s, d = F.col("surprise_momentum_flag"), F.col("pre_earnings_drift_flag")
    streak = F.when(s == "Extended Beat Streak", "A long run of beats is due to end.").when(s == "Beat Streak", "A streak of large beats has raised the bar.").when(s == "Miss Streak", "A streak of misses has lowered the bar.").when(s == "Erratic", "Surprises have been erratic.")
    drift = F.when(d == "Extended", "The price has run up more than usual into the event.").when(d == "Compressed", "The price has sold off more than usual into the event.")
    return F.concat_ws(" ", head, facts, streak, drift)


def track_record(scored: DataFrame, weeks: int = 6) -> DataFrame:
    """Flagged events of the last weeks with what happened; newest day first, smaller moves first."""
    require(scored, ["stock", "earnings_date", "reaction_1d", "reaction_3d", "earnings_explosiveness_bucket", "is_high_conviction"])
    events = scored.where("is_earnings_day = 1").withColumn("best_reaction", F.coalesce("reaction_3d", "reaction_1d"))
    since = F.broadcast(events.agg(F.date_sub(F.max("earnings_date"), 7 * weeks).alias("_since")))
    rows = events.crossJoin(since).where(F.col("earnings_date") >= F.col("_since")).where(F.col("earnings_explosiveness_bucket").isin(HIGH, ELEVATED)).where("best_reaction IS NOT NULL")
    return rows.select(
        "stock", "earnings_date", F.to_date(F.date_trunc("week", "earnings_date")).alias("week_start"), tier_class().alias("tier"), tier_label().alias("tier_label"),
        F.bround(F.col("best_reaction") * 100, 2).alias("move_pct"), (F.abs("best_reaction") >= CONFIG.extreme).alias("extreme"), F.bround("earnings_explosiveness_score", 1).alias("risk_score"),
    ).orderBy(F.col("earnings_date").desc(), F.abs("move_pct"), "stock")


def track_record_json(rows: DataFrame, generated: Column | None = None, weeks: int = 6) -> DataFrame:
    """The public record as one JSON document: when and what, a summary, and the calls, newest day first, smaller moves first."""
    call = F.struct(
        F.col("earnings_date").cast("string").alias("earnings_date"), F.col("week_start").cast("string").alias("week_start"), F.col("stock").alias("ticker"), F.col("tier").alias("tier_class"), "tier_label",
        "move_pct", F.abs("move_pct").alias("abs_move_pct"), F.col("extreme").alias("is_extreme_move"), "risk_score",
    )
    place = F.struct((-F.unix_date("earnings_date")).alias("d"), F.abs("move_pct").alias("m"), "stock", call.alias("call"))
    flagged = F.col("tier").isin("hc", "high")
    last = F.max("earnings_date").cast("string") if generated is None else generated
    doc = rows.agg(
        last.alias("generated"), F.count(F.lit(1)).alias("total_calls"), F.count_if(flagged).alias("high_alert_calls"), F.count_if(flagged & F.col("extreme")).alias("high_alert_extreme_moves"),
        F.transform(F.sort_array(F.collect_list(place)), lambda x: x["call"]).alias("calls"),
    )
    summary = F.struct(F.lit(weeks).alias("weeks"), "total_calls", "high_alert_calls", "high_alert_extreme_moves")
    return doc.select(F.to_json(F.struct(
        "generated", F.lit("Public record of completed calls.").alias("description"), F.lit("Completed events only.").alias("delay_policy"),
        F.lit(CONFIG.extreme * 100).alias("extreme_move_threshold_pct"), summary.alias("summary"), "calls")).alias("document"))


def week_results(scored: DataFrame, returns: DataFrame) -> DataFrame:
    """Events of the last full week with an event, with the returns around them and whether they moved."""
    events = scored.where("is_earnings_day = 1 AND earnings_explosiveness_bucket IS NOT NULL")
    week = F.broadcast(events.agg(F.to_date(F.date_trunc("week", F.max("earnings_date"))).alias("_monday")))
    rows = events.crossJoin(week).where("earnings_date BETWEEN _monday AND date_add(_monday, 4)").drop("_monday")
    moved = F.coalesce(F.abs(F.coalesce("reaction_3d", "reaction_1d")) >= CONFIG.large, F.lit(False))
    return rows.join(returns, ["stock", "date"], "left").withColumn("moved", moved).withColumn("tier_rank", tier_rank())


def recent_hit_rate(scored: DataFrame, returns: DataFrame, lookback_days: int = 9) -> DataFrame:
    """Of the scored events of the last days, by tier, of the flagged tiers and of all: how many moved by +3 days, cumulated."""
    today = F.broadcast(scored.agg(F.max("date").alias("_today")))
    rows = scored.where("is_earnings_day = 1 AND earnings_explosiveness_bucket IS NOT NULL").crossJoin(today)
    rows = rows.where("earnings_date >= date_sub(_today, %d) AND earnings_date < _today" % lookback_days).join(returns, ["stock", "date"], "left")
    b = F.col("earnings_explosiveness_bucket")
    groups = F.explode(F.array_compact(F.array(b, F.when(b.isin(HIGH, ELEVATED), "flagged"), F.lit("all"))))
    return rows.withColumn("tier", groups).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.count("cum_3").alias("known"), F.count_if(F.coalesce(F.abs("cum_3") >= CONFIG.large, F.lit(False))).alias("moved"))


def joined_calendar(history: DataFrame, ahead: DataFrame) -> DataFrame:
    """History and upcoming events in one table; on a tie the history stays."""
    both = history.withColumn("_p", F.lit(0)).unionByName(ahead.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("stock", "earnings_date").orderBy("_p")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def flag_text() -> Column:
    return F.concat_ws(" · ", F.nullif("surprise_momentum_flag", F.lit("")), F.nullif("pre_earnings_drift_flag", F.lit("")))


def status_label() -> Column:
    return F.when(F.col("status") == "inactive", F.concat("stock", F.lit(" (inactive)"))).otherwise(F.col("stock"))
