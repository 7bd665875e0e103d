"""Files, sinks and streams."""

import datetime
import json

from pyspark.sql import functions as F

from tailwatch.plans import marts
from tailwatch.sources import files
from tailwatch.streaming import ingest as streams


def read_text(spark, path):
    return [r[0] for r in spark.read.text(path).collect()]


def test_universe_and_renames(spark, tmp_path):
    (tmp_path / "list.csv").write_text("Ticker,x\n aa ,1\nAA,2\nb b,3\nnan,4\n,5\n")
    (tmp_path / "list.txt").write_text("cc\n dd\n")
    (tmp_path / "renames.csv").write_text("old_ticker,new_ticker,note\nfb,meta,x\n")
    assert sorted(r[0] for r in files.universe_file(spark, f"{tmp_path}/list.csv").collect()) == ["AA", "BB"]
    assert sorted(r[0] for r in files.universe_file(spark, f"{tmp_path}/list.txt").collect()) == ["CC", "DD"]
    assert [tuple(r) for r in files.rename_file(spark, f"{tmp_path}/renames.csv").collect()] == [("FB", "META")]


def test_payloads_coerce_bad_values_to_null(spark):
    raw = spark.createDataFrame([("A", '{"2020-01-02":"1.5","soon":"x"}')], "stock string, body string")
    assert sorted(map(str, (tuple(r)[1:] for r in files.price_payload(raw).collect()))) == ["(None, None)", "(datetime.date(2020, 1, 2), 1.5)"]
    e = spark.createDataFrame([("A", json.dumps([{"reportedDate": "2020-01-02", "fiscalDateEnding": "", "reportedEPS": "None", "estimatedEPS": "2", "surprisePercentage": "5"}]))], "stock string, body string")
    r = files.earnings_payload(e).first()
    assert (r.reported_eps, r.estimated_eps, r.surprise_percentage, r.fiscal_end_date) == (None, 2.0, 0.05, None)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5), ("B", None)], "stock string, x double")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_parquet(df, f"{tmp_path}/p")
    files.write_json(df, f"{tmp_path}/j")
    files.write_text(df, f"{tmp_path}/t", {"stock": 4, "x": 5})
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == spark.read.parquet(f"{tmp_path}/p").count() == 2
    assert json.loads(read_text(spark, f"{tmp_path}/j")[0]) == {"stock": "A", "x": 1.5}
    assert read_text(spark, f"{tmp_path}/t") == ["A   1.5  ", "B   -    "]


def test_members_and_run_folders(spark):
    t = spark.createDataFrame([("BRK.B", "B", "F", "I")], ["Symbol", "Security", "GICS Sector", "GICS Sub-Industry"])
    assert files.index_members(t).first().stock == "BRK-B"
    assert files.latest_run(["2024-01-02", "2024-02-01"]) == "2024-02-01" and files.latest_run([]) is None


def test_html_tables_and_pages(spark, tmp_path):
    page = "<p>x</p><table id=a><tr><th>Symbol<th>Security</th></tr>".replace("<th>Security", "</th><th>Security") + "<tr><td>BRK.B</td><td>A &amp; <b>B</b>\n</td></tr><tr><td>C</td></tr></table><table><tr><td>other</td></tr></table>"
    t = files.html_table(spark, page)
    assert t.columns == ["Symbol", "Security"] and [tuple(r) for r in t.collect()] == [("BRK.B", "A & B"), ("C", None)]
    files.write_html(t, f"{tmp_path}/h", "T <1>")
    again = "\n".join(read_text(spark, f"{tmp_path}/h"))
    assert "T &lt;1&gt;" in again and [tuple(r) for r in files.html_table(spark, again).collect()] == [("BRK.B", "A & B"), ("C", "-")]


def test_a_run_folder_is_emptied_once(spark, tmp_path):
    day = datetime.date(2024, 2, 1)
    old = tmp_path / "output_2024_02_01"
    old.mkdir()
    (old / "stale").write_text("x")
    path = files.run_folder(spark, f"{tmp_path}", day)
    assert path == str(old) and not (old / "stale").exists()
    (old / "kept").write_text("x")
    assert files.run_folder(spark, f"{tmp_path}", day) == path and (old / "kept").exists()


def test_joined_calendar_prefers_history(spark):
    h = spark.createDataFrame([("A", "d1", 1)], "stock string, earnings_date string, h int")
    u = spark.createDataFrame([("A", "d1"), ("B", "d2")], "stock string, earnings_date string")
    assert sorted((r.stock, r.h) for r in marts.joined_calendar(h, u).collect()) == [("A", 1), ("B", None)]


def test_stream_batches_replace_themselves(spark, tmp_path):
    write = streams.insert_batches(f"{tmp_path}/t", ["k"], ["v"])
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    two = spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string")
    for number, batch in ((0, one), (0, one), (7, two), (7, two)):  # a replay, and numbers with a gap
        write(batch, number)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/t")
    assert sorted(map(tuple, rows.select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_deduplicates_and_aggregates(spark, tmp_path):
    feed = spark.range(40).select(F.concat(F.lit("S"), F.col("id") % 2).alias("stock"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id"))).alias("ts"), F.col("id").cast("double").alias("v"))
    feed.union(feed.limit(5)).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/in")
    q = streams.deduplicated(source, ["stock", "ts"], delay="2 days").writeStream.format("memory").queryName("dedup").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dedup").count() == 40
    q = streams.daily_last(source, "v").writeStream.outputMode("complete").format("memory").queryName("last").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stock, str(r.snapshot_date)): r.v for r in spark.table("last").collect()}[("S1", "2024-01-01")] == 23.0
