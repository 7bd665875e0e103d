"""Windows over the days of a stock as arrays, against Spark's own frames."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tailwatch.operators import features, joins, stock_days
from tailwatch.plans import stages
from tailwatch.sources import derived

SF = "/root/testdata/sf0.001"
D0 = datetime.date(2020, 1, 1)


def test_array_windows_equal_frames_on_odd_days(spark):
    """Constant, zero, missing, NaN and infinite prices, gaps, two suppliers of one name, events without a day, short stocks."""
    rnd, rows, events = random.Random(3), [], []
    odd = {7: lambda i: 5.0, 11: lambda i: 0.0 if i % 40 < 31 else 9.0, 12: lambda i: None if i % 9 == 0 else rnd.random(), 13: lambda i: float("nan") if i == 60 else 2.0 + i, 14: lambda i: float("inf") if i == 50 else 1.0 + i % 3}
    for key, n in [(7, 90), (11, 120), (12, 150), (13, 130), (14, 130), (20, 140), (21, 1), (22, 2), (23, 31), (30, 100), (123450, 70), (123451, 70), (-1, 64)]:
        for i in range(n):
            # of the two keys of one name, days differ: their order within a day is open
            day = D0 + datetime.timedelta(2 * i + (key == 123451)) + datetime.timedelta(300 * (i > 80))
            rows += [(key, day, odd.get(key, lambda i: 10 + rnd.random())(i))] * (1 + i % 2)
        name = ("S" + str(key).rjust(5, "0"))[:6]
        events += [(name, D0 + datetime.timedelta(d), *e) for d, e in ((0, (1.0, 2.0, -0.5)), (41, (None,) * 3), (60, (3.0, None, None)), (2000 * (key % 2), (None,) * 3)) if not (d == 2000 and key == 123451) and not (d == 0 and key == 123451)]
    events = sorted({(e[0], e[1]): e for e in events}.values(), key=lambda e: e[:2])
    raw = spark.createDataFrame(rows, "l_suppkey long, date date, u double")
    lines = raw.select(derived.stock_of("l_suppkey").alias("stock"), "l_suppkey", "date", "u")
    ev = spark.createDataFrame(events, "stock string, earnings_date date, reported_eps double, estimated_eps double, surprise_percentage double")

    days = lines.groupBy("stock", "l_suppkey", "date").agg(F.avg("u").alias("u"))
    prices = days.select("stock", "date", derived.trailing_mean("l_suppkey").alias("price"))
    want = features.daily(joins.asof_forward(prices, ev, stages.EPS))
    one = joins.days_of_stocks(lines, ev, stages.EPS, derived.stock_of("l_suppkey"))
    got = features.reacted(one.select("stock", F.inline(stock_days.windows("days", stages.EPS, derived.trailing_rows))))
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    a, b = ({(r["stock"], r["date"]): [repr(r[c]) for c in cols] for r in df.collect()} for df in (got, want))
    assert set(a) == set(b) and len(a) > 900
    assert [(k, c, x, y) for k in a for c, x, y in zip(cols, a[k], b[k]) if x != y] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_shuffle_is_gone_before_event_rows_are_shuffled(spark, monkeypatch):
    """Days have no sliding frame, event rows are written by themselves first, and that table is gone with the frame's end."""
    assert "stddev_samp(" not in stages.narrow_daily(spark, SF)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(stages, "_frames", {})
    kept, names = stages._kept, []
    monkeypatch.setattr(stages, "_kept", lambda s, d, frame, build: names.append(frame) or kept(s, d, frame, build))
    assert stages.event_frame(spark, SF, ["stock", "date"]).count() > 0
    assert names == ["events", "days"] and [k[-1] for k in stages._frames] == ["events"]
