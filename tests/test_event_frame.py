"""Results of event rows without the whole scored frame."""

import os

import pytest

from tailwatch.config import CACHED
from tailwatch.operators import ingest
from tailwatch.plans import registry, sqltext, stages

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: The queries found to write whole frames, by finding.
FOUND = {
    1: "b03_decile_lift", 2: "b18_threshold_search", 3: "b22_drift_deciles", 4: "l02_incremental", 5: "l02_incremental_all", 6: "a08_last_known", 7: "a09_shrunk_stats", 8: "a10_hit_rates",
    9: "a11_capture", 10: "a13_percentile_bands", 11: "a14_stats_by_date", 12: "a15_describe", 13: "a17_spearman_by_year", 14: "a21_median_split", 15: "b02_frozen_edges", 16: "b04_tails",
    17: "b06_conditional", 18: "b07_volatility_only", 19: "b08_high_risk", 20: "b09_precision_recall", 21: "b11_by_date", 22: "b12_correlations", 23: "b12_train_test", 24: "b13_yearly_oos",
}


@pytest.mark.parametrize("name", FOUND.values())
def test_no_whole_frame_is_written(spark, monkeypatch, name):
    kept, names = stages._kept, []
    monkeypatch.setattr(stages, "_kept", lambda s, d, frame, build: names.append(frame) or kept(s, d, frame, build))
    assert registry.QUERIES[name](spark, SF).columns
    assert names and not {"daily", "featured", "scored"} & {*names}


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-9, abs=1e-12)


def same(got, want, keys):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert set(a) == set(b) and len(a) > 0
    assert [(k, c, a[k][c], b[k][c]) for k in a for c in cols if not near(a[k][c], b[k][c])] == []


def test_event_rows_equal_those_of_the_scored_frame(spark):
    want = stages.events_of(stages.scored_frame(spark, SF))
    same(stages.event_frame(spark, SF, want.columns), want, ["stock", "date"])
    assert sqltext.events(spark, SF).columns[:3] == ["stock", "date", "earnings_date"]


def test_last_known_values_equal_those_of_the_scored_frame(spark):
    same(stages.last_known(spark, SF, CACHED), ingest.last_known(stages.scored_frame(spark, SF), "stock", "date", CACHED), ["stock"])


def test_event_rows_stay_where_their_lines_went(spark, monkeypatch):
    """One shuffle of lines and events by stock, and none of the rows with their features, by sector or by stock."""
    built = []
    monkeypatch.setattr(stages, "_kept", lambda s, d, frame, build: built.append(build()) or built[-1])
    monkeypatch.setattr(stages.features, "sector_days", lambda df: df.sparkSession.createDataFrame([], "sector string, date date, _density double, sector_drift_60d double, sector_vol_10d double, sector_vol_30d double"))
    stages.event_frame(spark, SF, ["stock"])
    plan = built[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sector") == 0
    assert plan.count("Exchange hashpartitioning(stock") <= 3  # lines and events, the events' own rule, the dimension


def test_lines_are_shuffled_without_their_stock_name(spark):
    plan = stages.narrow_daily(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(coalesce(stock") == 1
