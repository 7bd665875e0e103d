"""Queries that cover whole tables against their SQL, and against what they must not leave out."""

import os

import pytest
from pyspark.sql import functions as F

from tailwatch.plans import registry, stages
from tailwatch.sources import derived, files
from test_oracle import SF, tables, test_query_equals_its_sql as equals_its_sql  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["s14_close_matrix"])
def test_close_matrices_equal_their_sql(spark, tables, name):  # noqa: F811
    equals_its_sql(spark, tables, name)


@pytest.mark.parametrize("name", ["s12_price_payload", "s13_earnings_payload"])
def test_payloads_equal_their_sql(spark, tables, name):  # noqa: F811
    equals_its_sql(spark, tables, name)


@pytest.mark.parametrize("name, reader, table", [("s12_price_payload", "price_payload", derived.prices), ("s13_earnings_payload", "earnings_payload", derived.earnings)])
def test_every_row_goes_through_a_payload(spark, monkeypatch, name, reader, table):
    parse, parsed = getattr(files, reader), []

    def counted(raw):
        parsed.append(parse(raw).count())
        return parse(raw)

    monkeypatch.setattr(files, reader, counted)
    registry.QUERIES[name](spark, SF).count()
    assert parsed == [table(spark, SF).count()]


def test_close_matrices_cover_every_stock_in_several_batches(spark):
    prices = derived.prices(spark, SF).unionByName(derived.prices(spark, SF).withColumn("stock", F.concat(F.lit("T"), "stock")))
    batches = files.batched(prices.select("stock"), 3)
    assert batches.agg(F.countDistinct("batch")).first()[0] > 1
    got = files.close_rows(files.close_matrices(prices, batches, 3), batches)
    assert got.count() == prices.count() and got.select("stock").distinct().count() == prices.select("stock").distinct().count()
    assert {r.stock for r in registry.QUERIES["s14_close_matrix"](spark, SF).select("stock").distinct().collect()} == {r.stock for r in derived.prices(spark, SF).select("stock").distinct().collect()}


@pytest.mark.parametrize("name", ["l02_incremental", "l02_incremental_features"])
def test_short_runs_equal_their_sql(spark, tables, name):  # noqa: F811
    equals_its_sql(spark, tables, name)


def test_the_short_run_is_scored_and_exported(spark):
    whole = stages.scored_frame(spark, SF)
    got = registry.QUERIES["l02_incremental_all"](spark, SF)
    for c in ("vol_stress_extreme", "momentum_pressure_regime", "proximity_score", "vol_expansion_score", "momentum_fragility_score", "surprise_momentum_flag", "pre_earnings_drift_flag", "risk_score", "is_high_conviction"):
        assert c in got.columns and got.where(F.col(c).isNull()).count() <= (got.count() if c == "risk_score" else 0)
    assert got.count() == stages.recent_features(spark, SF).count()
    both = got.alias("a").join(whole.alias("b"), ["stock", "date"])  # proximity needs no history
    assert both.count() == got.count() and both.where("abs(a.proximity_score - b.proximity_score) > 1e-5").count() == 0
    up, want = (registry.QUERIES[n](spark, SF) for n in ("l02_incremental_upcoming", "m02_upcoming"))
    assert up.count() > 0 and {r.stock for r in up.select("stock").collect()} == {r.stock for r in want.select("stock").collect()}
