"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tailwatch.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = [
    "s01_prices", "s13_earnings_payload", "j01_asof_forward", "j04_latest_iv", "d02_insert_or_ignore", "d04_upsert", "d08_validate_upcoming", "d09_clean_stored", "d10_dedup", "d12_at_the_money",
    "w03_volatility", "x01_sector_means", "x04_vol_ratio_pct", "e02_reaction_entropy", "e09_surprise_streak", "c08_explosiveness", "c12_drift_flag", "entry_tiers", "m01_dashboard", "m02_upcoming", "m08_track_record",
    "a13_percentile_bands", "b03_decile_lift", "b14_forward_onefactor", "b18_threshold_search", "b25_features",
]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = tables.execute(registry.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall()), key=key)


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
