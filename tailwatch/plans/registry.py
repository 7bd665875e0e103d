"""Registered queries of the reference operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def finished(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places: the only rounding of a result."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: finished(f(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


from . import queries_evaluation, queries_features, queries_ingest, queries_marts  # noqa: E402,F401
