"""The pipeline's stages one after the other, and the registered queries."""

import os

import duckdb
import pytest

import corpus_pipeline
from tailwatch.llm import near_dup, pieces, quality, secrets
from tailwatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(pieces.MODEL)), reason="no test tables")


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    assert all(d.columns == names for d in out[1:-1])
    text = lambda d: {r.doc_id: r.text for r in d.collect()}
    judged = {r.doc_id for r in quality.judged(docs.select("doc_id", "text", "lang", "source"), ["doc_id"]).where("kept").collect()}
    assert set(text(out[1])) == judged
    assert set(text(out[2])) == {r.doc_id for r in near_dup.components(out[1], 5, 80).where("doc_id = component").collect()}
    before, after = text(out[2]), text(out[3])
    assert after == {i: secrets.redact(None if t is None else t.encode()) for i, t in before.items()}
    words = {i: (t or "").split() for i, t in after.items()}
    assert all(set(r.text.split()) <= set(words[r.doc_id]) for r in out[4].collect())
    assert out[5].count() == out[4].count() and out[5].where("NOT decoded").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() == out[5].count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    key = lambda rows: sorted(str([float(f"{x:.9g}") if isinstance(x, float) else x for x in r]) for r in rows)
    assert key([r[c] for c in cols] for r in QUERIES[name](spark, SF).collect()) == key(cur.fetchall())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
