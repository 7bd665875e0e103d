"""Exact top-k search by inner product with MaxScore.

Vectors hold whole numbers, ``floor(1024 * x)``. Each dimension has two posting lists per block of documents:
those with a positive and those with a negative weight. For a query, the list whose sign is the
query's adds to scores, at most ``|q| * largest weight`` in the block, and the other only lowers
them. Sorted by that bound, the terms with the least bounds are non-essential as long as their bounds sum
to less than the k-th best score so far: a document on none of the essential terms' lists can't
enter. The essential lists are traversed, which gives candidates with partial scores; then each
non-essential dimension, largest bound first, is probed for the candidates that its and the remaining
bounds keep competitive. Shards are searched apart and their best merged.

The vectors are written once, dealt over all partitions by row, and stay there: queries go to them, ``QUERIES`` at a
time, as a broadcast of that many vectors. A task streams its shard in blocks and carries each query's best rows and floor
from block to block; it ends with at most k rows a query, which one window merges over the shards.

Cases: vectors that are null or hold a null or non-finite component take no part; an empty vector
scores 0 with all; a missing component counts as 0; rows with the query's own vec_id are not its
candidates; repeated rows of other ids are candidates each; a query row that is repeated counts
once, and of several vectors under one query id each is a query, told apart by nothing but its
results; ties go to the smaller vec_id; an empty table gives an empty result. Sums that could leave 64 bits are
taken in whole numbers of any size, and a result that does fails the query; a null vec_id is neither query nor candidate.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, read, save, small_batches

K = 10
SCALE = 1024
QUERIES = 8192
#: Documents between two updates of a query's k-th best score.
BLOCK = 1024
RESULT = "query_id long, query_no long, vec_id long, score long"


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


class Postings:
    """One block of documents: weights by dimension, and its posting lists by sign."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.by_dim = ids, np.ascontiguousarray(rows.T)
        self.lists = []
        for w in self.by_dim:
            up, down = np.flatnonzero(w > 0), np.flatnonzero(w < 0)
            self.lists.append(((up, w[up]), (down, w[down])))
        self.most = self.by_dim.max(1, initial=0)
        self.least = self.by_dim.min(1, initial=0)
        self.peak = np.maximum(self.most.astype(float), -self.least.astype(float))

    def fits(self, q: np.ndarray) -> bool:
        """Whether no sum can leave 64 bits."""
        return float(np.abs(q.astype(float)) @ self.peak) < 2.0**62


def search(block: Postings, q: np.ndarray, floor_score: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(documents of the block, scores) that reach ``floor_score``; all of them if it is None."""
    if not block.fits(q):
        return _exact(block, q, floor_score)
    n = len(block.ids)
    bound = np.where(q > 0, q * block.most, q * block.least)
    order = np.argsort(bound, kind="stable")
    order = order[q[order] != 0]
    sums = np.cumsum(bound[order])
    optional = 0 if floor_score is None else int(np.searchsorted(sums, floor_score, "left"))
    # with a floor of 0 or less, a document on no list at all can be competitive
    every = floor_score is None or floor_score <= 0
    score, seen = np.zeros(n, np.int64), np.full(n, every)
    for d in order[optional:]:
        gain, loss = block.lists[d] if q[d] > 0 else block.lists[d][::-1]
        score[gain[0]] += q[d] * gain[1]
        score[loss[0]] += q[d] * loss[1]
        seen[gain[0]] = True
    alive = np.flatnonzero(seen)
    for i in range(optional - 1, -1, -1):
        alive = alive[score[alive] + sums[i] >= floor_score]
        d = order[i]
        score[alive] += q[d] * block.by_dim[d, alive]
    if floor_score is not None:
        alive = alive[score[alive] >= floor_score]
    return alive, score[alive]


def _exact(block: Postings, q: np.ndarray, floor_score: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same for numbers so large that sums are taken one by one."""
    sums = [sum(int(a) * int(b) for a, b in zip(q, row)) for row in block.by_dim.T]
    at = [i for i, s in enumerate(sums) if floor_score is None or s >= floor_score]
    return np.array(at, np.int64), np.array([sums[i] for i in at], np.int64)  # raises OverflowError beyond 64 bits


class Best:
    """A query's k best rows so far, without those of its own id."""

    def __init__(self, q: np.ndarray, own: int, k: int = K):
        self.q, self.own, self.k, self.floor = q, own, k, None
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def meet(self, block: Postings) -> None:
        at, s = search(block, self.q, self.floor)
        found = block.ids[at]
        other = found != self.own
        ids, scores = np.concatenate([self.ids, found[other]]), np.concatenate([self.scores, s[other]])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[keep], scores[keep]
        if len(keep) == self.k:
            self.floor = int(self.scores[-1])


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = lists.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy()
    return out


def _widest(lists: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(lists)).as_py() or 0


def _search(queries, k: int):
    """The best rows of a shard (vec_id, v) for each of the broadcast queries."""
    def run(batches):
        table = pa.ipc.open_stream(queries.value).read_all()
        width = _widest(table["v"])
        found = [Best(q, own, k) for own, q in zip(table["query_id"].to_pylist(), _matrix(table["v"], width))]
        for block in _blocks(batches, width):
            for f in found:
                f.meet(block)
        for i in range(0, len(found), 1000):
            rows = [(f.own, n, f.ids, f.scores) for n, f in zip(table["query_no"].to_pylist()[i : i + 1000], found[i : i + 1000])]
            repeat = [len(ids) for _, _, ids, _ in rows]
            columns = [np.repeat([r[j] for r in rows], repeat) for j in (0, 1)] + [np.concatenate([r[j] for r in rows]) for j in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_no", "vec_id", "score"])

    return run


def _blocks(batches, width: int):
    """Postings of BLOCK rows; components beyond ``width`` meet none of any query."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield _postings(held, width)
            held, n = [], 0
    if n:
        yield _postings(held, width)


def _postings(batches: list, width: int) -> Postings:
    t = pa.Table.from_batches(batches)
    return Postings(t["vec_id"].to_numpy(), _matrix(t["v"], max(width, _widest(t["v"])))[:, :width])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id, v) for each query."""
    spark = vectors.sparkSession
    small_batches(spark, BLOCK)
    vectors = vectors.where("vec_id IS NOT NULL").withColumn("place", F.monotonically_increasing_id()).repartition(buckets(spark), "place")
    vectors = save(vectors.select("vec_id", "v"), "vectors")
    queries = queries.where("query_id IS NOT NULL").distinct().withColumn("query_no", F.monotonically_increasing_id())
    queries = save(queries, "queries")
    rounds = -(-queries.count() // QUERIES)
    parts = []
    for r in range(rounds):
        block = queries.where(F.pmod(F.xxhash64("query_no"), F.lit(rounds)) == r)
        parts.append(vectors.mapInArrow(_search(spark.sparkContext.broadcast(_stream(block.toArrow())), k), RESULT))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.union, parts)
    order = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def op6_topk(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v"))


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10"""
