"""Token-count rollups that are maintained from deltas.

A change row says what happened to a document: ``insert`` and ``delete`` carry its count, ``revise``
its old and its new one. Each row becomes signed amounts of documents and tokens; a batch is the sum
of its amounts by source, language and tokenizer version. Counts come from published tokenizers (:func:`counted`).

A batch is written as an attempt, complete with Spark's ``_SUCCESS``, and published by a marker file that only one
writer can create and that names the attempt: committing a batch id again does nothing, of two writers of one id one
wins, and what a failed attempt left is never read. Totals are sums over the batches, so they do not depend on the
order of commits. :meth:`Rollup.compact` folds the newest fold and all published batches into a new fold with their ids;
readers take the newest complete fold alone, and batches that it does not hold, so a crash at any step neither loses nor
doubles a count. One process compacts at a time.

Cases: null counts are 0; null source, language and version are groups of their own; a revision that
moves a document to another group is a delete and an insert; equal change rows count each; an
unknown kind of change fails the batch before anything is written; groups whose documents and tokens
are back at 0 leave the totals; an empty batch is committed and changes nothing; extra columns are
ignored. A hot source is summed map-side before the shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import read, save, scratch_path, small_batches

KEYS = ("source", "lang", "version")


def word_counts(texts: list[str], path: str) -> np.ndarray:
    return np.array([len(t.encode().split()) for t in texts], np.int64)


def piece_counts(texts: list[str], path: str) -> np.ndarray:
    return np.diff(pieces.codec(path).encode_packed(texts)[1])


#: Counters by tokenizer version, over whole texts: words between ASCII white space, and a published subword model.
COUNTERS = {"words-1": word_counts, "pieces-32k": piece_counts}


def counted(docs: DataFrame, texts: list[str], keep: list[str], path: str = pieces.MODEL) -> DataFrame:
    """``keep`` columns, and for each column of ``texts`` its counts (array) by the versions of COUNTERS; null for null."""
    def run(batches):
        for b in batches:
            out = []
            for i in range(len(texts)):
                column = b.column(i).to_pylist()
                per = np.stack([f([t or "" for t in column], path) for f in COUNTERS.values()], axis=1).tolist() if column else []
                out.append(pa.array([None if t is None else n for t, n in zip(column, per)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(texts), b.num_columns)), *out], names)

    small_batches(docs.sparkSession)
    kept = docs.select(*keep)
    counts = [f"n_{t}" for t in texts]
    names = [*kept.columns, *counts]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{c} array<bigint>" for c in counts)])
    return docs.select(*(F.col(t).alias(f"_t{i}") for i, t in enumerate(texts)), *keep).mapInArrow(run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Additive amounts (docs, tokens) of changes (kind, n_tokens, old_tokens and the keys)."""
    kind, new, old = F.col("kind"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0)
    docs = F.coalesce(docs, F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == "insert", new).when(kind == "delete", -old).otherwise(new - old)
    return changes.select(*KEYS, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def _summed(amounts: DataFrame) -> DataFrame:
    return amounts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """A store of additive totals in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _published(self, batch: str) -> str | None:
        """The attempt that counts for a batch, if one was published."""
        at = self._at(f"{self.path}/batch={batch}/_published")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or None
        finally:
            stream.close()

    def _state(self) -> tuple[str | None, dict[str, str]]:
        """The newest complete fold, and the published batches outside it with their attempts."""
        names = self._names(self.path)
        folds = [n for n in names if n.startswith("folded=") and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS"))]
        batches = {b: a for n in names if n.startswith("batch=") and (a := self._published(b := n.removeprefix("batch=")))}
        fold = folds[-1] if folds else None
        if fold and batches:  # what a crash left beside its fold
            for r in self._ids(fold).where(F.col("id").isin(list(batches))).collect():
                del batches[r.id]
        return fold, batches

    def _ids(self, fold: str) -> DataFrame:
        return self.spark.read.schema("id string").parquet(f"{self.path}/{fold}/ids")

    def committed(self, batch: str) -> bool:
        fold, batches = self._state()
        return batch in batches or fold is not None and not self._ids(fold).where(F.col("id") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before, or by another writer meanwhile."""
        if not batch or any(c in batch for c in "/=:"):
            raise ValueError("a batch id is a file name without '=' and ':'")
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        _summed(signed(changes)).write.parquet(f"{self.path}/batch={batch}/attempt={attempt}")
        return self._publish(batch, attempt)

    def _publish(self, batch: str, attempt: str) -> bool:
        at = self._at(f"{self.path}/batch={batch}/_published")
        if self._fs.exists(at) and self._published(batch) is None:  # its writer died before naming an attempt
            self._fs.delete(at, False)
        try:
            stream = self._fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()).lower():
                return False
            raise
        stream.write(bytearray(attempt.encode()))
        stream.close()
        return self._published(batch) == attempt

    def _rows(self, fold: str | None, batches: dict[str, str]) -> DataFrame:
        schema = "source string, lang string, version string, docs long, tokens long"
        paths = [f"{self.path}/{fold}/rows"] * bool(fold) + [f"{self.path}/batch={b}/attempt={a}" for b, a in batches.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens)."""
        return _summed(self._rows(*self._state())).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold the newest fold and all published batches into one, then remove them."""
        fold, batches = self._state()
        if len(batches) + bool(fold) < 2:
            return
        name = f"folded={int(fold.removeprefix('folded=')) + 1 if fold else 1:08d}"
        self._fs.delete(self._at(f"{self.path}/{name}"), True)  # incomplete, if there
        _summed(self._rows(fold, batches)).write.parquet(f"{self.path}/{name}/rows")
        ids = self.spark.createDataFrame([(b,) for b in batches], "id string")
        (self._ids(fold).union(ids) if fold else ids).write.parquet(f"{self.path}/{name}/ids")
        self._fs.create(self._at(f"{self.path}/{name}/_SUCCESS")).close()
        self._remove_folded()

    def _remove_folded(self) -> None:
        """Delete what the newest fold holds."""
        fold, batches = self._state()
        for name in self._names(self.path):
            if name.startswith("folded=") and fold and name < fold or name.startswith("batch=") and name.removeprefix("batch=") not in batches and self._published(name.removeprefix("batch=")):
                self._fs.delete(self._at(f"{self.path}/{name}"), True)


def changes_of(rows: DataFrame, kind: str, new: Column, old: Column) -> DataFrame:
    """One change per tokenizer version, from arrays of counts by version."""
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(i).alias("i")) for i, v in enumerate(COUNTERS)])).alias("v")
    rows = rows.select("source", "lang", new.alias("_new"), old.alias("_old"), versions)
    of = lambda c: F.get(F.col(c), F.col("v.i"))
    return rows.select("source", "lang", "v.version", F.lit(kind).alias("kind"), of("_new").alias("n_tokens"), of("_old").alias("old_tokens"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents, each sent twice: all are inserted under both
    tokenizer versions; those with an id of remainder 3 by 10 lose their last line and are revised;
    those of remainder 7 are deleted. Between the second and the third, the store is compacted."""
    edited = F.when(F.col("doc_id") % 10 == 3, F.regexp_replace("text", r"\n[^\n]*$", ""))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", edited.alias("edited"))
    rows = save(counted(docs, ["text", "edited"], ["doc_id", "source", "lang"]), "counts")
    none = F.lit(None).cast("array<bigint>")
    store = Rollup(spark, scratch_path(spark, "rollup"))
    for batch, changes in (
        ("0001", changes_of(rows, "insert", F.col("n_text"), none)),
        ("0002", changes_of(rows.where("doc_id % 10 = 3"), "revise", F.col("n_edited"), F.col("n_text"))),
        ("0003", changes_of(rows.where("doc_id % 10 = 7"), "delete", none, F.col("n_text"))),
    ):
        for _ in range(2):
            store.commit(batch, changes)
        if batch == "0002":
            store.compact()
    return store.totals()
