"""Quality rules whose thresholds adapt to each language and source.

Every document gets counts of its whole text and, from them, the rates in ``RATES``. Each rate's
distribution within a (lang, source) group is held in a mergeable quantile sketch: counts of
logarithmic buckets with a relative error of ``ERROR``, which add up whatever the order, so the result
does not depend on partitioning. A document is rejected if a rate lies beyond the fence of its
group, ``q80 + FENCE * max(q80 - q50, spread)``; the spread keeps a rate that is zero nearly
everywhere from rejecting its first occurrence. A group of fewer than ``LEAST`` documents takes the merged
sketch of its language, and if that is as small, of all documents. The fixed base rule comes first:
fewer than ``MIN_WORDS`` words, or more than half of the words in repeated 3-word windows.

Cases: a null text has no words, so the base rule rejects it; a null lang or source is a group of its
own; repeated rows and ties are judged alike; a null doc_id is an ordinary value; an empty table
gives an empty result; extra columns are ignored by :func:`judged` and kept by :func:`accepted`.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import read, save, small_batches

#: Fixed values of the base rule and the counted symbols.
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
#: Rates with the least spread that a fence assumes for each.
RATES = {"symbol_rate": 0.02, "mark_rate": 0.03, "upper_rate": 0.03, "dup_line_rate": 0.15, "repeat_rate": 0.1, "word_length": 0.5}
FENCE = 3.0
LEAST = 50
ERROR = 0.02
_LOG = math.log((1 + ERROR) / (1 - ERROR))
TINY = 1e-6
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.zeros(256, np.uint8)
_TABLE[list(range(9, 14)) + [32]] = 1  # white space
_TABLE[0x80:0xC0] = 2  # continuation bytes
_TABLE[list(SYMBOLS)] = 4
_TABLE[list(MARKS)] = 8
_TABLE[ord("A") : ord("Z") + 1] = 16

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc ^= h[j : j + n]
        acc *= _ODD
        acc ^= acc >> np.uint64(29)
    order = np.argsort(acc, kind="stable")
    same = acc[order[1:]] == acc[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(words), bool)
    for j in range(width):
        marked[j : j + n] |= twice
    return int(marked.sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The values of COUNTS for a UTF-8 text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    kinds = np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=17)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = len(text) - int(kinds[1]) - int(kinds[2])
    return (len(words), chars, int(kinds[4]), len(lines) - len(set(lines)), repeated_words(words), len(lines), int(kinds[8]), int(kinds[16]))


def _measured(at: int, drop: bool):
    """Rows with COUNTS of the text in column ``at``, and without that column if ``drop``."""
    def run(batches):
        for b in batches:
            rows = [counts(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            kept = [i for i in range(b.num_columns) if i != at or not drop]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), *cols], [*(b.schema.names[i] for i in kept), *COUNTS])

    return run


def _with_rates(rows: DataFrame, at: int, drop: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    kept = [f for i, f in enumerate(rows.schema) if i != at or not drop]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in COUNTS)])
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return (
        rows.mapInArrow(_measured(at, drop), schema)
        .withColumn("symbol_rate", per("n_symbols", "word_chars")).withColumn("mark_rate", per("n_marks", "word_chars"))
        .withColumn("upper_rate", per("n_upper", "word_chars")).withColumn("dup_line_rate", per("n_dup_lines", "n_lines"))
        .withColumn("repeat_rate", per("n_repeat_words", "n_words")).withColumn("word_length", per("word_chars", "n_words"))
        .withColumn("base_failed", base_failed())
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with COUNTS, RATES and base_failed."""
    return _with_rates(docs.select(F.col("text").alias("_text"), *keep), 0, True)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """The quantile sketches: (lang, source, rate, bucket, n). Adding up ``n`` merges sketches."""
    pairs = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(r).alias("k"), F.col(r).alias("v")) for r in RATES]))).alias("rate", "x")
    bucket = F.when(F.col("x") > TINY, F.ceil(F.log(F.col("x")) / F.lit(_LOG))).otherwise(F.lit(-(2**31))).cast("int")
    return rows.select("lang", "source", pairs).groupBy("lang", "source", "rate", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quantile(q: float) -> Column:
    """Of ``bins``, sorted (bucket, n): the middle of the bucket that holds the quantile."""
    rank = F.lit(q) * (F.col("docs") - 1)
    step = lambda acc, x: F.when(acc["at"].isNotNull(), acc).otherwise(
        F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["seen"] + x["n"] > rank, x["bucket"]).alias("at")))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
    at = F.aggregate("bins", start, step, lambda acc: acc["at"])
    return F.when(at == -(2**31), 0.0).otherwise(F.exp((at - 0.5) * F.lit(_LOG)))


def fences(parts: DataFrame) -> DataFrame:
    """Upper fence per (level, lang, source, rate) from sketches of the accepted part of a corpus."""
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = parts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        gone = [F.lit(None).cast(dict(parts.dtypes)[k]).alias(k) for k in ("lang", "source") if k not in keys]
        per = merged.groupBy(*keys, "rate").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("bins"), F.sum("n").alias("docs"))
        levels.append(per.select(F.lit(level).alias("level"), "*", *gone).select("level", "lang", "source", "rate", "bins", "docs"))
    spread = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in RATES.items()])), F.col("rate"))
    out = reduce(DataFrame.union, levels).withColumn("q50", _quantile(0.5)).withColumn("q80", _quantile(0.8))
    out = out.withColumn("fence", F.col("q80") + F.lit(FENCE) * F.greatest(F.col("q80") - F.col("q50"), spread))
    return out.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("rate", "fence"))).alias("fences"))


def _limits(rows: DataFrame) -> DataFrame:
    """The fences, by way of the written sketches: a few rows a group, whatever the size of the corpus."""
    return save(fences(save(sketches(rows.where(~F.col("base_failed"))), "sketches")), "fences")


def _with_verdict(rows: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``rows`` with kept, by the fences of each row's group."""
    own, of_lang, every = (limits.where((F.col("level") == i) & ((F.col("docs") >= LEAST) if i < 2 else F.lit(True))).alias(f"l{i}") for i in range(3))
    rows = rows.alias("r")
    rows = rows.join(own, F.col(f"r.{lang}").eqNullSafe(F.col("l0.lang")) & F.col(f"r.{source}").eqNullSafe(F.col("l0.source")), "left")
    rows = rows.join(of_lang, F.col(f"r.{lang}").eqNullSafe(F.col("l1.lang")), "left")
    rows = rows.join(every, F.col("l2.level") == F.lit(2), "left")
    fence = F.coalesce("l0.fences", "l1.fences", "l2.fences")
    beyond = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"r.{r}") > fence[r], F.lit(False)) for r in RATES])
    return rows.select("r.*", (~F.col("r.base_failed") & ~beyond).alias("kept"))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with COUNTS, RATES, base_failed and kept."""
    rows = save(measured(docs, list(dict.fromkeys([*keep, "lang", "source"]))), "quality")
    return _with_verdict(rows, _limits(rows))


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows.

    Every text is measured twice, once for the fences and once beside its row, so that no text is written
    or shuffled on the way. Columns go by their place, so names can't clash.
    """
    limits = _limits(measured(docs.select("text", "lang", "source"), ["lang", "source"]))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    lang, source, text = (docs.columns.index(c) for c in ("lang", "source", "text"))
    rows = _with_verdict(_with_rates(docs.toDF(*names), text, False), limits, names[lang], names[source])
    return rows.where("kept").select(*names).toDF(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    found = judged(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
