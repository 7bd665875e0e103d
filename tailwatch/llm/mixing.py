"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, packed into blocks of a fixed number of words. The mix
is a sequence of slots, dealt to output shards of about ``SHARD`` slots. How many slots of a shard each source gets is
drawn: the whole part of its expected number for certain, and of what the fractional parts leave, as many
independent draws as they add up to, each by their sizes (a multinomial draw on residuals). So a shard's counts are
random with the weights as their means, and a source's total over all shards stays within a few slots of its target. A
source's slots are numbered on through the shards; the ``k``-th takes the block with index ``q(k mod n)``,
``q`` being the source's own pseudorandom permutation of its ``n`` blocks, and none beyond ``REPEAT * n`` is taken. Slots and
documents meet in a join by block index.

Cases: a null or blank text has size 0 and takes nothing; a null source is a source of its own,
last in order; a null ``doc_id`` is an ordinary value; repeated rows are packed one after the other,
each with its own result; an empty table gives an empty result. Rows with equal ``doc_id`` and size
are told apart by their place in the stream only. Extra columns are ignored by the query and kept
by :func:`mixed_documents`. A source is never collected into one task: sizes are summed map-side,
streams are cut into hash buckets of about ``BUCKET`` documents whose offsets come from a prefix
sum over bucket totals, itself in two levels, and slots are generated from shard rows dealt over all partitions. A
shard's draw compares each source with each of its draws, so sources are meant to be thousands at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, buckets, drop, n_words, save

#: Weights by rank of the source, and the most that a source may be repeated.
WEIGHTS = (1, 2, 3)
REPEAT = 3
#: Words of a block, slots of an output shard, documents of a stream bucket.
BLOCK = 64
SHARD = 16384
BUCKET = 512
#: Rows that a prefix sum takes in one group, and the unit of fractional parts.
GROUP = 4096
UNIT = 65536
#: Swap-or-not rounds of a permutation, and the prime of its arithmetic.
ROUNDS = 24
PRIME = 2147483647
SEED = 20240601


def _constants(r: int, seed: int) -> tuple[int, int, int]:
    """Multiplier, increment and pivot factor of round ``r``: powers of a primitive root."""
    a, b, k = (pow(16807, seed % 1009 + 3 * r + i, PRIME) for i in (1, 2, 3))
    return a, b, k


def permute(x: Column, n: Column, seed: int, key: Column | None = None) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0..n-1: swap-or-not rounds.

    In each round ``x`` and its partner ``(pivot - x) mod n`` swap or stay by one pseudorandom bit
    of the larger of the two, so every round, and hence the whole, is a bijection for any ``n``.
    """
    key = F.lit(0) if key is None else key
    rounds = [F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("abk", _constants(r, seed))]) for r in range(ROUNDS)]

    def step(y: Column, c: Column) -> Column:
        other = F.pmod((key + 1) * c["k"] % PRIME % n - y, n)
        bit = ((F.greatest(y, other) % PRIME) * c["a"] + c["b"]) % PRIME >= F.lit(PRIME // 2)
        return F.when(bit, other).otherwise(y)

    return F.aggregate(F.array(*rounds), x.cast("long"), step)


def source_table(sizes: DataFrame, weights=WEIGHTS, repeat: int = REPEAT, block: int = BLOCK) -> DataFrame:
    """Per source: rank, size, target, number of blocks, and the figures of its draw: shards, whole slots of a
    shard, and the place of its fractional part among all (``part`` units before ``part_end``, of ``parts``).

    ``sizes``: rows (source, words). Targets fill up by weight below a ceiling of ``repeat`` times
    the size: in ascending order of ceiling by weight, a source is at its ceiling exactly if the
    share it would get of what the sources before it leave exceeds that. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    per = per.select("source", "source_size", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("ceiling", F.lit(float(repeat)) * F.col("source_size"))
    fill = Window.orderBy(F.col("ceiling") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    per = (
        per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("full", F.col("left") * F.col("w") > F.col("ceiling") * F.col("left_w"))
        .withColumn("full_c", F.sum(F.when(F.col("full"), F.col("ceiling")).otherwise(0.0)).over(whole))
        .withColumn("full_w", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(whole))
        .withColumn("share", F.try_divide((F.col("total") - F.col("full_c")) * F.col("w"), F.col("all_w") - F.col("full_w")))
        .withColumn("target", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("share")))
    )
    per = per.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    per = per.withColumn("slots", F.coalesce(F.try_divide(F.col("target") * F.col("n_blocks"), F.col("source_size")), F.lit(0.0)))
    per = per.withColumn("shards", F.ceil(F.sum("slots").over(whole) / F.lit(SHARD)).cast("long"))
    per = per.withColumn("mean", F.coalesce(F.try_divide("slots", "shards"), F.lit(0.0))).withColumn("sure", F.floor("mean").cast("long"))
    per = per.withColumn("part", F.floor((F.col("mean") - F.col("sure")) * F.lit(float(UNIT))).cast("long"))
    return per.select(
        "source", "rank", "source_size", "target", "n_blocks", "shards", "sure", "part",
        F.sum("part").over(Window.orderBy("rank")).alias("part_end"), F.sum("part").over(whole).alias("parts"), (F.lit(repeat) * F.col("n_blocks")).alias("most"),
    )


def prefix_sum(rows: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all smaller ``at`` (distinct numbers) of its ``keys``.

    Groups of ``GROUP`` numbers are summed first, so a key with very many rows is spread over its groups.
    """
    rows = rows.withColumn("_g", F.expr(f"{at} div {GROUP}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(*keys, "_g").agg(F.sum(value).alias("_s"))
    groups = groups.withColumn("_b", F.coalesce(F.sum("_s").over(before(Window.partitionBy(*keys).orderBy("_g"))), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy(*keys, "_g").orderBy(at))), F.lit(0))
    rows = rows.withColumn("_i", inside).alias("x")
    same = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "_g"]])
    return rows.join(groups.alias("y"), same).select("x.*", (F.col("_i") + F.col("_b")).alias(name)).drop("_g", "_i")


def shard_counts(sources: DataFrame) -> DataFrame:
    """The draw: slots ``c`` of each source in each output shard, as (rank, n_blocks, most, shard, c)."""
    spark = sources.sparkSession
    groups = F.explode(F.sequence(F.lit(0), F.expr(f"(shards - 1) div {GROUP}"))).alias("g")
    rows = sources.where("shards > 0 AND n_blocks > 0").select("*", groups).repartition(buckets(spark), "rank", "g")
    lo = F.col("g") * F.lit(GROUP)
    rows = rows.withColumn("shard", F.explode(F.sequence(lo, F.least(lo + F.lit(GROUP), F.col("shards")) - 1)))
    (a, b, c), (d, _, _) = _constants(1, SEED + 11), _constants(2, SEED + 11)

    def hit(r: Column) -> Column:
        y = (((F.col("shard") * F.lit(4099) + r) % PRIME) * a + b) % PRIME
        u = ((y * y) % PRIME * c + d) % PRIME % F.greatest("parts", F.lit(1))
        return (u >= F.col("part_end") - F.col("part")) & (u < F.col("part_end"))

    draws = F.expr(f"(parts + {UNIT // 2}) div {UNIT}")
    numbers = F.when(draws > 0, F.sequence(F.lit(0).cast("long"), draws - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.select("rank", "n_blocks", "most", "shard", (F.col("sure") + F.size(F.filter(numbers, hit))).alias("c"))


def slot_table(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: one row per slot with (shard, rank, k, block)."""
    counts = prefix_sum(shard_counts(sources), ["rank"], "shard", "c", "first")
    end = F.least(F.col("first") + F.col("c"), F.col("most"))
    # few rows make very many: dealt by a number of partitions that is not lowered to the rows' size
    counts = counts.where(end > F.col("first")).repartition(buckets(sources.sparkSession), "rank", "shard")
    slots = counts.withColumn("k", F.explode(F.sequence(F.col("first"), end - 1)))
    return slots.select("shard", "rank", "k", permute(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), seed + 1, F.col("rank")).alias("block"))


def packed(rows: DataFrame, sources: DataFrame, n_rows: int, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Rows with their source's figures and ``off``, the place of their first word in its stream.

    ``rows``: source, doc_id, size and further ``keys``. Equal rows are counted first and laid out
    as a run, so that copies of one row, however many, are one row in the window.
    """
    nb = n_rows // bucket + 1
    a, b, _ = _constants(0, SEED + 7)
    runs = rows.groupBy("source", "doc_id", "size", *keys).agg(F.count(F.lit(1)).alias("copies"))
    runs = runs.withColumn("bucket", F.pmod((F.pmod(F.coalesce("doc_id", "size"), F.lit(PRIME)) * F.lit(a) + F.lit(b)) % PRIME, F.lit(nb)))
    words = F.col("copies") * F.col("size")
    starts = prefix_sum(runs.groupBy("source", "bucket").agg(F.sum(words).alias("w")), ["source"], "bucket", "w", "start")
    inside = Window.partitionBy("source", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("off", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    s, t = starts.alias("s"), sources.alias("t")
    runs = runs.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    runs = runs.join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
    return runs.select(
        "r.source", "r.doc_id", "r.size", *[f"r.{k}" for k in keys], "t.rank", "t.source_size", "t.target",
        F.explode(F.sequence(F.lit(0), F.col("r.copies") - 1)).alias("copy"), (F.col("s.start") + F.col("r.off")).alias("run"),
    ).withColumn("off", F.col("run") + F.col("copy") * F.col("size")).drop("run")


def taken_pieces(docs: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents joined with the blocks that hold their words: (start, words, times) per piece."""
    usage = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.expr(f"(off + size - 1) div {block}")
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"off div {block}"), last))
    pieces = docs.withColumn("block", F.explode_outer(blocks))
    lo = F.greatest(F.col("off"), F.col("block") * F.lit(block))
    hi = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * F.lit(block))
    pieces = pieces.withColumn("start", lo - F.col("off")).withColumn("words", hi - lo)
    # Spark takes generated rows for few: without the hint it would broadcast all blocks
    return pieces.join(usage.hint("merge"), ["rank", "block"], "left")


def _base(docs: DataFrame, keys: dict) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *[v.alias(k) for k, v in keys.items()])


def mix(docs: DataFrame, block: int = BLOCK, keys: dict | None = None, weights=WEIGHTS, repeat: int = REPEAT):
    """(packed documents with offsets, sources, slots) of the mix of ``docs``."""
    base = save(_base(docs, keys or {}), "mix-sizes")
    sources = save(source_table(base.select("source", F.col("size").alias("words")), weights, repeat, block), "mix-sources")
    slots = slot_table(sources)
    return packed(base, sources, base.count(), list(keys or {})), sources, slots


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken, the words the mix takes of it."""
    rows, _, slots = mix(docs, block)
    pieces = taken_pieces(rows, slots, block)
    keys = ["doc_id", "source", "rank", "size", "source_size", "target", "off", "copy"]
    out = pieces.groupBy(*keys).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document of which the mix takes ``t`` words comes as up to three rows: row ``c`` has the
    words of its blocks that were drawn at least ``c`` times, in their order, joined by a space
    (the text as it stands if that is all its words). What is drawn no time goes.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    others = [at[c] for c in docs.columns if c not in ("doc_id", "source", "text", "n_chars")]
    base = docs.toDF(*names)
    base = base.select("*", F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"))
    base = base.withColumn("hash", F.xxhash64("text", *others))
    rows, _, slots = mix(base, block, {"hash": F.col("hash")})
    pieces = taken_pieces(rows, slots, block).where("times > 0")
    per = pieces.groupBy("doc_id", "source", "size", "hash", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "words", "times"))).alias("pieces"))
    # one row of equal ones is enough: each of their packed copies is a row of ``per``
    texts = base.withColumn("size", n_words(F.col("text"))).dropDuplicates(["doc_id", "source", "size", "hash"])
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in ("doc_id", "source", "size", "hash")]
    both = texts.alias("d").join(per.alias("p"), reduce(lambda a, b: a & b, same))
    both = both.select("d.*", "p.pieces", F.explode(F.sequence(F.lit(1), F.array_max(F.col("p.pieces.times")))).alias("nth"))
    both = both.withColumn("pieces", F.filter("pieces", lambda p: p["times"] >= F.col("nth")))
    got = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    part = F.concat_ws(" ", F.flatten(F.transform("pieces", lambda p: F.slice(words, (p["start"] + 1).cast("int"), p["words"].cast("int")))))
    both = both.withColumn(at["text"], F.when(got == F.col("size"), F.col("text")).otherwise(part))
    if "n_chars" in at:
        both = both.withColumn(at["n_chars"], F.char_length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return both.select(*names).toDF(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_permute(x: str, n: str, seed: int, key: str, source: str, keep: str) -> str:
    """The same rounds in SQL, one nested select a round."""
    sql = f"SELECT {keep}, {x} AS x, {n} AS n, {key} AS key FROM {source}"
    for r in range(ROUNDS):
        a, b, k = _constants(r, seed)
        sql = f"SELECT {keep}, n, key, x, ((key + 1) * {k}) % {PRIME} % n AS p FROM ({sql})"
        sql = f"SELECT {keep}, n, key, x, CASE WHEN p >= x THEN p - x ELSE p - x + n END AS o FROM ({sql})"
        sql = f"SELECT {keep}, n, key, CASE WHEN ((greatest(x, o) % {PRIME}) * {a} + {b}) % {PRIME} >= {PRIME // 2} THEN o ELSE x END AS x FROM ({sql})"
    return sql


def oracle() -> str:
    a, b, _ = _constants(0, SEED + 7)
    (a1, b1, c1), (d1, _, _) = _constants(1, SEED + 11), _constants(2, SEED + 11)
    return f"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
nb AS (SELECT count(*) // {BUCKET} + 1 AS nb FROM base),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM base GROUP BY source),
w AS (SELECT *, (1 + rank % 3)::DOUBLE AS w, 3.0::DOUBLE * source_size AS ceiling FROM per),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w,
  (sum(source_size) OVER ())::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ceiling / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw FROM w),
g AS (SELECT *, l * w > ceiling * lw AS is_full FROM f),
h AS (SELECT *, sum(CASE WHEN is_full THEN ceiling ELSE 0 END) OVER () AS fc, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS fw FROM g),
t AS (SELECT *, CASE WHEN is_full THEN ceiling ELSE (total - fc) * w / nullif(all_w - fw, 0) END AS target, ceil(source_size / {BLOCK}.0)::BIGINT AS n_blocks FROM h),
sl AS (SELECT *, coalesce(target * n_blocks / nullif(source_size, 0), 0) AS slots FROM t),
sh AS (SELECT *, ceil(sum(slots) OVER () / {SHARD})::BIGINT AS shards FROM sl),
me AS (SELECT *, coalesce(slots / nullif(shards, 0), 0) AS mean FROM sh),
pa AS (SELECT *, floor(mean)::BIGINT AS sure, floor((mean - floor(mean)) * {UNIT})::BIGINT AS part FROM me),
s AS (SELECT *, (sum(part) OVER (ORDER BY rank))::BIGINT AS part_end, (sum(part) OVER ())::BIGINT AS parts FROM pa),
dr AS (SELECT shard, unnest(range((parts + {UNIT // 2}) // {UNIT})) AS r, parts FROM (SELECT unnest(range(shards)) AS shard, parts FROM (SELECT DISTINCT shards, parts FROM s))),
dy AS (SELECT shard, parts, (((shard * 4099 + r) % {PRIME}) * {a1} + {b1}) % {PRIME} AS y FROM dr),
du AS (SELECT (y * y % {PRIME} * {c1} + {d1}) % {PRIME} % greatest(parts, 1) AS u FROM dy),
dn AS (SELECT rank, count(u) AS drawn FROM s LEFT JOIN du ON u >= part_end - part AND u < part_end GROUP BY rank),
k AS (SELECT rank, n_blocks, unnest(range(least(3 * n_blocks, sure * shards + drawn))) AS k FROM s JOIN dn USING (rank)),
blocks AS ({_sql_permute("k % n_blocks", "n_blocks", SEED + 1, "rank", "k", "rank")}),
usage AS (SELECT rank, x AS block, count(*) AS times FROM blocks GROUP BY ALL),
o AS (SELECT b.*, s.rank, s.source_size, s.target, coalesce(sum(b.size) OVER (PARTITION BY b.source
    ORDER BY ((((coalesce(doc_id, b.size) % {PRIME}) + {PRIME}) % {PRIME}) * {a} + {b}) % {PRIME} % nb.nb, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM base b CROSS JOIN nb JOIN s ON b.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, CASE WHEN size > 0 THEN unnest(CASE WHEN size > 0 THEN range(off // {BLOCK}, (off + size - 1) // {BLOCK} + 1) ELSE [-1] END) END AS block FROM o)
SELECT doc_id, p.size, p.source_size, p.target,
  coalesce(sum((least(off + p.size, (p.block + 1) * {BLOCK}) - greatest(off, p.block * {BLOCK})) * times), 0)::BIGINT AS taken
FROM p LEFT JOIN usage u ON u.rank = p.rank AND u.block = p.block
GROUP BY doc_id, p.source, p.size, p.source_size, p.target, off"""
