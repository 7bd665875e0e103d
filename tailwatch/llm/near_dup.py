"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of ``ngram`` words (A-Z lower-cased), or its whole
word sequence as one shingle if it has fewer. ``BANDS * ROWS`` minima are taken of the set. Bands of
``ROWS`` full minima generate the candidates; of each minimum the low ``BITS`` bits stay, packed
into longs, and the number of equal fields, corrected for chance collisions, estimates the
similarity of a candidate pair. Pairs whose estimate is far below the threshold go (a real link does with
a chance of at most ``MISS``); what remains is confirmed on the full sets with whole numbers.

No step makes all pairs of a group. Equal sets are one node. Every bucket of a band links its
members to one leader, the least node, so that nearly all buckets lie in one component after the
first round. In the second, only members outside their bucket's largest component are compared: with
that component's members, and with each other. This checks every candidate pair that could still
join two components, so the components are those of the full link graph. Components come from the
large-star / small-star iteration on distributed edge tables in the shared folder.

Cases: documents without words or text link with nothing and are kept; rows with a null ``doc_id``
take no part and are kept; rows with one ``doc_id`` are one document, whose sets are all its own; extra
columns are ignored by :func:`components` and kept by :func:`deduplicated`; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import buckets, drop, read, save, small_batches

BANDS, ROWS, BITS = 32, 4, 4
K = BANDS * ROWS
#: Longs of a packed signature.
PACKED = K * BITS // 64
#: Edges of a partition while components are joined, and parts of a node's neighbours.
EDGES, SALTS = 100_000, 64
#: Bits of the filter that spares texts the shuffle: 1 MB.
FILTER_BITS = 2**23
#: Nodes of a component that are compared in one part.
PART = 256
#: Chance that the estimate drops a pair right at the threshold.
MISS = 1e-7
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, ngram: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(ngram, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc ^= h[j : j + n]
        acc *= _ODD
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


@lru_cache(None)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    draw = lambda n, high, kind: rng.integers(0, high, n, dtype=kind)
    return draw(K, 2**32 - 1, np.uint32), draw(K, 2**32 - 1, np.uint32) | np.uint32(1), draw(BANDS, 2**63 - 1, np.int64).astype(np.uint64)


def minima(grams: np.ndarray) -> np.ndarray:
    """The least value of each of the K hash functions over a set."""
    flip, times, _ = _functions()
    h = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 2**32 - 1, np.uint32)
    for i in range(0, len(h), 512):
        block = (h[i : i + 512, None] ^ flip) * times
        np.minimum(out, block.min(axis=0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band, of all its minima."""
    key = _functions()[2].copy()
    for part in low.reshape(BANDS, ROWS).T:
        key ^= part
        key *= _ODD
        key ^= key >> np.uint64(31)
    return key


def pack(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, packed into longs."""
    fields = (low & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(PACKED, 64 // BITS)
    return np.bitwise_or.reduce(fields << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def _fingerprint(grams: np.ndarray) -> int:
    return xxh3_64_intdigest(grams.tobytes()) - 2**63


SIGNATURE = "doc_id long, n long, fp long, bands array<bigint>, " + ", ".join(f"s{i} long" for i in range(PACKED))


def _signatures(ngram: int):
    def run(batches):
        for b in batches:
            ids, n, fps, bands, packed = b.column(0), [], [], [], []
            for doc, text in zip(ids.to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                grams = shingle_set(text, ngram)
                n.append(len(grams))
                if not len(grams) or doc is None:
                    fps.append(None), bands.append(None), packed.append([None] * PACKED)
                    continue
                low = minima(grams)
                fps.append(_fingerprint(grams))
                bands.append(band_keys(low).view(np.int64))
                packed.append(pack(low).view(np.int64).tolist())
            cols = [pa.array(c, pa.int64()) for c in zip(*packed)] if packed else [pa.array([], pa.int64())] * PACKED
            arrays = [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *cols]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "fp", "bands", *[f"s{i}" for i in range(PACKED)]])

    return run


def _grams(ngram: int):
    def run(batches):
        for b in batches:
            want, grams = b.column(0).to_pylist(), []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                grams.append(shingle_set(text, ngram))
            rows = [(w, g.view(np.int64)) for w, g in zip(want, grams) if len(g) and _fingerprint(g) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.int64()), pa.array([g for _, g in rows], pa.list_(pa.int64()))], ["fp", "grams"])

    return run


@lru_cache(None)
def least_equal(percent: int) -> int:
    """Least number of equal fields that a pair at the threshold has but for a chance of MISS."""
    p = 2.0**-BITS + (1 - 2.0**-BITS) * percent / 100
    total = 0.0
    for m in range(K + 1):
        total += math.comb(K, m) * p**m * (1 - p) ** (K - m)
        if total > MISS:
            return m
    return K


def similarity(equal: int) -> float:
    """The estimate from the number of equal fields, corrected for collisions."""
    return (equal / K - 2.0**-BITS) / (1 - 2.0**-BITS)


def _different(a: str, b: str) -> Column:
    """Number of fields that differ between two packed signatures."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    total = F.lit(0)
    for i in range(PACKED):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        shift = 1
        while shift < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def _plausible(a: str, b: str, percent: int) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (_different(a, b) <= K - least_equal(percent))


def _linked(a: str, b: str, percent: int) -> Column:
    """100 * intersection >= percent * union, on the full sets."""
    both = F.size(F.array_intersect(f"{a}.grams", f"{b}.grams"))
    return both * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), the root being its component's least node.

    Rounds of large-star and small-star, each over as many partitions as its edges fill. A node's greater
    neighbours, which may be very many, are dealt over ``SALTS`` parts: each part has its own least, and the least of
    these comes back to every part. A node has few smaller neighbours, at most one for each band at first.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = save(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        n = -(-2 * state[0] // EDGES)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS))).repartition(n, "u", "s")
        part = both.groupBy("u", "s").agg(F.min("v").alias("m")).repartition(n, "u")
        least = F.least("u", F.min("m").over(Window.partitionBy("u")))
        part = part.select("u", "s", least.alias("m")).repartition(n, "u", "s")
        large = both.where("v > u").join(part.hint("merge"), ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.repartition(n, "u").withColumn("m", F.min("v").over(Window.partitionBy("u")))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")
        pairs = small.select(pairs).select("e.u", F.col("e.m").alias("v")).where("u <> v")
        after = save(pairs.repartition(n, "u", "v").distinct(), "edges")
        drop(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return now.toDF("node", "root").union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of edges."""
    mark = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(mark, 24)), F.bit_xor(mark)).first()
    return tuple(row)


def components(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n (size of its set) and component (null for a null doc_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = save(docs.select("doc_id", "text").mapInArrow(_signatures(ngram), SIGNATURE), "signatures")
    sig = [f"s{i}" for i in range(PACKED)]
    nodes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ["n", *sig, "bands"]])
    nodes = save(nodes, "nodes")

    banded = nodes.select("fp", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = save(banded.join(leaders.drop("members"), "key"), "members")
    several = rows.where("fp IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("x")).where("b < x")
    if members.isEmpty() and several.isEmpty():
        parts = nodes.select("fp", F.col("doc").alias("component"))
    else:
        parts = _merged(docs, rows, nodes.drop("bands"), members, several, ngram, percent)
    parts = save(parts, "components")
    out = rows.select("doc_id", "n", "fp").join(parts, "fp", "left")
    return out.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))


def _merged(docs, rows, nodes, members, several, ngram: int, percent: int) -> DataFrame:
    wanted = members.select("fp").distinct().join(nodes, "fp").select(F.col("fp").alias("want"), "doc")
    wanted = save(wanted, "wanted")
    maybe = _maybe(docs.select("doc_id", "text"), wanted)
    texts = wanted.join(maybe, F.col("doc") == F.col("doc_id")).select("want", "text")
    grams = texts.mapInArrow(_grams(ngram), "fp long, grams array<bigint>")
    sets = save(grams.dropDuplicates(["fp"]).join(nodes.drop("doc"), "fp"), "sets")
    drop(wanted)

    # first round: each member with the leader of its bucket
    pairs = members.where("fp <> leader").select("fp", "leader").distinct()
    light = nodes.drop("doc")
    pairs = pairs.join(light.alias("a"), "fp").join(light.withColumnRenamed("fp", "leader").alias("b"), "leader")
    pairs = save(pairs.where(_plausible("a", "b", percent)).select("fp", "leader"), "pairs")
    first = _confirmed(pairs.toDF("a", "b"), sets, percent)
    # rows with one doc_id are one document, also where no set shares a band
    same = rows.where("fp IS NOT NULL").join(several, "doc_id").select(F.col("fp").alias("a"), "b")
    roots = connected(first.union(same))
    drop(pairs)

    # second round: members outside the largest component of their bucket
    placed = members.select("key", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = save(placed.select("key", "fp", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("grouped")), "placed")
    per = placed.groupBy("key", "root", "grouped").count()
    mixed = per.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"),
        F.max(F.when(F.col("grouped"), F.struct("count", "root"))).alias("main"),
    ).where("roots > 1").select("key", F.col("main.root").alias("main"))
    rest = save(placed.join(mixed, "key").where("main IS NULL OR root <> main").select("key", "fp", "root", "main"), "rest")
    second = _second(rest, roots, sets, percent)
    tops = connected(second)
    merged = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("top"))
    merged = merged.union(tops.select("node", F.col("root").alias("top"))).distinct()
    final = nodes.select("fp", "doc").join(merged.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", F.coalesce("top", "fp").alias("top"))
    final = save(final, "tops")
    least = final.groupBy("top").agg(F.min("doc").alias("component"))
    return final.join(least, "top").select("fp", "component")


def _maybe(docs: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` without most of those that are not ``wanted``, by a bitmap of hashed ids.

    The bitmap's size is fixed, so it can be broadcast: it spares most texts the shuffle as long as
    the wanted ids are fewer than its bits, and lets all pass, still rightly, where they are many more.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = wanted.select(place("doc").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    at = F.bitmap_bit_position(place("doc_id")).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("map"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.join(F.broadcast(maps), F.bitmap_bucket_number(place("doc_id")) == F.col("bucket"))
    return found.where(F.floor(byte / F.pow(F.lit(2), at.bitwiseAND(F.lit(7)))) % 2 == 1).select("doc_id", "text")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    x = pairs.join(sets.select(F.col("fp").alias("a"), "n", "grams"), "a").alias("x")
    y = sets.select(F.col("fp").alias("b"), "n", "grams").alias("y")
    return x.join(y, (F.col("x.b") == F.col("y.b")) & _linked("x", "y", percent)).select("x.a", "x.b")


def _salted(few: DataFrame, many: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, many) with their sets, dealt by (main, salt): the ``many`` of a component in parts of about
    ``PART`` nodes, and the ``few`` beside it with each part. So no key is large, at any size of a component."""
    n = buckets(sets.sparkSession)
    parts = many.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts"))
    left = few.join(parts, "main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = many.join(parts, "main").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    return tuple(d.drop("parts").join(sets, "fp").repartition(n, "main", "salt").alias(name) for d, name in ((left, "x"), (right, "y")))


def _together(percent: int, first: Column | None = None) -> Column:
    same = (F.col("x.main") == F.col("y.main")) & (F.col("x.salt") == F.col("y.salt"))
    if first is not None:
        same = same & first
    return same & _plausible("x", "y", percent) & _linked("x", "y", percent)


def _second(rest: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, as pairs of roots (a, b)."""
    # with the bucket's largest component: the condition is inside the join, so only links come out
    alone = rest.where("main IS NOT NULL").select("fp", "root", "main").distinct()
    mains = alone.select("main").distinct()
    inside = mains.join(roots.select("node", F.col("root").alias("main")), "main").select(F.col("node").alias("fp"), "main")
    inside = inside.union(mains.select("main", "main")).distinct()
    x, y = _salted(alone, inside, sets)
    one = y.join(x, _together(percent)).select(F.col("x.root").alias("a"), F.col("x.main").alias("b"))
    # with each other, where they lie beside the same component: again only links come out
    x, y = _salted(alone, alone, sets)
    apart = (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root"))
    beside = y.join(x, _together(percent, apart)).select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    # and in buckets without any component yet, by their candidate pairs
    light = rest.where("main IS NULL").select("key", "fp", "root").join(sets.drop("grams"), "fp")
    x, y = light.alias("x"), light.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root"))
    pairs = x.join(y, apart & _plausible("x", "y", percent)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb")).distinct()
    pairs = save(pairs, "pairs")
    two = _confirmed(pairs.select("a", "b"), sets, percent).join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return one.union(beside).union(two)


def deduplicated(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id, and of rows with the
    same doc_id the least. Rows with a null doc_id stay."""
    found = components(docs, ngram, percent)
    gone = save(found.where("doc_id <> component").select("doc_id").distinct(), "removed")
    stay = docs.join(gone, "doc_id", "left_anti")
    again = save(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    once = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("r"))
    return stay.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select("doc_id", "r.*").select(*docs.columns))


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    found = components(read(spark, sf_dir, "documents"), ngram=4, percent=80)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))


def oracle() -> str:
    """All pairs that share a shingle, and reachability by recursion: for small tables."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i+3], ' ')))
   WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id"""
