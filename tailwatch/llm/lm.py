"""Language-model scores: a word unigram base, and causal self-attention over subword ids.

The corpus is read once, in chunks of one input split that end at about ``CHUNK_DOCS`` documents or
``CHUNK_BYTES`` bytes. A chunk gives its documents as numbers of its own distinct words, and those words with their
number in its training documents; both are one written table, so they agree whatever executor is lost. Counts summed
over chunks make the lexicon, in which each distinct word is encoded once; a join by word brings counts and pieces
back to every chunk, whose documents become packed pieces, which the fit and the scores read. All counts cover all
training documents, and nothing that grows with the corpus is broadcast or collected.

The model predicts the class of the next piece (``CLASSES`` classes of equal mass, word starts apart)
by one head of causal attention in numpy, and from the same output the piece within its class, by binary decisions
along its Huffman code among the class's pieces (``Codes``), which begin at the pieces' counts. Windows of
``WINDOW`` positions overlap by ``OVERLAP``, so each token is scored once, with at least that much context inside a
document. Its weights are fitted in one pass over adjoining windows of all training documents: a replica for each input
split, in ``ROUNDS`` rounds over parts of the documents, after each of which the replicas' weights are averaged.

Cases: a null or blank text is its end token alone; a null doc_id is not held out; repeated rows
count and are scored each; an empty table gives an empty result; without any training document all
counts are 0, nothing is fitted and the model is the prior of its classes; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces
from .common import drop, read, save, small_batches

CHUNK_DOCS, CHUNK_BYTES = 16384, 64 << 20
CLASSES, SINGLE, DIM = 32, 960, 8
WINDOW, OVERLAP = 32, 8
#: Rounds of averaging, windows of a step, and the step's size.
ROUNDS, BATCH, RATE = 2, 64, 0.01
#: Fixed values of the model file: begin and end of a text.
BOS, EOS = 1, 2


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts in one array, A-Z lower-cased, and the number of each text's."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    lists = pc.ascii_split_whitespace(texts)
    n = np.where(pc.binary_length(texts).to_numpy() > 0, pc.list_value_length(lists).to_numpy(), 0)
    words = lists.flatten()
    return words.filter(pc.greater(pc.binary_length(words), 0)).cast(pa.binary()), n


def _chunked(batches):
    """Chunks of documents: a row per document with the numbers of its words, and a row per distinct word with its number
    and its count in the chunk's training documents."""
    from pyspark import TaskContext

    chunk, docs, size = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        docs.append((b.column(0), b.column(1), *split_words(b.column(2))))
        size += docs[-1][2].nbytes
        if sum(len(d[0]) for d in docs) >= CHUNK_DOCS or size >= CHUNK_BYTES:
            yield from _chunk(chunk, docs)
            chunk, docs, size = chunk + 1, [], 0
    yield from _chunk(chunk, docs)


def _chunk(chunk: int, docs: list):
    if not docs:
        return
    ids, held, words, sizes = zip(*docs)
    numbered = pa.chunked_array(words).combine_chunks().dictionary_encode()
    del words
    numbers, sizes = numbered.indices.to_numpy().astype(np.uint32), np.concatenate(sizes)
    learned = np.repeat(~pa.chunked_array(held).to_numpy(), sizes)
    counts = np.bincount(numbers[learned], minlength=len(numbered.dictionary))
    data, ends = numbers.tobytes(), 4 * np.cumsum([0, *sizes])
    at = 0
    for doc_ids, flags in zip(ids, held):
        n = len(doc_ids)
        packs = [data[i:j] for i, j in zip(ends[at : at + n].tolist(), ends[at + 1 : at + n + 1].tolist())]
        yield _rows(chunk, at, n, doc_id=doc_ids, held_out=flags, words=pa.array(packs, pa.binary()))
        at += n
    for i in range(0, len(counts), 20_000):
        part = numbered.dictionary.slice(i, 20_000)
        yield _rows(chunk, i, len(part), word=part, n=pa.array(counts[i : i + len(part)]))


def _rows(chunk: int, first: int, rows: int, **columns) -> pa.RecordBatch:
    given = {"chunk": pa.array(np.full(rows, chunk)), "no": pa.array(np.arange(first, first + rows))} | columns
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(rows, f.type)) for f in CHUNKS], schema=CHUNKS)


CHUNKS = pa.schema([("chunk", pa.int64()), ("no", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.binary())])


def piece_ids(words: list[bytes], codec: pieces.Codec) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of words, packed, and each word's offsets."""
    text = [w.decode() for w in words]
    return codec.encode_packed(text)


class Classes:
    """Classes of pieces from their counts: output classes of equal mass, input rows by rank."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        mass = counts + 0.1
        order = np.lexsort((np.arange(len(mass)), -mass))
        self.out = np.zeros(len(mass), np.int16)
        halves = [order[starts[order]], order[~starts[order]]]
        share = [mass[h].sum() for h in halves]
        first = 0
        for h, s in zip(halves, share):
            n = max(1, min(CLASSES - 1, round(CLASSES * s / sum(share)))) if h is halves[0] else CLASSES - first
            place = (np.cumsum(mass[h]) - mass[h] / 2) / max(s, 1e-9)
            self.out[h] = first + np.minimum((place * n).astype(int), n - 1)
            first += n
        per = np.bincount(self.out, weights=mass, minlength=CLASSES)
        self.within = np.log10(mass / per[self.out]).astype(np.float32)
        self.into = (SINGLE + self.out).astype(np.int16)
        self.into[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
        self.prior = np.log(np.maximum(per, 1e-9) / per.sum()).astype(np.float32)
        self.codes = Codes(mass, counts > 0, self.out)


class Codes:
    """Huffman codes of the pieces of each class: a piece is the decisions ``step[first[i] : first[i] + size[i]]``, each
    a ``node`` and the side taken there; ``odds`` are the nodes' log-odds by count.

    Pieces that no training text has are one leaf of their class and alike below it, as no fit could tell them apart.
    """

    def __init__(self, mass: np.ndarray, seen: np.ndarray, out: np.ndarray):
        n, leaf, ahead, odds = len(mass), np.arange(len(mass)), [], []
        self.rest = np.zeros(n, np.float32)
        up, side = np.full(2 * n, -1), np.zeros(2 * n, np.float32)
        for c in range(CLASSES):
            unseen = np.flatnonzero((out == c) & ~seen)
            heap = [(mass[i], i) for i in np.flatnonzero((out == c) & seen).tolist()]
            if len(unseen):
                heap.append((mass[unseen].sum(), int(unseen[0])))
                leaf[unseen], self.rest[unseen] = unseen[0], np.log(mass[unseen] / mass[unseen].sum())
            heapq.heapify(heap)
            while len(heap) > 1:
                (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
                up[[i, j]], side[[i, j]] = len(odds), (-1, 1)
                heapq.heappush(heap, (a + b, n + len(odds)))
                odds.append(np.log(b / a))
        at, of = np.unique(leaf), np.unique(leaf)
        while len(at := at[up[of] >= 0]):
            of = of[up[of] >= 0]
            ahead.append((at, up[of], side[of]))
            of = n + up[of]
        leaves, self.node, self.side = (np.concatenate(x) for x in zip(*ahead)) if ahead else (np.empty(0, int),) * 3
        order = np.argsort(leaves, kind="stable")
        self.node, self.side = self.node[order], self.side[order].astype(np.float32)
        self.size = np.bincount(leaves, minlength=n)[leaf]
        self.first = np.searchsorted(leaves[order], leaf)
        self.odds = np.array(odds, np.float32)

    def start(self) -> np.ndarray:
        """Weights of the nodes at which only counts decide: DIM of each, then an offset of each."""
        return np.zeros((DIM + 1) * len(self.odds), np.float32)

    def decisions(self, t: tuple[np.ndarray, np.ndarray], h: np.ndarray, target: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """All decisions of the (live) rows' targets: (row, node, side, output of the row, weights of the node, log-odds of the side taken)."""
        size = np.take(self.size, target)
        if live is not None:
            size *= live
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(target)), size)
        step = np.repeat(np.take(self.first, target) - ends + size, size)
        step += np.arange(len(row))
        node, side = np.take(self.node, step), np.take(self.side, step)
        x, y = np.take(h, row, axis=0), np.take(t[0], node, axis=0)
        odds = (x * y) @ np.ones(DIM, h.dtype)
        odds += np.take(t[1] + self.odds, node)
        odds *= side
        return row, node, side, x, y, np.maximum(odds, -60, out=odds)

    def log_within(self, t: tuple[np.ndarray, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural-log probabilities of pieces within their classes, one for each row of outputs."""
        row, *_, odds = self.decisions(t, h, target)
        np.negative(odds, out=odds)
        np.exp(odds, out=odds)
        odds += 1
        return np.take(self.rest, target) - np.bincount(row, weights=np.log(odds, out=odds), minlength=len(target))

    def gradients(self, t: tuple[np.ndarray, np.ndarray], h: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the cross-entropy of live rows' pieces within their classes, by the nodes' weights and by the outputs."""
        row, node, side, x, y, odds = self.decisions(t, h, target, live)
        np.exp(odds, out=odds)
        odds += 1
        odds *= -max(1, int(live.sum()))
        np.divide(side, odds, out=odds)
        x *= odds[:, None]
        y *= odds[:, None]
        by_node = [np.bincount(node, weights=v, minlength=len(t[1])) for v in (*x.T, odds)]
        by_row = np.zeros_like(h)
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # a row's decisions adjoin
            by_row[row[first]] = np.add.reduceat(y, first, axis=0)
        return np.concatenate([np.stack(by_node[:-1], 1).ravel(), by_node[-1]]).astype(h.dtype), by_row


SHAPES = (("E", (SINGLE + CLASSES, DIM)), ("P", (WINDOW, DIM)), ("q", (DIM, DIM)), ("k", (DIM, DIM)), ("v", (DIM, DIM)), ("o", (DIM, DIM)), ("c", (DIM, CLASSES)), ("b", (CLASSES,)))
_CAUSAL = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)
_LN10 = np.float32(np.log(10))


def fresh(prior: np.ndarray, seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    w = {n: rng.normal(0, 0.25 if n in "EP" else DIM**-0.5, s).astype(np.float32) for n, s in SHAPES}
    w["c"] *= 0.1
    w["b"] = prior.copy()
    return w


def packed(w: dict) -> bytes:
    return b"".join(w[n].astype(np.float32).tobytes() for n, _ in SHAPES)


def unfitted(prior: np.ndarray) -> dict:
    """Weights of a model that is ``prior`` after any text."""
    w = fresh(prior)
    w["c"][:] = 0
    return w


def unpacked(data: bytes) -> dict:
    return _views(np.frombuffer(data, np.float32).copy())


def _views(flat: np.ndarray) -> dict:
    """The weights as parts of one array."""
    ends = np.cumsum([np.prod(s) for _, s in SHAPES])
    return {n: x.reshape(s) for (n, s), x in zip(SHAPES, np.split(flat, ends))}


def of_nodes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """What of packed weights are those of the codes' nodes; None where there are none, so that counts decide within a class."""
    flat = flat[sum(np.prod(s) for _, s in SHAPES) :]
    n = len(flat) // (DIM + 1)
    return (flat[: n * DIM].reshape(n, DIM), flat[n * DIM :]) if n else None


def forward(w: dict, x_in: np.ndarray, since: int = 0) -> dict:
    """Masked attention over windows of input rows (n, WINDOW), with outputs of the places from ``since`` on."""
    n, kind, places = len(x_in), w["E"].dtype, WINDOW - since
    x = np.take(w["E"], x_in, axis=0)
    x += w["P"]
    flat = x.reshape(-1, DIM)
    late = x[:, since:].reshape(-1, DIM)
    q = (late @ (w["q"] * kind.type(DIM**-0.5))).reshape(n, places, DIM)
    k = (flat @ w["k"]).reshape(n, WINDOW, DIM)
    v = np.empty((n, WINDOW, DIM + 1), kind)
    v[:, :, :DIM] = (flat @ w["v"]).reshape(n, WINDOW, DIM)
    v[:, :, DIM] = 1  # so that the product with the weights ends in their sum
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += _CAUSAL[since:].astype(kind, copy=False)
    np.exp(_bounded(a), out=a)
    o = np.matmul(a, v).reshape(-1, DIM + 1)
    sums = np.maximum(o[:, DIM:], 1e-30)
    o = o[:, :DIM] / sums
    return {"x": flat, "q": q, "k": k, "v": v, "a": a, "sums": sums, "o": o, "h": late + o @ w["o"]}


def _exponents(w: dict, h: np.ndarray) -> np.ndarray:
    z = h @ w["c"]
    z += w["b"]
    return _bounded(z)


def _bounded(z: np.ndarray) -> np.ndarray:
    """At most 60, in place; the largest value is found faster than all are compared."""
    return np.minimum(z, 60, out=z) if z.max(initial=0) > 60 else z


def log_classes(w: dict, h: np.ndarray) -> np.ndarray:
    """Natural-log probabilities of the classes."""
    z = _exponents(w, h)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_targets(w: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The same, of one class for each row."""
    z = _exponents(w, h)
    got = z.ravel()[np.arange(0, z.size, CLASSES) + target]
    return got - np.log(np.exp(z, out=z) @ np.ones(CLASSES, z.dtype))


def gradients(w: dict, x_in: np.ndarray, target: np.ndarray, live: np.ndarray, below=None) -> dict:
    """Of the mean cross-entropy of the ``live`` positions' target classes, and with ``below`` (codes, their nodes'
    weights, target pieces) of the pieces within them; those by the nodes' weights are ``t``."""
    f = forward(w, x_in)
    n, kind = len(x_in), w["E"].dtype
    z = _exponents(w, f["h"])
    np.exp(z, out=z)
    share = live.ravel().astype(kind)[:, None] / max(1, int(live.sum()))
    z *= share / (z @ np.ones((CLASSES, 1), kind))
    z.ravel()[np.arange(0, z.size, CLASSES) + target.ravel()] -= share[:, 0]
    g = {"c": f["h"].T @ z, "b": np.ones(len(z), kind) @ z}
    dh = z @ w["c"].T
    if below is not None:
        codes, t, ids = below
        g["t"], by_row = codes.gradients(t, f["h"], ids.ravel(), live.ravel())
        dh += by_row
    g["o"] = f["o"].T @ dh
    do = dh @ w["o"].T
    do /= f["sums"]
    # the mean of a row's gradients under its weights is the product with its output; beside ones it is subtracted
    inner = np.empty((n, WINDOW, DIM + 1), kind)
    inner[:, :, :DIM] = do.reshape(n, WINDOW, DIM)
    inner[:, :, DIM] = -((do * f["o"]) @ np.ones(DIM, kind)).reshape(n, WINDOW)
    ds = np.matmul(inner, f["v"].transpose(0, 2, 1))
    ds *= f["a"]
    # products of their own, put together after: into parts of one array they take half as long again
    parts = [np.matmul(ds, f["k"] * kind.type(DIM**-0.5)), np.matmul(ds.transpose(0, 2, 1), f["q"]), np.matmul(f["a"].transpose(0, 2, 1), do.reshape(n, WINDOW, DIM))]
    d = np.concatenate(parts, axis=2).reshape(-1, 3 * DIM)
    g["q"], g["k"], g["v"] = np.split(f["x"].T @ d, 3, axis=1)
    dx = dh  # the residual path
    dx += d @ np.concatenate([w["q"], w["k"], w["v"]], axis=1).T
    g["P"] = dx.reshape(n, WINDOW, DIM).sum(0)
    ids = x_in.ravel().astype(np.intp)
    g["E"] = np.stack([np.bincount(ids, weights=v, minlength=len(w["E"])) for v in dx.T], 1).astype(kind)
    return g


def windows(offsets: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over packed documents of inputs: (first position, first scored place, scored places' end, document) of each.

    Document ``i`` is ``offsets[i]:offsets[i + 1]``: BOS, pieces, EOS. Position ``p`` predicts ``p + 1``. Windows of a
    document begin ``WINDOW - overlap`` positions apart, and all but the first score nothing at their first ``overlap`` places.
    """
    stride = WINDOW - overlap
    inputs = np.diff(offsets) - 1
    per = 1 + np.maximum(0, -(-(inputs - WINDOW) // stride))
    doc = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return offsets[:-1][doc] + nth * stride, np.where(nth > 0, overlap, 0), np.minimum(WINDOW, inputs[doc] - nth * stride), doc


def _cut(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of WINDOW values from each ``first``; ``values`` goes on WINDOW places beyond the last of them."""
    return np.take(values, first[:, None] + np.arange(WINDOW))


def log10_probability(w: dict, classes: Classes, tokens: np.ndarray, offsets: np.ndarray, t: tuple | None = None) -> np.ndarray:
    """log10 probability of each packed document, every token scored once; ``t``: the weights of the codes' nodes."""
    first, lo, hi, doc = windows(offsets)
    more = np.concatenate([tokens, np.zeros(WINDOW + 1, tokens.dtype)])
    into, place = np.take(classes.into, more), np.arange(WINDOW)
    sums = np.zeros(len(first))
    # a document's later windows have outputs of the places that they score alone
    for since in np.unique(lo).tolist():
        of = np.flatnonzero(lo == since)
        for i in range(0, len(of), BATCH):
            part = of[i : i + BATCH]
            p, places = first[part], WINDOW - since
            at = np.flatnonzero(place[since:] < hi[part, None])
            h, ids = forward(w, _cut(into, p), since)["h"], np.take(more, (p + 1 + since)[:, None] + place[:places]).ravel()
            if len(at) < len(h):
                h, ids = np.take(h, at, axis=0), np.take(ids, at)
            ids = ids.astype(np.intp)
            got = log_targets(w, h, np.take(classes.out, ids)) / _LN10
            got += np.take(classes.within, ids) if t is None else classes.codes.log_within(t, h, ids) / _LN10
            sums[part] = np.bincount(at // places, weights=got, minlength=len(p))
    return np.bincount(doc, weights=sums, minlength=len(offsets) - 1)


def _packed_docs(flat: np.ndarray, word_offsets: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """BOS, the pieces of each document's words, EOS; documents as arrays of word numbers."""
    every = np.concatenate(words) if words else np.empty(0, np.int64)
    sizes = (word_offsets[1:] - word_offsets[:-1])[every]
    ends = np.cumsum(np.concatenate([[0], sizes]))
    body = flat[np.repeat(word_offsets[every] - ends[:-1], sizes) + np.arange(ends[-1])]
    edges = ends[np.cumsum([0, *map(len, words)])]
    n = len(words)
    tokens = np.full(len(body) + 2 * n, EOS, np.int32)
    offsets = edges + 2 * np.arange(n + 1)
    tokens[offsets[:-1]] = BOS
    keep = np.ones(len(tokens), bool)
    keep[offsets[:-1]] = keep[offsets[1:] - 1] = False
    tokens[keep] = body
    return tokens, offsets


def _id_type(path: str) -> type:
    return np.uint16 if len(pieces.codec(path).model.pieces) <= 1 << 16 else np.int32


def _joined(packs: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids in one array, and each pack's offsets into it."""
    flat = np.frombuffer(b"".join(packs), kind)
    return flat, np.cumsum([0, *map(len, packs)]) // np.dtype(kind).itemsize


class _Windows:
    """Windows of packed documents, shuffled within a batch: (input rows, target pieces, whether scored)."""

    def __init__(self, path: str, packed_classes: bytes):
        self.path, self.packed_classes = path, packed_classes

    def classes(self) -> Classes:
        return _classes_from(self.packed_classes)

    def __call__(self, batches):
        kind, classes = _id_type(self.path), self.classes()
        rng, place = np.random.default_rng(1), np.arange(WINDOW)
        for b in batches:
            if not b.num_rows:
                continue
            tokens, offsets = _joined(b.column(0).to_pylist(), kind)
            first, _, hi, _ = windows(offsets, overlap=0)
            more = np.concatenate([tokens, np.zeros(WINDOW + 1, tokens.dtype)])
            into, order = np.take(classes.into, more), rng.permutation(len(first))
            for i in range(0, len(order), BATCH):
                o = order[i : i + BATCH]
                yield _cut(into, first[o]), _cut(more, first[o] + 1).astype(np.intp), place < hi[o, None]


_kept_classes: dict = {}


def _classes_from(data: bytes) -> Classes:
    """Classes of a table of counts, built once per worker."""
    key = hash(data)
    if key not in _kept_classes:
        _kept_classes.clear()
        n = len(data) // 9
        _kept_classes[key] = Classes(np.frombuffer(data[: 8 * n], np.float64), np.frombuffer(data[8 * n :], np.bool_))
    return _kept_classes[key]


def _fit(weights: bytes, first: int, cut):
    """One replica's Adam steps over the windows that ``cut`` makes of its partition, from common weights. Its
    targets are pieces if it names their classes, else classes."""
    def run(batches):
        from pyspark import TaskContext

        flat, n, step = np.frombuffer(weights, np.float32).copy(), 0, 0
        w, m, s = _views(flat), np.zeros_like(flat), np.zeros_like(flat)
        t = of_nodes(flat)
        classes = cut.classes() if hasattr(cut, "classes") else None
        for x_in, target, live in cut(batches):
            below = None if t is None else (classes.codes, t, target)
            g = gradients(w, x_in, target if classes is None else np.take(classes.out, target), live, below)
            g = np.concatenate([g[k].ravel() for k in (*(k for k, _ in SHAPES), "t") if k in g])
            step, n = step + 1, n + len(x_in)
            m += np.float32(0.1) * (g - m)
            g *= g
            s += np.float32(0.01) * (g - s)
            size = np.sqrt(s)
            size *= np.float32((1 - 0.99**step) ** -0.5)
            size += np.float32(1e-6)
            np.divide(m, size, out=size)
            size *= np.float32(RATE / (1 + first) / (1 - 0.9**step))
            flat -= size
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["replica", "n", "w"])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    n = table["n"].to_numpy()
    rows = [np.frombuffer(x, np.float32) for x in table["w"].to_pylist()]
    mean = sum(r * (k / n.sum()) for r, k in zip(rows, n)).astype(np.float32)
    return pa.table({"replica": table["replica"][:1], "n": pa.array([int(n.sum())]), "w": pa.array([mean.tobytes()], pa.binary())})


def fitted(data: DataFrame, weights: bytes, cut) -> bytes:
    """Weights after ROUNDS rounds, each over its own part of the rows, which ``cut`` makes windows of."""
    for r in range(ROUNDS):
        part = data.where(F.pmod(F.xxhash64(*data.columns), F.lit(ROUNDS)) == r)
        rows = save(part.mapInArrow(_fit(weights, r, cut), "replica long, n long, w binary"), "replicas")
        left = rows.count()
        while left > 32:
            left = -(-left // 32)
            rows = save(rows.groupBy(F.pmod("replica", F.lit(left)).alias("g")).applyInArrow(_averaged, "replica long, n long, w binary"), "replicas")
        found = rows.toArrow()
        weights = _averaged(found)["w"][0].as_py() if len(found) else weights
    return weights


def _lexicon(path: str):
    """Words and their counts with their packed pieces."""
    def run(batches):
        codec, kind = pieces.codec(path), _id_type(path)
        for b in batches:
            flat, offs = piece_ids(b.column(0).cast(pa.binary()).to_pylist(), codec)
            data, ends = flat.astype(kind).tobytes(), (offs * np.dtype(kind).itemsize).tolist()
            packs = pa.array([data[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packs], ["word", "c", "pieces"])

    return run


def _packed_texts(path: str, train_tokens: int, distinct: int, ends: int):
    """Documents of a chunk as packed pieces, with their counts and base scores."""
    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        kind = _id_type(path)
        order = np.argsort(words["no"].to_numpy())
        c = np.concatenate([words["c"].to_numpy()[order], [ends]])
        logs, known = np.log10((c + 1) / (train_tokens + distinct + 1)), c > 0
        flat, offs = _joined(words["pieces"].take(pa.array(order)).to_pylist(), kind)
        docs, out = docs.sort_by("no"), []
        for i in range(0, len(docs), 256):
            part = docs.slice(i, 256)
            numbers = [np.frombuffer(x, np.uint32) for x in part["words"].to_pylist()]
            tokens, offsets = _packed_docs(flat, offs, numbers)
            data, edges = tokens.astype(kind).tobytes(), (offsets * np.dtype(kind).itemsize).tolist()
            packs = [data[a:b] for a, b in zip(edges[:-1], edges[1:])]
            n = np.array([len(d) + 1 for d in numbers])
            seen = np.array([int(known[d].sum()) + (ends > 0) for d in numbers])
            base = np.array([logs[d].sum() + logs[-1] for d in numbers])
            out.append(pa.table([part["doc_id"], part["held_out"], pa.array(n), pa.array(seen), pa.array(base), pa.array(packs, pa.binary())], schema=PACKED))
        return pa.concat_tables(out) if out else PACKED.empty_table()

    return run


def _scores(path: str, counts: bytes, weights: bytes, train_tokens: int):
    def run(batches):
        kind, classes, w, t = _id_type(path), _classes_from(counts), unpacked(weights), of_nodes(np.frombuffer(weights, np.float32))
        for b in batches:
            if b.num_rows:
                tokens, offsets = _joined(b.column(5).to_pylist(), kind)
                score = log10_probability(w, classes, tokens, offsets, t)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.full(b.num_rows, train_tokens)), b.column(4), pa.array(score)], schema=RESULT)

    return run


PACKED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("tokens", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _piece_counts(path: str):
    """Piece counts from rows of (count of a word, its pieces)."""
    def run(batches):
        kind, total = _id_type(path), np.zeros(len(pieces.codec(path).model.pieces))
        for b in batches:
            flat, offs = _joined(b.column(1).to_pylist(), kind)
            total += np.bincount(flat, weights=np.repeat(b.column(0).to_numpy(), np.diff(offs)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["id", "n"])

    return run


def scored(docs: DataFrame, path: str = pieces.MODEL) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "text")
    chunks = save(rows.mapInArrow(_chunked, "chunk long, no long, word binary, n long, doc_id long, held_out boolean, words binary"), "chunks", "zstd")
    vocabulary = chunks.where("word IS NOT NULL")
    small_batches(spark, 20_000)
    lexicon = save(vocabulary.groupBy("word").agg(F.sum("n").alias("c")).mapInArrow(_lexicon(path), "word binary, c long, pieces binary"), "lexicon", "zstd")
    known = lexicon.where("c > 0")
    words, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = rows.where(~F.col("held_out")).count()
    train_tokens, distinct = total + ends, words + (ends > 0)

    per = known.select("c", "pieces").mapInArrow(_piece_counts(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    codec = pieces.codec(path)
    counts = np.zeros(len(codec.model.pieces))
    counts[per["id"].to_numpy()] = per["n"].to_numpy()
    counts[EOS] = ends
    table = counts.tobytes() + codec.marked.tobytes()

    small_batches(spark, 256)
    texts = chunks.where("words IS NOT NULL").select(*(F.col(c).alias(c) for c in ("chunk", "no", "doc_id", "held_out", "words")))
    # a word of very many chunks is one key with a row for each of them, which a skewed join may split
    looked = vocabulary.select("chunk", "no", "word").join(lexicon.hint("shuffle_hash"), "word").select("chunk", "no", "c", "pieces")
    pack = _packed_texts(path, train_tokens, distinct, ends)
    packs = texts.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(pack, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tokens binary")
    packs = save(packs, "tokens", "zstd")
    drop(chunks, lexicon)

    classes = Classes(counts, codec.marked)
    weights = packed(unfitted(classes.prior))
    if ends:
        start = packed(fresh(classes.prior)) + classes.codes.start().tobytes()
        weights = fitted(packs.where(~F.col("held_out")).select("tokens"), start, _Windows(path, table))
    return packs.mapInArrow(_scores(path, table, weights, train_tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm(spark, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
