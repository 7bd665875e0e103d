"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two second-order models (a character given the two before it) are trained from labelled samples, one on random strings and
one on ordinary identifiers. A candidate is a stretch of ``LEAST`` or more ``CANDIDATE`` characters between the
patterns' spans; it is a secret if its log-likelihood ratio, per character, exceeds a margin: ``MARGIN`` for mixed kinds of
characters, and more for letters of one case, as prose is, the more the shorter it is (:func:`margin`). A stretch
without any letter is a number or a rule and no secret. All steps are linear in the text's length.

The samples are made from fixed word parts and a seeded generator (``samples``), so the models are
the same on every executor; :func:`train` takes any other labelled samples.

Cases: a null or empty text has no spans; texts are scanned whole; repeated rows are scanned alike;
a null doc_id is an ordinary value; an empty table gives an empty result; other columns are ignored by
:func:`scanned` and kept by :func:`redacted`. Offsets are code points with an exclusive end.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches

#: The patterns, and the least length of what they must match.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: With each pattern, strings of which a lower-cased text that matches has at least one.
PATTERNS = ((ASSIGN, 2, 6, (b"passw", b"secret", b"token", b"api")), (ACCESS, 0, 20, (b"akia",)))
KINDS = ("assign", "access", "hex", "markov")
LEAST = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Natural-log ratio per character above which a candidate of mixed kinds is a secret, and for one of a single case the
#: part of its margin that stays and the part that shrinks with the root of the length.
MARGIN, PLAIN = 1.0, (1.0, 6.4)
#: Parts of ordinary identifiers, in English, French, German and Spanish.
PARTS = (
    "the and that with from this have which their other about after before between under over "
    "get set add new old list item name value count index size length data file path user order "
    "date time price total number result error message client server request response handler "
    "create update delete insert select config option default version language document "
    "information operation translation administration representation understanding something "
    "les des une pour dans que qui est avec sur par plus pas leur cette eau eaux oi ment elle tion "
    "der die und das ein eine einer nicht mit auf sich auch ung keit heit lich isch schaft ver "
    "los las que una con por para como pero sus este entre cuando muy sin sobre cion mente ado idad"
).split()


def samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled samples: 1 for random strings over usual alphabets, 0 for identifiers."""
    rng = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [low + up + dig, low + up + dig + "+/", low + dig, up + dig, "0123456789abcdef", low + up + dig + "_-"]
    out = []
    for i in range(n):
        letters = kinds[i % len(kinds)]
        out.append(("".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(16, 65)))), 1))
        words = [PARTS[j] for j in rng.integers(0, len(PARTS), int(rng.integers(2, 9)))]
        style = i % 6
        if style == 0:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif style == 1:
            text = "_".join(words) + (str(int(rng.integers(0, 100))) if i % 4 else "")
        elif style == 2:
            text = "-".join(words)
        elif style == 3:
            text = "/".join(words)
        elif style == 4:
            text = "_".join(words).upper()
        else:
            text = "".join(words)
        out.append((text, 0))
    return out


#: Classes of the models: every candidate character, and one class for all others.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CLASS = np.full(256, len(ALPHABET), np.int64)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_N = len(ALPHABET) + 1


def train(labelled: list[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratios by (two characters before, character): random against ordinary.

    Each model mixes second-order counts into first-order ones, and these into a uniform one.
    """
    logs = []
    for label in (1, 0):
        one, two = np.zeros((_N, _N)), np.zeros((_N * _N, _N))
        for text, y in labelled:
            if y == label and len(text) > 2:
                c = _CLASS[np.frombuffer(text.encode(), np.uint8)]
                np.add.at(one, (c[:-1], c[1:]), 1)
                np.add.at(two, (c[:-2] * _N + c[1:-1], c[2:]), 1)
        first = (one + 5.0 / _N) / (one.sum(1, keepdims=True) + 5.0)
        prior = np.tile(first, (_N, 1))
        logs.append(np.log((two + 10.0 * prior) / (two.sum(1, keepdims=True) + 10.0)))
    return (logs[0] - logs[1]).astype(np.float32)


@lru_cache(None)
def _model() -> np.ndarray:
    return train(samples()).ravel()


def ratio(candidate: bytes) -> float:
    """Log-likelihood ratio per character of a candidate of three characters or more."""
    c = _CLASS[np.frombuffer(candidate, np.uint8)]
    return float(_model()[(c[:-2] * _N + c[1:-1]) * _N + c[2:]].mean())


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of what the fixed patterns find, ordered."""
    out = []
    lower = text.lower()
    for kind, (pattern, group, least, needs) in enumerate(PATTERNS):
        if any(x in lower for x in needs):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    # maximal runs, so the least length can be in the pattern
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def margin(candidate: bytes) -> float:
    """What the ratio must exceed. One case of letters alone, but for a capital in front, is judged like prose."""
    c = _CLASS[np.frombuffer(candidate, np.uint8)]
    up, low, digit = c < 26, (c >= 26) & (c < 52), (c >= 52) & (c < 62)
    if not up.any() and not low.any():
        return math.inf
    if digit.any() or low.any() and up[1:].any():
        return MARGIN
    return PLAIN[0] + PLAIN[1] / math.sqrt(len(candidate))


def between(lo: int, hi: int, covered: list[tuple[int, int, int]]):
    """The parts of lo..hi that lie in none of the ``covered`` spans, which are in order of their starts."""
    for a, b, _ in covered:
        if a > lo:
            yield lo, min(a, hi)
        lo = max(lo, b)
        if lo >= hi:
            return
    yield lo, hi


def markov_spans(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    ends = list(accumulate((e for _, e, _ in base), max))  # so that a later span never ends before an earlier one
    starts = [s for s, _, _ in base]
    for m in CANDIDATE.finditer(text):
        at, last = bisect_right(ends, m.start()), bisect_left(starts, m.end())
        for lo, hi in between(*m.span(), base[at:last]):
            if hi - lo >= LEAST and ratio(text[lo:hi]) > margin(text[lo:hi]):
                out.append((lo, hi, 3))
    return out


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points, each stretch counted once."""
    if not spans or text.isascii():
        return spans
    at, seen, place = 0, 0, {}
    for x in sorted({x for s in spans for x in s[:2]}):
        seen += len(text[at:x].decode())
        at, place[x] = x, seen
    return [(place[a], place[b], k) for a, b, k in spans]


def scan(text: bytes | None) -> tuple[list, list]:
    """(base spans, all spans), each (start, end, kind) in code points by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    every = sorted(base + markov_spans(text, base), key=lambda s: (s[0], s[2]))
    every = _points(text, every)
    return [s for s in every if s[2] < 3], every


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scanned(batches):
    for b in batches:
        cols = [[], [], [], [], []]
        for text in b.column(1).cast(pa.binary()).to_pylist():
            base, every = scan(text)
            for k in range(3):
                cols[k].append(sum(s[2] == k for s in base))
            cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols[4].append(_joined(every))
        arrays = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column(0), *arrays], [b.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, their digest, and all spans."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: bytes | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    if text is None:
        return None
    whole = text.decode()
    out, at = [], 0
    for a, b, _ in scan(text)[1]:
        if a >= at:
            out += [whole[at:a], mark]
        at = max(at, b)
    return "".join([*out, whole[at:]])


def _redacted(batches):
    for b in batches:
        i = b.schema.get_field_index("text")
        new = pa.array([redact(t) for t in b.column(i).cast(pa.binary()).to_pylist()], b.schema.field(i).type)
        yield b.set_column(i, b.schema.field(i), new)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of every text replaced, and n_chars brought up to date."""
    small_batches(docs.sparkSession)
    out = docs.mapInArrow(_redacted, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))
