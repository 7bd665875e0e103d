"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; normaliser, metaspace marker, piece scores and byte
fallback are rebuilt as a tokenizers pipeline. A unigram model keeps its scores; a BPE model's
merges are all splits of its pieces into two pieces, in the order of the merged piece's score. Where no
piece has a marker behind another character, no merge crosses a word's start, so texts are cut there
first, which changes no id and lets the library reuse the ids of words it has seen. Batches are
encoded by several threads; :func:`parity` compares with a reference encoder given as a function.

Cases: a null text has null ids, an empty one has none; texts are encoded whole; a literal marker
character in a text is the same as a space and decodes to one; repeated rows are encoded alike; a null doc_id is an
ordinary value; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches

#: Place of the public model file; a parameter of every function.
MODEL = os.environ.get("TAILWATCH_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Fixed values of the model format: piece types and model kinds.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
#: A word with the markers before it, and how many words a worker remembers the ids of.
WORD = f"{MARK}*[^{MARK}]+|{MARK}+"
REMEMBERED = 600_000


@dataclass
class Model:
    pieces: list  # (text, score, type), by id
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def fields(data: bytes):
    """(number, value) of each field of a protobuf message: int, or bytes for the other kinds."""

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def load(data: bytes) -> Model:
    """A model from its serialised protobuf."""
    model = Model([])
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best merged piece first."""
    ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
    out = []
    for piece, i in ids.items():
        score = model.pieces[i][1]
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                out.append((-score, ids[left], ids[right], left, right))
    return [(x[3], x[4]) for x in sorted(out)]


def cuts_at_words(model: Model) -> bool:
    """Whether no piece has a marker behind another character."""
    return not any(MARK in p.lstrip(MARK) for p, _, t in model.pieces if t in (NORMAL, USER))


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        name = None if unknown is None else model.pieces[unknown][0]
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=name, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if cuts_at_words(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


class Codec:
    """Encodes and decodes batches."""

    def __init__(self, path: str = MODEL, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = load(f.read())
        self.tokenizer = build(self.model)
        parts = [self._bytes(*p) for p in self.model.pieces]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.words: dict[str, bytes] = {}
        # words are cut and remembered here if normalising needs no more than the markers
        m = self.model
        plain = cuts_at_words(m) and m.escape and m.dummy_prefix and not m.charsmap and not m.squeeze
        self.by_word = build(replace(m, dummy_prefix=False, escape=False)) if plain else None

    @staticmethod
    def _bytes(piece: str, _, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as the bytes of 32-bit numbers."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32).tobytes() for e in found]

    def _remember(self, words: list[str]) -> None:
        """Encode words of which none holds a marker or a space, several in one go.

        Each begins with the one marker before it, so the pieces with a marker are its first ones.
        """
        blocks = [words[i : i + 512] for i in range(0, len(words), 512)]
        found = self.by_word.encode_batch_fast([MARK + MARK.join(b) for b in blocks], add_special_tokens=False)
        for block, e in zip(blocks, found):
            ids = np.array(e.ids, np.int32)
            first = np.flatnonzero(self.marked[ids]).tolist()
            data = ids.tobytes()
            for word, a, b in zip(block, first, [*first[1:], len(ids)], strict=True):
                self.words[word] = data[4 * a : 4 * b]

    def encode_packed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch in one array, and each text's offsets into it."""
        out: list = [b""] * len(texts)
        cut, whole = {}, []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.by_word and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " ":
                cut[i] = t.split(" ")
            else:
                whole.append(i)
        new = set().union(*cut.values()).difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {}
            new = set().union(*cut.values())
        self._remember(list(new))
        ids = self.words.__getitem__
        for i, words in cut.items():
            out[i] = b"".join(map(ids, words))
        for i, data in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = data
        sizes = np.array([len(x) // 4 for x in out], np.int64)
        return np.frombuffer(b"".join(out), np.int32), np.concatenate([[0], np.cumsum(sizes)])

    def decode_packed(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of a packed batch."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        data = self.blob[place].tobytes()
        out = []
        for a, b in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist()):
            out.append(data[a + 1 : b] if self.model.dummy_prefix and data[a : a + 1] == b" " and b > a else data[a:b])
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, offsets = self.encode_packed(texts)
        return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]

    def decode(self, ids: list[list[int]]) -> list[str]:
        sizes = np.cumsum([0, *map(len, ids)])
        flat = np.array([i for row in ids for i in row], np.int32)
        return [x.decode("utf-8", "replace") for x in self.decode_packed(flat, sizes)]

    def normalised(self, text: str) -> str:
        """What a round trip gives: the text after the model's normaliser, markers as spaces."""
        if not self.model.charsmap and not self.model.squeeze:
            return text.replace(MARK, " ")
        out = self.tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
        return out[1:] if self.model.dummy_prefix and out[:1] == " " else out


@lru_cache(4)
def codec(path: str = MODEL, threads: int = THREADS) -> Codec:
    return Codec(path, threads)


def parity(texts: list[str], reference, path: str = MODEL) -> list[int]:
    """Places of the texts whose ids differ from ``reference(texts)``."""
    return [i for i, (a, b) in enumerate(zip(codec(path).encode(texts), reference(texts))) if a != list(b)]


def encoded(docs: DataFrame, keep: list[str], path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``keep`` columns with ids (array), n_ids, and whether decoding gives the normalised text."""

    def run(batches):
        c = codec(path, threads)
        for b in batches:
            texts = b.column(0).to_pylist()
            ids, offsets = c.encode_packed([t or "" for t in texts])
            back = c.decode_packed(ids, offsets)
            same = [None if t is None else x == c.normalised(t).encode() for t, x in zip(texts, back)]
            none = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=none) if texts else pa.array([], pa.list_(pa.int32()))
            new = [lists, pa.array(np.diff(offsets)), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), *new], [*b.schema.names[1:], "ids", "n_ids", "decoded"])

    small_batches(docs.sparkSession)
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "ids array<int>", "n_ids long", "decoded boolean"])
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, schema)


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), ["doc_id"])
