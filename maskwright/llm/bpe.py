"""Byte-level BPE with a sentencepiece model serialised from the rank file.

Every byte string of the vocabulary becomes a piece of printable characters
(one per byte) scored by its negative rank, under identity normalisation, so
that sentencepiece's best-score-first merging is the rank order of byte-level
BPE. A text is cut by the vocabulary's pattern; each match is encoded by
itself. Decoding maps ids back to the bytes.

Word-like matches repeat, so each Python worker remembers the ids of those it
has met, up to a bound; a batch is then assembled by array gathers.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 500_000  # matches a worker remembers before it starts afresh
_PART = 1_000_000  # characters of a text handled at once


def text_of(raw: bytes | None) -> str:
    """Null is empty; bytes that aren't UTF-8 become U+FFFD."""
    return (raw or b"").decode("utf-8", "replace")


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@lru_cache
def byte_letters() -> str:
    """256 printable characters, the i-th for byte i: itself if visible in Latin-1, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(spare)) for b in range(256))


def _letters_table() -> dict[int, str]:
    return dict(enumerate(byte_letters()))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece i is token i, scored -i; one unknown piece follows."""
    table = _letters_table()

    def piece(text: str, score: float, kind: int) -> bytes:
        body = _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind)
        return _field(1, body)

    normal, unknown = 1, 2
    out = [piece(t.decode("latin-1").translate(table), -float(i), normal) for i, t in enumerate(tokens)]
    out.append(piece("<unk>", -float(len(tokens)), unknown))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


#: The pattern these vocabularies were made with, and how it cuts texts of white space, visible ASCII and
#: Latin letters, written with plain character classes (much faster; all Unicode versions agree on them).
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(f"[\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf{_LETTER}\u00d7\u00f7]*")
PLAIN_PIECES = re.compile(rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


class _Index(dict):
    """A number for each piece; new pieces are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Remembered:
    """ids of texts by their pieces; the new pieces of a group of texts go to ``encode`` together.

    encode: pieces -> (all their ids, the number of ids of each).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat, self.starts = array("i"), array("q", [0])

    def ids(self, texts: list[Iterable[list[str]]]) -> list[np.ndarray]:
        """For each text, given as lists of its pieces, its ids."""
        if len(self.index) > self.limit:
            self._clear()
        number, at, counts = self.index.__getitem__, [np.zeros(0, np.int64)], []
        for parts in texts:
            own = [np.fromiter(map(number, pieces), np.int64, len(pieces)) for pieces in parts]
            at += own
            counts.append(sum(map(len, own)))
        if self.index.new:
            flat, lengths = self.encode(self.index.new)
            ends = np.cumsum(lengths) + self.starts[-1]
            self.flat.frombytes(np.ascontiguousarray(flat, np.int32).tobytes())
            self.starts.frombytes(np.ascontiguousarray(ends, np.int64).tobytes())
            self.index.new = []
        where = np.concatenate(at)
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32)
        first = starts[where]
        lengths = starts[where + 1] - first
        ends = np.concatenate(([0], np.cumsum(lengths)))
        found = flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)] if ends[-1] else np.zeros(0, np.int32)
        return np.split(found, ends[np.cumsum(counts)[:-1]]) if counts else []


def pieces_of(text: str, pattern) -> Iterator[list[str]]:
    """The matches of pattern, in lists of bounded length."""
    if len(text) <= _PART:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, _PART // 4)):
        yield part


def grouped(texts: Iterable, rows: int = 128, size: int = 1 << 20) -> Iterator[list[str]]:
    """The decoded texts of an Arrow array in groups of bounded size."""
    group, total = [], 0
    for x in texts:
        group.append(text_of(x.as_py()))
        total += len(group[-1])
        if len(group) >= rows or total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


class ByteBpe:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.usual = pattern == PATTERN
        self.table = _letters_table()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.known = Remembered(self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        whole = [self.ranks.get(r) for r in raw]
        rest = iter(self.model.encode([r.decode("latin-1").translate(self.table) for r, w in zip(raw, whole, strict=True) if w is None], num_threads=1))
        ids = [next(rest) if w is None else (w,) for w in whole]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.known.ids([pieces_of(t, PLAIN_PIECES if self.usual and PLAIN.fullmatch(t) else self.pattern) for t in texts])


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    return read_ranks(path)


def decoded_bytes(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(_tokens(path).__getitem__, ids.tolist()))


def id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


_BATCH_ROWS = 256  # rows of an output batch, so that long texts don't pile up


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, pattern)
    for whole in batches:
        for at in range(0, whole.num_rows, _BATCH_ROWS):
            batch = whole.slice(at, _BATCH_ROWS)
            found = [ids for group in grouped(batch.column(1).cast(pa.binary())) for ids in coder.encode(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(found)], ["id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): one row per row of docs. Null and empty texts have no ids; ids may be null or repeat."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(partial(_encode, path=path, pattern=pattern), f"id {kind}, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _BATCH_ROWS):
            batch = whole.slice(at, _BATCH_ROWS)
            texts = [decoded_bytes(x.values.to_numpy(), path) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["id", "ids", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(id, ids) -> (id, ids, decoded binary); null ids decode to null."""
    rows = encoded.select("id", "ids")
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(partial(_decode, path=path), f"id {kind}, ids array<int>, decoded binary")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    return _decode(_encode(batches, path, pattern), path)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the texts encoded and the ids decoded again, in one pass through Python."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(partial(_round_trip, path=path, pattern=pattern), f"id {kind}, ids array<int>, decoded binary")
