"""Token ids in files: one concatenated id array with Elias-Fano document boundaries.

A store is a Parquet folder whose rows are segments. A segment is one binary
value with a header, the ids (2 or 4 bytes each), the ends of its documents
and their ids as Elias-Fano sequences. Shards hold ascending ranges of the
document id; a segment knows how many tokens of its shard precede it, so the
global offset of a document needs the shard totals (one number per shard) and
one ``select`` in the segment.

Elias-Fano: of n ascending values below u, the lowest log2(u/n) bits are
stored as they are and the rest as a unary bit vector, about 2 + log2(u/n)
bits a value; a sample of the positions of its ones (32 bits each) answers
select(i) without a table of 64-bit offsets. Reading a segment asks select for
the offsets of its documents.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PLAIN, PLAIN_PIECES, Remembered, grouped, pieces_of
from .common import shuffle_partitions, stored

END_ID = 2
SEGMENT_TOKENS = 1 << 18
SEGMENT_DOCS = 1 << 14
REMEMBERED = 1_000_000  # pieces a worker remembers

_EF_HEAD = struct.Struct("<QQBQ")  # n, universe, low bits, bytes of the high part
_HEAD = struct.Struct("<6sBQQqQQ")  # magic, id width, documents, null ids, first id, bytes of ends, bytes of ids' gaps
_MAGIC = b"MWTOK1"
_SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers, read in place from bytes."""

    def __init__(self, data: bytes):
        self.n, self.universe, self.low_bits, high_bytes = _EF_HEAD.unpack_from(data)
        at = _EF_HEAD.size
        low_bytes = (self.n * self.low_bits + 7) // 8
        self._low = np.frombuffer(data, np.uint8, low_bytes, at)
        self._high = np.frombuffer(data, np.uint8, high_bytes, at + low_bytes)
        self._samples = np.frombuffer(data, "<u4", (self.n + _SAMPLE - 1) // _SAMPLE, at + low_bytes + high_bytes)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = b""
        if low_bits and n:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        if n and ones[-1] >> 32:
            raise ValueError("too many values for samples of 32 bits")
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        high = np.packbits(high, bitorder="little").tobytes()
        return _EF_HEAD.pack(n, min(universe, (1 << 64) - 1), low_bits, len(high)) + low + high + ones[::_SAMPLE].astype("<u4").tobytes()

    def _low_part(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        begin, end = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self._low[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 : begin % 8 + end - begin]
        return bits.reshape(count, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, by the nearest sample and a scan of at most _SAMPLE ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self._samples[i // _SAMPLE])
        left = i % _SAMPLE
        byte = at // 8
        word = np.unpackbits(self._high[byte : byte + 1], bitorder="little")
        word[: at % 8] = 0
        while (ones := int(word.sum())) <= left:
            left -= ones
            byte += 1
            word = np.unpackbits(self._high[byte : byte + 1], bitorder="little")
        position = byte * 8 + int(np.flatnonzero(word)[left])
        return (position - i) << self.low_bits | int(self._low_part(i, 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """The values first to last - 1: from each sample on, one look at the bits up to the next."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        found = [np.zeros(0, np.int64)]
        for k in range(first // _SAMPLE, -(-last // _SAMPLE)):
            at = int(self._samples[k])
            end = int(self._samples[k + 1]) if k + 1 < len(self._samples) else 8 * len(self._high)
            ones = np.flatnonzero(np.unpackbits(self._high[at // 8 : -(-end // 8)], bitorder="little")[at % 8 : at % 8 + end - at]) + at
            found.append(ones[max(0, first - k * _SAMPLE) : last - k * _SAMPLE])
        high = np.concatenate(found) - np.arange(first, last)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low_part(first, last - first)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low_part(0, self.n)


class Segment:
    """A segment's bytes: pack() writes, the constructor reads."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_null, self.first_id, ends, gaps = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.ends = EliasFano(data[at : at + ends])
        self.gaps = EliasFano(data[at + ends : at + ends + gaps])
        self.ids = np.frombuffer(data, f"<u{self.width}", offset=at + ends + gaps)

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
        """doc_ids ascending, nulls first."""
        known = [i for i in doc_ids if i is not None]
        first = known[0] if known else 0
        gaps = EliasFano.encode(np.array([i - first for i in known], np.uint64))
        ends = EliasFano.encode(np.cumsum([len(x) for x in ids]).astype(np.uint64))
        head = _HEAD.pack(_MAGIC, width, len(ids), len(ids) - len(known), first, len(ends), len(gaps))
        return head + ends + gaps + np.concatenate(ids).astype(f"<u{width}").tobytes()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [int(g) + self.first_id for g in self.gaps.select_range(0, self.gaps.n).tolist()]


class LibraryTokenizer:
    """The tokenizers library as loaded, on whole texts; the pieces of plain texts are remembered per worker.

    The library finds its added tokens (such as an end of text) wherever they
    stand, so a text that holds one goes to it as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # one letter for each byte
        self.known = Remembered(self._encode_pieces, REMEMBERED)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces in one call; where a piece ends follows from the bytes of pieces and tokens."""
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], add_special_tokens=False, is_pretokenized=True)[0].ids, np.int32)
        piece_ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        token_ends = np.cumsum(self.bytes_of[ids])
        return ids, np.diff(np.searchsorted(token_ends, piece_ends, "left") + 1, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bool(PLAIN.fullmatch(t)) and not self.added.search(t) for t in texts]
        known = iter(self.known.ids([pieces_of(t, PLAIN_PIECES) for t, p in zip(texts, plain, strict=True) if p]))
        return [next(known) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> LibraryTokenizer:
    return LibraryTokenizer(path)


_STORE_SCHEMA = "shard int, seq int, n_docs long, n_tokens long, before long, data binary"


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, shard = _tokenizer(path), TaskContext.get().partitionId()
    seq = before = tokens = 0
    doc_ids: list[int | None] = []
    ids: list[np.ndarray] = []
    end = np.array([end_id], np.int32)

    def segment() -> pa.RecordBatch:
        data = Segment.pack(doc_ids, ids, coder.width)
        cols = ([shard], [seq], [len(ids)], [tokens], [before], [data])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "seq", "n_docs", "n_tokens", "before", "data"])

    for batch in batches:
        texts = (x for group in grouped(batch.column(1).cast(pa.binary())) for x in coder.encode(group))
        for doc_id, found in zip(batch.column(0), texts, strict=True):
            found = np.concatenate((found, end))
            if ids and (tokens + len(found) > SEGMENT_TOKENS or len(ids) >= SEGMENT_DOCS):
                yield segment()
                seq, before, tokens, doc_ids, ids = seq + 1, before + tokens, 0, [], []
            doc_ids.append(doc_id.as_py())
            ids.append(found)
            tokens += len(found)
    if ids:
        yield segment()


def write(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every text, append end_id, write the store in ascending id order; returns the store's rows.

    Null texts are empty and so hold only end_id. Null ids come first; equal ids
    are ordered by the hash of the text, which the shards' ranges take in too, so
    that many rows of one id or without any are split. Texts of any length are
    encoded whole; other columns, whatever their names, are left. Rows equal in
    id and text are all written. An empty table gives an empty store.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return stored(ordered.mapInArrow(partial(_write, path=tokenizer_path, end_id=end_id), _STORE_SCHEMA), "tokens", compression="zstd")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, before, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            segment = Segment(data.as_py())
            ends = segment.ends.select_range(0, segment.n_docs).astype(np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            raw = segment.ids.astype("<u4").tobytes()
            ids = pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), shard.as_py(), np.int32)), pa.array(segment.doc_ids(), pa.int64()), pa.array(starts + before.as_py()), pa.array(ends - starts), ids],
                ["shard", "id", "start", "n_tokens", "ids_le"],
            )


def read(store: DataFrame) -> DataFrame:
    """The store's documents: (id, start, n_tokens, ids_le), ids as little-endian unsigned 32-bit integers.

    Only one total per shard goes through a single task and is broadcast, which
    the number of partitions bounds.
    """
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", earlier.alias("base"))
    docs = store.select("shard", "before", "data").mapInArrow(_read, "shard int, id long, start long, n_tokens long, ids_le binary")
    return docs.join(F.broadcast(bases), "shard").select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_le")
