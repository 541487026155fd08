"""Stupid-backoff language-model scores of every document under counts of all other documents.

The relations: exploded n-grams (block of documents, n-gram, occurrences in
the block), partitioned by hash; count tables (n-gram, total), one per hash
partition, grouped from them; their join on the n-gram; and the sum per
document. Rows are packed: the n-grams of a block that share a hash partition
travel as one row, their sorted 64-bit hashes as an Elias-Fano sequence (about
44 bits each) and their occurrences compressed. Plain rows would take three
times as much for the hashes alone. N-grams are distinct within their block,
so a very frequent one adds one entry a block to its partition, no more.

Bounds: a block holds ``BLOCK_BYTES`` of text (or one longer text), a hash
partition ``PART_ENTRIES`` entries at most on average, as the number of
partitions follows the number of words. A packed row then holds a block's
n-grams over the number of partitions: hundreds at 30 GB, few at many TB, where
larger executors should be given larger blocks. Blocks are stored before
anything is counted, so a lost task finds the same blocks again.

A token w after the context h scores count(hw) / count(h) if hw occurs at least
``min_count`` times, else ``alpha`` times the score of w after the context
shortened by one; the score of w without context is count(w) / N. Counts leave
the document's own occurrences out, else no n-gram would ever be unseen; a word
that no other document has counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, stored
from .token_store import EliasFano

ORDER = 3
MIN_COUNT = 1
ALPHA = 0.4
BLOCK_BYTES = 40 << 20
PART_ENTRIES = 2_500_000
_RANGES = 6  # of a block's keys, looked up one after another

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def ngram_keys(text: bytes | None, order: int) -> list[np.ndarray]:
    """For k = 1 to order the 64-bit keys of the n-grams of k words, by the position of their last word."""
    words = words_of(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = [h]
    for k in range(2, order + 1):
        key = out[-1][:-1] * _MULTIPLIER + h[k - 1 :] if len(out[-1]) else h[:0]
        out.append(key ^ (key >> np.uint64(31)))
    return out


def _pack_counts(counts: np.ndarray) -> bytes:
    """Byte planes, lowest first, compressed: mostly small numbers."""
    return zstandard.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def _unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


# ---- blocks ----

_BLOCKS = "block long, n_words long, ids binary, texts binary"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary()), ("texts", pa.binary())])


def _packed_texts(texts: list[bytes | None]) -> bytes:
    sizes = np.array([-1 if t is None else len(t) for t in texts], "<i8").tobytes()
    return zstandard.compress(len(texts).to_bytes(8, "little") + sizes + b"".join(t or b"" for t in texts), 9)


def _unpacked_texts(data: bytes) -> list[bytes | None]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, "<i8", n, 8)
    ends = 8 + 8 * n + np.cumsum(np.maximum(sizes, 0))
    return [None if s < 0 else raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _ids_bytes(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.record_batch([ids], ["id"]))
    return sink.getvalue().to_pybytes()


def _ids(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("id").combine_chunks()


def _make_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids: list[pa.Array] = []
    texts: list[bytes | None] = []
    size = 0

    def block() -> pa.RecordBatch:
        whole = pa.concat_arrays(ids)
        words = sum(len(words_of(t)) for t in texts)
        cols = [[number], [words], [_ids_bytes(whole)], [_packed_texts(texts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)

    for batch in batches:
        first = 0
        for i, x in enumerate(batch.column(1)):
            text = x.as_py()
            own = len(text or b"") + 16
            if texts and size + own > block_bytes:
                ids.append(batch.column(0).slice(first, i - first))
                yield block()
                number, ids, texts, size, first = number + 1, [], [], 0, i
            texts.append(text)
            size += own
        ids.append(batch.column(0).slice(first))
    if texts:
        yield block()


def _blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The rows in blocks of bounded size, stored; whatever ids and texts repeat."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _make_blocks(batches, block_bytes)

    return stored(rows.mapInArrow(made, _BLOCKS), "blocks", compression="none")


def _block_keys(texts: list[bytes | None], order: int) -> list[list[np.ndarray]]:
    """Per k the keys of each document of a block."""
    each = [ngram_keys(x, order) for x in texts]
    return [[e[k] for e in each] for k in range(order)]


# ---- exploded n-grams, by hash partition ----

_PACKED = "block long, part int, k int, keys binary, counts binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _first_key(part: int, parts: int) -> np.uint64:
    return np.uint64(-(-(part << 32) // parts) << 32)


def _explode_blocks(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks -> a row for each k and hash partition."""
    for batch in batches:
        for number, texts in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
            each = _block_keys(_unpacked_texts(texts.as_py()), order)
            for k in range(1, order + 1):
                whole = np.concatenate(each[k - 1])
                each[k - 1] = []
                whole.sort()
                starts = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1]))) if len(whole) else np.zeros(0, np.int64)
                keys, counts = whole[starts], np.diff(starts, append=len(whole))
                del whole, starts
                ends = np.searchsorted(_parts_of(keys, parts), np.arange(parts + 1))
                rows: list[tuple] = []
                for p in np.flatnonzero(np.diff(ends)).tolist():
                    own = slice(ends[p], ends[p + 1])
                    rows.append((number, p, k, EliasFano.encode(keys[own] - _first_key(p, parts)), _pack_counts(counts[own])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)


def _exploded(blocked: DataFrame, order: int, parts: int) -> DataFrame:
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _explode_blocks(batches, order, parts)

    return blocked.select("block", "texts").mapInArrow(exploded, _PACKED)


def _parts_for(blocked: DataFrame, order: int) -> int:
    words = blocked.agg(F.sum("n_words")).first()[0] or 0
    return max(shuffle_partitions(blocked.sparkSession), math.ceil(order * words / PART_ENTRIES))


# ---- count tables ----


def _grouped(table: pa.Table) -> Iterator[tuple[int, np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Of one hash partition, per k: (k, rows, entries of each row, distinct keys, the key of each entry, totals)."""
    ks = table.column("k").to_numpy()
    for k in np.unique(ks).tolist():
        at = np.flatnonzero(ks == k)
        keys = [EliasFano(table.column("keys")[int(i)].as_py()).all() for i in at]
        counts = np.concatenate([_unpack_counts(table.column("counts")[int(i)].as_py()) for i in at])
        sizes, keys = [len(x) for x in keys], np.concatenate(keys)
        distinct, where = np.unique(keys, return_inverse=True)
        del keys
        totals = np.bincount(where, counts, len(distinct)).astype(np.int64)
        yield k, at, sizes, distinct, where, totals


def _join_counts(table: pa.Table) -> pa.Table:
    """The count table of one hash partition, joined back to the rows that asked."""
    out: list[bytes] = [b""] * table.num_rows
    for _, at, sizes, _, where, totals in _grouped(table):
        for i, answer in zip(at, np.split(totals[where], np.cumsum(sizes)[:-1]), strict=True):
            out[i] = _pack_counts(answer)
    nothing = pa.array([None] * table.num_rows, pa.binary())
    return pa.Table.from_arrays([table.column("block"), table.column("part"), table.column("k"), nothing, pa.array(out, pa.binary())], schema=_PACKED_ARROW)


def ngram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The count tables: (k, key, total), key the 64-bit hash of an n-gram of k words."""
    blocked = _blocked(docs, id_col, text_col, block_bytes)
    parts = _parts_for(blocked, order)

    def counted(table: pa.Table) -> pa.Table:
        first = _first_key(table.column("part")[0].as_py(), parts)
        out = [pa.table({"k": pa.array(np.full(len(keys), k, np.int32)), "key": pa.array((keys + first).view(np.int64)), "total": pa.array(totals)}) for k, _, _, keys, _, totals in _grouped(table)]
        return pa.concat_tables(out)

    return _exploded(blocked, order, parts).groupBy("part").applyInArrow(counted, "k int, key long, total long")


# ---- scores ----

_SCORED_FIELDS = [("n_tokens", pa.int64()), ("n_backed_off", pa.int64()), ("n_bare", pa.int64()), ("log_sum", pa.float64())]


def score_tokens(counts: list[np.ndarray], min_count: int, alpha: float) -> tuple[int, int, float]:
    """Of one document, counts[k-1][i] being the count of its i-th n-gram of k words.

    Returns the tokens scored below the order their position allows, the tokens
    scored by count(w) alone (still to be divided by N), and the sum of logarithms.
    """
    n = len(counts[0])
    if not n:
        return 0, 0, 0.0
    level = np.ones(n, np.int64)
    value = np.log(np.maximum(1, counts[0]))
    for k in range(2, len(counts) + 1):
        own = counts[k - 1]
        good = np.flatnonzero(own >= max(1, min_count))
        level[good + k - 1] = k
        value[good + k - 1] = np.log(own[good]) - np.log(counts[k - 2][good])
    allowed = np.minimum(np.arange(n) + 1, len(counts))
    backs = allowed - level
    return int(np.count_nonzero(backs)), int(np.count_nonzero(level == 1)), float(value.sum() + math.log(alpha) * backs.sum())


def _counts_of(each: list[np.ndarray], answers: list[tuple[int, bytes]], parts: int, others: bool) -> list[np.ndarray]:
    """Of a block's documents, given as keys of one k: the count of every n-gram, from the answers of the hash partitions.

    The keys are looked up range by range, so that only a part of them is sorted at a time.
    """
    whole = np.concatenate(each)
    found = np.zeros(len(whole), np.int64)
    answers = sorted(answers)
    for first in range(0, len(answers), -(-len(answers) // _RANGES) or 1):
        own = answers[first : first + -(-len(answers) // _RANGES)]
        inside = whole >= _first_key(own[0][0], parts)
        if own[-1][0] + 1 < parts:
            inside &= whole < _first_key(own[-1][0] + 1, parts)
        at = np.flatnonzero(inside)
        _, where = np.unique(whole[at], return_inverse=True)
        found[at] = np.concatenate([_unpack_counts(c) for _, c in own])[where]
    del whole
    out, at = [], 0
    for i, keys in enumerate(each):
        total = found[at : at + len(keys)]
        at += len(keys)
        if others and len(keys):
            _, own_where, own = np.unique(keys, return_inverse=True, return_counts=True)
            total -= own[own_where]
        each[i] = keys[:0].copy()
        out.append(total)
    return out


def _score(blocks: pa.Table, answers: pa.Table, order: int, parts: int, min_count: int, alpha: float, others: bool) -> pa.Table:
    ids = _ids(blocks.column("ids")[0].as_py())
    each = _block_keys(_unpacked_texts(blocks.column("texts")[0].as_py()), order)
    got: dict[int, list[tuple[int, bytes]]] = {k: [] for k in range(1, order + 1)}
    for k, p, c in zip(*(answers.column(x).to_pylist() for x in ("k", "part", "counts")), strict=True):
        got[k].append((p, c))
    counts = [_counts_of(each[k], got.pop(k + 1), parts, others) for k in range(order)]
    scored = [(len(own[0]), *score_tokens(list(own), min_count, alpha)) for own in zip(*counts, strict=True)]
    columns = [ids, *(pa.array(c, t) for c, (_, t) in zip(zip(*scored, strict=True) if scored else [[]] * 4, _SCORED_FIELDS, strict=True))]
    return pa.Table.from_arrays(columns, names=["id", *(n for n, _ in _SCORED_FIELDS)])


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, others: bool = True, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, n_tokens, n_backed_off, log_score): one row per row of docs, natural logarithms.

    others: a document is scored under the counts of all other rows; else its
    own count too. N is the number of words counted, at least 1. Null texts and
    texts without words have no tokens and log_score 0. Repeated rows are rows
    of their own and so count for each other; ids may be null. Texts are scored
    whole, of any length. Other columns don't matter. An empty table gives an
    empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    blocked = _blocked(docs, id_col, text_col, block_bytes)
    parts = _parts_for(blocked, order)
    answers = _exploded(blocked, order, parts).groupBy("part").applyInArrow(_join_counts, _PACKED).drop("keys")
    schema = f"id {kind}, n_tokens long, n_backed_off long, n_bare long, log_sum double"

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, order, parts, min_count, alpha, others)

    found = stored(blocked.select("block", "ids", "texts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema), "scores")
    discard(blocked)
    tokens = found.agg(F.sum("n_tokens")).first()[0] or 1
    size = F.greatest(F.lit(1), F.lit(tokens) - F.col("n_tokens")) if others else F.lit(tokens)
    return found.select("id", "n_tokens", "n_backed_off", (F.col("log_sum") - F.col("n_bare") * F.log(size.cast("double"))).alias("log_score"))
