"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

An item is the set of its word shingles. Items are partitioned by the size of
that set (powers of two). In a partition with sets of at most u shingles, an
item's sketch is its u - ceil(t*u) + 1 smallest MinHash values: a document
that contains a share t of the item can't miss all of them, so looking a
document's shingle hashes up in the sketches finds every item it may contain,
however long the document is and wherever the shingles stand. Each candidate
is then verified on the shingles themselves.

Each partition has an index of its own: its sketch values in one sorted array
with the items they come from, looked up by binary search. Texts that several
items share are indexed once and joined back to their items. Documents are
only scanned, never shuffled, and once: an index of ``BLOCK_BYTES`` of
benchmark text is a broadcast of at most three times that, and only a larger
benchmark takes further scans, rather than more memory.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 64 << 20
SMALL_TABLE = 100_000  # rows of (key, item) that may be broadcast

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 24
_REMEMBERED = 2048  # items whose shingles a worker keeps at hand


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; null has none."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash per shingle; fewer than size words are one shingle, no words none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * _MULTIPLIER + h[j : n - width + 1 + j]
    return out ^ (out >> np.uint64(29))


def sketch_size(n: int, threshold: float) -> int:
    """How many of the smallest hashes of n shingles are kept, by the largest set of the partition that n is in."""
    upper = (1 << n.bit_length()) - 1
    return upper - math.ceil(threshold * upper - 1e-9) + 1


class Partition:
    """The index of the items of one size class: sorted sketch values, and whose they are."""

    def __init__(self, values: np.ndarray, owners: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The items that have any of these distinct hashes in their sketch."""
        first = np.searchsorted(self.values, hashes, "left")
        n = np.searchsorted(self.values, hashes, "right") - first
        hit = np.flatnonzero(n)
        if not len(hit):
            return np.zeros(0, np.int64)
        n, first = n[hit], first[hit]
        return self.owners[np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]


class Items:
    """A block of item texts: an index per size class, and the texts to verify candidates on."""

    def __init__(self, texts: list[bytes | None], size: int = SHINGLE, threshold: float = THRESHOLD):
        self.size, self.threshold = size, threshold
        self.texts: list[bytes] = []
        self.n_words: list[int] = []
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for text in texts:
            words = words_of(text)
            if not words:
                continue
            sketch = np.unique(shingle_hashes(words, size))
            classes.setdefault(len(sketch).bit_length(), []).append((len(self.texts), sketch[: sketch_size(len(sketch), threshold)]))
            self.texts.append(text)
            self.n_words.append(len(words))
        self.partitions = {k: Partition(np.concatenate([v for _, v in own]), np.repeat([i for i, _ in own], [len(v) for _, v in own])) for k, own in sorted(classes.items())}
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        for p in self.partitions.values():
            self.filter[p.values & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.known: OrderedDict[int, list[bytes]] = OrderedDict()

    def __getstate__(self) -> dict:
        bits = {"filter": np.packbits(self.filter), "known": OrderedDict()}
        return self.__dict__ | bits

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"filter": np.unpackbits(state["filter"]).view(bool)}

    def shingles(self, i: int) -> list[bytes]:
        if i not in self.known:
            words = words_of(self.texts[i])
            width = min(self.size, len(words))
            self.known[i] = sorted({b" ".join(words[j : j + width]) for j in range(len(words) - width + 1)})
            if len(self.known) > _REMEMBERED:
                self.known.popitem(last=False)
        return self.known[i]

    def found_in(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(item, its shingles, shingles found) of the items that the text contains to the threshold."""
        words = words_of(text)
        hashes = shingle_hashes(words, self.size)
        maybe = hashes[self.filter[hashes & np.uint64((1 << _FILTER_BITS) - 1)]]
        if not len(maybe):
            return []
        maybe = np.unique(maybe)
        candidates = np.unique(np.concatenate([p.lookup(maybe) for p in self.partitions.values()])).tolist()
        if not candidates:
            return []
        spaced = b" " + b" ".join(words) + b" "
        out = []
        for i in candidates:
            own = self.shingles(i)
            if min(len(words), self.n_words[i]) < self.size:
                n = int(len(words) == self.n_words[i] and spaced[1:-1] == own[0])
            else:
                n = sum(b" " + s + b" " in spaced for s in own)
            if n >= self.threshold * len(own) - 1e-9:
                out.append((i, len(own), n))
        return out


def _blocks(items: DataFrame, text_col: str, size: int, threshold: float, block_bytes: int) -> Iterator[Items]:
    """Blocks of distinct texts of at most about block_bytes, by hash."""
    texts = items.select(F.col(text_col).cast("binary").alias("text")).where(F.length("text") > 0).distinct()
    total = texts.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else texts
        yield Items(sorted(bytes(r["text"]) for r in part.collect()), size, threshold)


def _pairs(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    block = items.value
    for batch in batches:
        found = [(i, *hit) for i, text in enumerate(batch.column(1)) for hit in block.found_in(text.as_py())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                pa.array([hashlib.md5(block.texts[f[1]]).digest() for f in found], pa.binary()),
                pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.int64()),
            ],
            ["id", "_item_key", "n_shingles", "n_found"],
        )


def _clean(batches: Iterator[pa.RecordBatch], items, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(at).cast(pa.binary())
        yield batch.filter(pa.array([not items.value.found_in(x.as_py()) for x in texts], pa.bool_()))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item_id, n_shingles, n_found): each document row with each item row it contains to the threshold.

    An item of fewer than ``size`` words is one shingle, which only a document
    of just these words contains. Null texts and texts without words contain
    nothing and are in nothing. Ids may be null or repeat: every row counts, of
    documents and of items. A share of exactly the threshold counts. Texts of
    any length are searched whole; other columns don't matter. Without
    documents or items the result is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, _item_key binary, n_shingles long, n_found long"
    found = None
    for block in _blocks(items, item_text, size, threshold, block_bytes):
        own = rows.mapInArrow(partial(_pairs, items=spark.sparkContext.broadcast(block)), schema)
        found = own if found is None else found.unionAll(own)
    told = items.select(F.col(item_id).alias("item_id"), F.unhex(F.md5(F.col(item_text).cast("binary"))).alias("_item_key"))
    if items.count() <= SMALL_TABLE:
        told = F.broadcast(told)
    return found.join(told, "_item_key").select("id", "item_id", "n_shingles", "n_found")


def without_items(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs, all columns, without the rows that contain an item to the threshold.

    Rows with null or empty texts stay, repeated rows too.
    """
    for block in _blocks(items, item_text, size, threshold, block_bytes):
        f = partial(_clean, items=docs.sparkSession.sparkContext.broadcast(block), at=docs.columns.index(text_col))
        docs = docs.mapInArrow(f, docs.schema)
    return docs
