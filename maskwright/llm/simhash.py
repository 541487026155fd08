"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints: XXH64 over word shingles, majority vote per bit. Candidates:
the 64 bits are cut into ``blocks`` pieces; two fingerprints that differ in at
most ``radius`` bits agree on some ``blocks - radius`` pieces, so each
fingerprint is filed once under every such choice (exact, by pigeonhole).
Within a file the fingerprints are held as vertical bit planes: one pass over
the planes updates the distances of 64 pairs per machine word with carry-save
counters, and words whose pairs have all passed the radius are abandoned.

Skew: equal fingerprints are collapsed first. A file larger than ``tile`` is
cut into chunks and every pair of chunks is a task of its own, so no file has
to fit one task. Each task emits at most one link per row (a spanning forest
of what it found), so groups of copies never expand into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, stored
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = 5
TILE = 512

_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)
_MOST = 1 << 18  # shingles hashed at once; longer texts are counted piece by piece


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; null or no words: 0."""
    words = (text or b"").lower().split()  # bytes: A-Z only, white space \x20 \x09-\x0d only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(2048, np.int64)
    for at in range(0, len(starts), _MOST):
        part = [digest(joined[i:j], seed) for i, j in zip(starts[at : at + _MOST], stops[at : at + _MOST], strict=True)]
        lanes = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.bincount((lanes + _LANE).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS_OF_BYTE).ravel()
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        values = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) with fp the fingerprint's 64 bits as a signed long; one row per row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle, seed=seed), "id long, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of n values, with spare words for shifts past the end."""
    n = len(values)
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    packed = np.zeros((64, (n // 64 + 2) * 8), np.uint8)
    lines = np.packbits(bits, axis=1, bitorder="little")
    packed[:, : lines.shape[1]] = lines
    return packed.view(np.uint64)


def _mask_words(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    line = np.packbits(mask, bitorder="little")
    out[: len(line)] = line
    return out.view(np.uint64)


def _lowest_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label[i], label[j]):
            return label


def bit_sliced_links(values: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For values in runs of equal ``run``: the index of the smallest member each is linked to.

    Links are pairs of one run at most ``radius`` (up to 3) bits apart, followed transitively.
    """
    n = len(values)
    label = np.arange(n)
    if n < 2:
        return label
    ends = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(n)  # rows after this one in its run
    longest = int(left.max())
    if not longest:
        return label
    planes = _planes(values)
    words = planes.shape[1]
    found_i: list[np.ndarray] = []
    found_j: list[np.ndarray] = []
    held = 0
    for shift in range(1, longest + 1):
        valid = _mask_words(left >= shift, words - 1)
        at = np.flatnonzero(valid)
        if not len(at):
            break
        valid = valid[at]
        jump, turn = divmod(shift, 64)
        ones, twos, over = (np.zeros(len(at), np.uint64) for _ in range(3))
        for plane in range(64):
            line = planes[plane]
            other = line[np.minimum(at + jump, words - 1)]
            if turn:
                other = (other >> np.uint64(turn)) | (line[np.minimum(at + jump + 1, words - 1)] << np.uint64(64 - turn))
            differ = line[at] ^ other
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if plane % 16 == 15:
                alive = (valid & ~over) != 0
                if not alive.all():  # abandon the blocks that hold no pair within reach
                    at, valid, ones, twos, over = at[alive], valid[alive], ones[alive], twos[alive], over[alive]
                if not len(at):
                    break
        if not len(at):
            continue
        near = valid & ~over
        if radius < 3:
            near &= ~twos if radius == 1 else ~(ones & twos) if radius == 2 else ~(ones | twos)
        bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, col = np.nonzero(bits)
        i = at[row] * 64 + col
        found_i.append(i)
        found_j.append(i + shift)
        held += len(i)
        if held > 1_000_000:
            label = _lowest_labels(label, np.concatenate(found_i), np.concatenate(found_j))
            found_i, found_j, held = [np.arange(n)], [label.copy()], 0
    if found_i:
        label = _lowest_labels(label, np.concatenate(found_i), np.concatenate(found_j))
    return label


def _tile_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, t1, t2, fp) sorted by tile -> links (a, b); only the last tile is carried over."""
    held: list[np.ndarray] = []

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        bucket, t1, t2, fp = cols
        new = np.ones(len(fp), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
        label = bit_sliced_links(np.ascontiguousarray(fp), np.cumsum(new), radius)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    for batch in batches:
        cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = np.ones(len(cols[0]), bool)
        for x in cols[:3]:
            same &= x == x[-1]
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if first:
            yield links([x[:first] for x in cols])
        held = [x[first:] for x in cols]
    if held:
        yield links(held)


def _bucket_columns(blocks: int, radius: int) -> list:
    """One bucket number per choice of blocks - radius of the pieces."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = 0
        for i in chosen:
            mask |= ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed))))
    return out


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """distinct(fp) -> links (a, b) that span the groups of fingerprints within radius."""
    spark = distinct.sparkSession
    filed = distinct.select("fp", F.explode(F.array(*_bucket_columns(blocks, radius))).alias("bucket"))
    hot = stored(filed.groupBy("bucket").count().where(F.col("count") > tile).select("bucket", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("chunks")), "hot")
    chunk = F.expr("cast(pmod(xxhash64(fp), chunks) as int)")
    tiled = (
        filed.join(hot, "bucket", "left")
        .withColumn("mine", F.when(F.col("chunks").isNull(), 0).otherwise(chunk))
        .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
        .select("bucket", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "fp")
    )
    rows = tiled.repartition(shuffle_partitions(spark), "bucket", "t1", "t2").sortWithinPartitions("bucket", "t1", "t2", "fp")
    return rows.mapInArrow(partial(_tile_links, radius=radius), "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, blocks: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables (id, fp), a row per row of docs, and (fp, component_id, root), a row per fingerprint."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius, blocks, tile))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(lows, "root").select("fp", "component_id", "root"), "named")
    discard(distinct)
    return marked, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id, root): one row per row of docs; component_id is the smallest id reachable.

    root is the smallest fingerprint of the group (as signed longs).

    Null and empty texts and texts without words have fingerprint 0 and form one
    group. Repeated rows stay. A null id keeps its row; ids are compared as
    longs and a group without any id has component_id null. Other columns don't
    matter, whatever their names. Empty in, empty out.
    """
    marked, named = _grouped(docs, id_col, text_col, shingle, radius, blocks, tile)
    return marked.join(named, "fp").select("id", "fp", "component_id", "root")


def _with_fingerprint(batches: Iterator[pa.RecordBatch], at: int, name: str, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(at).cast(pa.binary())), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], [*batch.schema.names, name])


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: the one of the smallest id.

    Rows without id stay only if their group has no id at all. Where ids repeat
    or are null, a row is told by its id and fingerprint, and of rows equal in
    both one stays.
    """
    parts = _grouped(docs, id_col, text_col, shingle, radius, blocks, tile)
    marked = stored(parts[0].join(parts[1], "fp").select("id", "fp", "component_id", "root"), "groups")
    discard(*parts)
    ids = marked.groupBy("id").count().agg(F.max("count"), F.max(F.col("id").isNull())).first()
    if ids[0] is None or (ids[0] == 1 and not ids[1]):
        kept = marked.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("_kept_id"))
        return docs.join(kept, docs[id_col].cast("long") == kept["_kept_id"], "left_semi")

    name = "_fingerprint"
    while name in docs.columns:
        name += "_"
    # an id in several groups keeps a row in each, so groups are told by root; rows of one id and group: smallest fingerprint
    with_id = (
        marked.where(F.col("id") == F.col("component_id"))
        .groupBy("id", "root")
        .agg(F.min("fp").alias("_kept_fp"))
        .select(F.col("id").alias("_kept_id"), "_kept_fp")
    )
    bare = marked.where(F.col("component_id").isNull()).select(F.col("root").alias("_kept_fp")).distinct()
    without_id = bare.select(F.lit(None).cast("long").alias("_kept_id"), "_kept_fp")
    kept = stored(with_id.unionAll(without_id), "kept")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` long"])
    told = docs.mapInArrow(partial(_with_fingerprint, at=docs.columns.index(text_col), name=name, shingle=shingle), schema)
    rows = told.join(kept, told[id_col].cast("long").eqNullSafe(kept["_kept_id"]) & (told[name] == kept["_kept_fp"]), "left_semi")
    return rows.dropDuplicates([id_col, name]).drop(name)
