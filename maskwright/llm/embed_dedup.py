"""Embedding near-duplicates by an exact metric range join.

On unit vectors cosine >= t is Euclidean distance <= r = sqrt(2 - 2t). Vectors
are compared within their label and dimension only, so every such group has a
partition of its own: a tree of balls around pivots, grown from a bounded
sample. A split puts the vectors within rho of its pivot inside and the others
outside. By the triangle inequality a vector outside can only be within r of
one inside if it is within rho + r of the pivot: those in that shell go inside
too, as guests. Two vectors within r then meet in exactly one leaf where they
weren't both guests of the same split, and the leaves (cells) are joined
independently. A split is only made where the pairs it saves, in the sample,
outweigh its guests: vectors that lie all alike far from each other can't be
parted at this radius by any distance to a pivot, and stay one cell.

The triangle inequality also settles pairs without comparing them: all vectors
within r / 2 of a pivot (its core) are linked. Cores only weigh in the counts,
so a large group of near copies costs no comparisons among itself.

In a cell the distances to the span of a few pivots bound the cosine from
above, and only pairs that the bound lets through are compared in full.

Equal vectors are collapsed first and only weigh in the counts. A cell of more
than ``tile`` rows (fewer where they are long) is cut into chunks and each pair of chunks is a task of its
own. Links are never listed: a task returns, per row, its number of links and
one link of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, stored
from .components import connected_components
from .simhash import _lowest_labels

THRESHOLD = 0.98
PIVOTS = 256  # splits of all trees together
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16 << 20
SMALLEST = 256  # a cell of fewer rows (estimated) isn't split
WORTH = 0.05  # the share of a cell's pairs that a split has to save besides what its guests cost
SPAN = 16  # pivots that bound the cosine within a cell
TILE = 16384  # rows of a tile, fewer where they are long: a tile's vectors hold TILE_BYTES at most
TILE_BYTES = 32 << 20
SMALL_TABLE = 100_000  # rows of (key, number) that may be broadcast
_SLACK = 1e-9


def unit(values: list | None) -> bytes | None:
    """The vector divided by its length, as doubles; None if it can link with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return (x / np.sqrt(x @ x)).tobytes()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = pa.array([unit(x.as_py()) for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), units], ["id", "label", "unit"])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


# ---- trees ----


@dataclass
class Split:
    """pivot: its number in the tree; inside and outside: the next split of either side, or minus one minus the cell."""

    pivot: int
    rho: float
    inside: int = 0
    outside: int = 0


@dataclass
class Tree:
    pivots: np.ndarray
    splits: list[Split]

    def place(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, guest): the cells of each row; bit k of guest: the row is a guest of split k's inside."""
        if not self.splits:
            return np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros((len(x), 1), np.uint64)
        d = distances(x, self.pivots)
        words = (len(self.splits) + 63) // 64
        done: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(0, np.arange(len(x)), np.zeros((len(x), words), np.uint64))]
        while todo:
            k, rows, guest = todo.pop()
            if not len(rows):
                continue
            if k < 0:
                done.append((rows, -1 - k, guest))
                continue
            s = self.splits[k]
            own = d[rows, s.pivot]
            inside = own <= s.rho
            shell = ~inside & (own <= s.rho + radius + _SLACK)
            marked = guest[shell].copy()
            marked[:, k // 64] |= np.uint64(1 << (k % 64))
            todo.append((s.outside, rows[~inside], guest[~inside]))
            todo.append((s.inside, np.concatenate((rows[inside], rows[shell])), np.concatenate((guest[inside], marked))))
        return np.concatenate([r for r, _, _ in done]), np.concatenate([np.full(len(r), c) for r, c, _ in done]), np.concatenate([g for _, _, g in done])

    def core(self, x: np.ndarray, radius: float) -> np.ndarray:
        """The first pivot that the row is within half the radius of, else -1."""
        if not len(self.pivots):
            return np.full(len(x), -1, np.int32)
        near = distances(x, self.pivots) <= radius / 2 - _SLACK
        return np.where(near.any(axis=1), near.argmax(axis=1), -1).astype(np.int32)


def best_split(x: np.ndarray, radius: float, tries: int = 12) -> tuple[float, np.ndarray, float] | None:
    """(share of pairs saved beyond the guests' cost, pivot, rho) of the best ball over the rows, if any is worth it.

    Pivots tried: the middles of the densest surroundings, and farthest-first points.
    """
    n = len(x)
    if n < 8:
        return None
    small = x.astype(np.float32)
    dense = (small @ small.T >= 1 - radius**2 / 2).sum(axis=1)
    tried = []
    covered = np.zeros(n, bool)
    for i in np.argsort(-dense, kind="stable"):
        if len(tried) >= tries or dense[i] < 4:
            break
        if not covered[i]:
            near = x @ x[i] >= 1 - radius**2 / 2
            covered |= near
            middle = x[near].mean(axis=0)
            if (length := np.sqrt(middle @ middle)) > 0:
                tried.append(middle / length)
    far = distances(x, x[:1])[:, 0]
    for _ in range(4):
        i = int(far.argmax())
        tried.append(x[i])
        far = np.minimum(far, distances(x, x[i : i + 1])[:, 0])
    best = None
    for pivot in tried:
        d = np.sort(distances(x, pivot[None])[:, 0])
        ends = np.unique(np.concatenate((np.linspace(1, n - 1, 64).astype(int), np.flatnonzero(np.diff(d) > radius) + 1)))
        rho = d[ends - 1] + np.maximum(_SLACK, (d[ends] - d[ends - 1] - radius) / 2)
        inside = np.searchsorted(d, rho, "right")
        shell = np.searchsorted(d, rho + radius, "right") - inside
        after = inside**2 / 2 + inside * shell + (n - inside) ** 2 / 2
        gain = 1 - after / (n**2 / 2) - shell / n
        k = int(gain.argmax())
        if gain[k] >= WORTH and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), pivot, float(rho[k]))
    return best


def grow(x: np.ndarray, scale: float, radius: float, most: int = PIVOTS) -> Tree:
    """A tree over a sample x that stands for ``scale`` rows each."""
    pivots: list[np.ndarray] = []
    splits: list[Split] = []
    cells = 0

    def node(rows: np.ndarray) -> int:
        nonlocal cells
        found = best_split(rows, radius) if len(rows) * scale >= SMALLEST and len(splits) < most else None
        if found is None:
            cells += 1
            return -cells
        _, pivot, rho = found
        k = len(splits)
        splits.append(Split(len(pivots), rho))
        pivots.append(pivot)
        d = distances(rows, pivot[None])[:, 0]
        splits[k].inside = node(rows[d <= rho + radius])
        splits[k].outside = node(rows[d > rho])
        return k

    node(x)
    return Tree(np.array(pivots).reshape(len(pivots), x.shape[1]), splits)


def grow_all(sample: dict[str, np.ndarray], scale: float, radius: float, most: int = PIVOTS) -> dict[str, Tree]:
    """The trees of the groups that are split at all, the largest groups first."""
    out = {}
    for name in sorted(sample, key=lambda g: (-len(sample[g]), g)):
        if most > 0 and len(sample[name]) * scale >= SMALLEST:
            tree = grow(sample[name], scale, radius, most)
            if tree.splits:
                out[name] = tree
                most -= len(tree.splits)
    return out


# ---- cells ----

_CELLS = "grp string, cell int, core int, guest binary, node long, weight long, unit binary"


def _cells(batches: Iterator[pa.RecordBatch], trees, radius: float) -> Iterator[pa.RecordBatch]:
    """Distinct vectors (grp, node, weight, unit) -> a row per cell."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            names, raw = np.array(part.column(0).to_pylist(), object), part.column(3).to_pylist()
            row, cell, core, guest = [], [], [], []
            split = np.array([name in trees.value for name in names], bool)
            row.append(np.flatnonzero(~split))
            cell.append(np.zeros(len(row[0]), np.int32))
            core.append(np.full(len(row[0]), -1, np.int32))
            guest += [b""] * len(row[0])
            for name in dict.fromkeys(names[split].tolist()):
                own, tree = np.flatnonzero(names == name), trees.value[name]
                x = np.frombuffer(b"".join(raw[i] for i in own)).reshape(len(own), -1)
                r, c, g = tree.place(x, radius)
                row.append(own[r])
                cell.append(c.astype(np.int32))
                core.append(tree.core(x, radius)[r])
                guest += [m.tobytes() if m.any() else b"" for m in g]
            take = pa.array(np.concatenate(row).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), pa.array(np.concatenate(cell)), pa.array(np.concatenate(core)), pa.array(guest, pa.binary()), *(part.column(i).take(take) for i in (1, 2, 3))],
                ["grp", "cell", "core", "guest", "node", "weight", "unit"],
            )


# ---- tiles ----


def _bounds(x: np.ndarray) -> np.ndarray:
    """Rows whose products bound those of x from above: the part in the span of a few rows, and the length of the rest."""
    k = min(SPAN, x.shape[1], len(x))
    span, _ = np.linalg.qr(x[np.linspace(0, len(x) - 1, k).astype(int)].T)
    inner = x @ span
    rest = np.sqrt(np.maximum(0.0, 1 - (inner**2).sum(axis=1)))
    return np.column_stack((inner, rest)).astype(np.float32)


def tile_links(x: np.ndarray, chunk: np.ndarray, core: np.ndarray, guest: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one tile: (weight linked to each row, index of the smallest row of its local component, pairs compared in full).

    chunk: which of the tile's two chunks a row is in; with both present only
    pairs across them count. Pairs of one core, and pairs of guests of the same
    split, are left out: the first are known, the second met elsewhere.
    """
    n = len(x)
    links, label, compared = np.zeros(n, np.int64), np.arange(n), 0
    left, right = (np.flatnonzero(chunk == c) for c in (0, 1))
    across = len(right) > 0
    if not across:
        right = left
    short = x.shape[1] > 2 * SPAN
    b = _bounds(x) if short else None
    right_x = x[right]
    for at in range(0, len(left), 512):
        mine = left[at : at + 512]
        if short:
            maybe = b[mine] @ b[right].T >= threshold - 1e-4
        else:
            maybe = np.ones((len(mine), len(right)), bool)
        if not across:  # each pair once
            maybe &= np.arange(len(right)) > np.arange(at, at + len(mine))[:, None]
        if (core[mine] >= 0).any() and (core[right] >= 0).any():
            maybe &= (core[mine][:, None] != core[right]) | (core[right] < 0)
        for word in range(guest.shape[1]):
            if guest[mine, word].any() and guest[right, word].any():
                maybe &= (guest[mine, word][:, None] & guest[right, word]) == 0
        count = int(np.count_nonzero(maybe))
        compared += count
        if 20 * count > maybe.size:
            near = maybe & (x[mine] @ right_x.T >= threshold)
            i, j = np.nonzero(near)
        else:
            i, j = np.nonzero(maybe)
            good = np.concatenate([np.einsum("ij,ij->i", x[mine[i[a : a + 65536]]], right_x[j[a : a + 65536]]) >= threshold for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            i, j = i[good], j[good]
        if len(i):
            links += np.bincount(mine[i], weight[right[j]], n).astype(np.int64) + np.bincount(right[j], weight[mine[i]], n).astype(np.int64)
            label = _lowest_labels(label, mine[i], right[j])
    return links, label, compared


def _guest_words(guests: list[bytes]) -> np.ndarray:
    words = max((len(g) for g in guests), default=0) // 8
    return np.frombuffer(b"".join(g.ljust(8 * words, b"\0") for g in guests), np.uint64).reshape(len(guests), words)


def _join_tiles(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile -> (node, links, root); one tile at a time is held."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = np.frombuffer(b"".join(t.column("unit").to_pylist())).reshape(t.num_rows, -1)
        node, weight, core, mine, t1 = (t.column(c).to_numpy() for c in ("node", "weight", "core", "mine", "t1"))
        guest = _guest_words(t.column("guest").to_pylist())
        order = np.argsort(node, kind="stable")  # so that the smallest row is the smallest node
        links, label, _ = tile_links(x[order], (mine != t1)[order].astype(int), core[order], guest[order], weight[order], threshold)
        node = node[order]
        told = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        return pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(links[told]), pa.array(node[label[told]])], ["node", "links", "root"])

    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if keys[a] != key and held:
                yield joined(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield joined(held)


def _tiled(cells: DataFrame, tile: int) -> DataFrame:
    """The rows of each cell dealt to the tiles they have to be in.

    A cell that fits one tile is one. Of a larger one each core is cut into
    chunks of its own, and so are the other rows; a row goes to the tiles of its
    chunk with every chunk but those of its own core.
    """
    counts = cells.groupBy("grp", "cell", "core").count()
    whole = Window.partitionBy("grp", "cell")  # a row per core: at most as many as pivots
    pieces = F.ceil(F.col("count") / (tile // 2)).cast("int")
    hot = (
        counts.withColumn("total", F.sum("count").over(whole))
        .where(F.col("total") > tile)
        .select("grp", "cell", "core", pieces.alias("pieces"))
        .withColumn("chunks", F.sum("pieces").over(whole).cast("int"))
        .withColumn("first", (F.sum("pieces").over(whole.orderBy("core")) - F.col("pieces")).cast("int"))
    )
    hot = stored(hot, "hot")
    if hot.count() <= SMALL_TABLE:
        hot = F.broadcast(hot)
    elsewhere = "filter(sequence(0, chunks - 1), o -> core < 0 or o < first or o >= first + pieces)"
    return (
        cells.join(hot, ["grp", "cell", "core"], "left")
        .withColumn("mine", F.expr("if(chunks is null, 0, first + cast(pmod(xxhash64(unit), pieces) as int))"))
        .withColumn("other", F.explode(F.expr(f"if(chunks is null, array(0), {elsewhere})")))
        .select("grp", "cell", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "mine", "core", "guest", "node", "weight", "unit")
    )


def _sample(classes: DataFrame) -> tuple[dict[str, np.ndarray], float, int]:
    """(vectors by group, rows that each stands for, bytes of the longest) of the smallest hashes, bounded in rows and bytes."""
    n, longest = classes.agg(F.count("*"), F.max(F.octet_length("unit"))).first()
    if not n:
        return {}, 1.0, 8
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // longest))
    found = classes.select("grp", "unit").orderBy(F.xxhash64("unit"), "unit", "grp").limit(rows).collect()
    by_group: dict[str, list[bytes]] = {}
    for r in found:
        by_group.setdefault(r["grp"], []).append(r["unit"])
    return {g: np.frombuffer(b"".join(u)).reshape(len(u), -1) for g, u in by_group.items()}, n / len(found), longest


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id): one row per row of vectors.

    Vectors are compared when their labels are equal, not null, and their
    dimensions are equal. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without id or label, link with nothing:
    n_links 0, component_id their id. Repeated rows are vectors of their own;
    different vectors under one id count their links together. A cosine of exactly the threshold links. Other columns don't matter, whatever
    their names; an empty table gives an empty one.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    marked = rows.mapInArrow(_units, "id long, label string, unit binary")
    able = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    name = F.unhex(F.md5(F.concat(F.encode("label", "UTF-8"), F.lit(b"|"), F.col("unit"))))
    marked = stored(marked.withColumn("class", F.when(able, name)), "units")
    group = F.concat_ws(":", F.octet_length("unit").cast("string"), "label").alias("grp")
    distinct = marked.where(F.col("class").isNotNull()).groupBy("class", "label", "unit").agg(F.min("id").alias("node"), F.count("*").alias("weight"))
    classes = stored(distinct.select("class", group, "node", "weight", "unit"), "classes")

    sample, scale, longest = _sample(classes)
    trees = grow_all(sample, scale, radius)
    tile = max(16, min(tile, TILE_BYTES // longest))
    shared = spark.sparkContext.broadcast(trees)  # at most PIVOTS vectors
    cells = classes.select("grp", "node", "weight", "unit").mapInArrow(partial(_cells, trees=shared, radius=radius), _CELLS)
    placed = _tiled(cells, tile).repartition(shuffle_partitions(spark), "grp", "cell", "t1", "t2").sortWithinPartitions("grp", "cell", "t1", "t2")
    found = stored(placed.mapInArrow(partial(_join_tiles, threshold=threshold), "node long, links long, root long"), "links")

    # rows of one core are linked, by the triangle inequality; a core has at most one row per vector
    in_core = cells.where(F.col("core") >= 0).select("grp", "core", "node", "weight", F.xxhash64("unit")).distinct()
    cores = in_core.groupBy("grp", "core").agg(F.min("node").alias("root"), F.sum("weight").alias("total"))
    by_core = stored(in_core.join(F.broadcast(cores), ["grp", "core"]).select("node", (F.col("total") - F.col("weight")).alias("links"), "root"), "cores")
    found = found.unionAll(by_core)

    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        classes.select("class", "node", "weight")
        .join(linked, "node", "left")
        .join(roots, "node", "left")
        .select("class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    named = stored(named, "named")
    discard(classes)
    known = marked.where(F.col("class").isNotNull()).select("id", "class").join(named, "class")
    alone = marked.where(F.col("class").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.select("id", F.col("links").cast("long").alias("n_links"), F.col("root").alias("component_id")).unionAll(alone)
