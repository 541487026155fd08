"""Near-duplicates of embeddings and texts, components, against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from maskwright.llm import components, embed_dedup, simhash


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, x) for x in range(1001, 1200)]
    mixed = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    edges = chain + star + mixed + [(5, 5), (3, 2)] + [(-9, 4000)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.connected_components(df.limit(0)).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, " \t\n", "one", "one two", "One TWO", "one two three", "one two three four", "Ünicode ÀB cd é", "a " * 5000, "x\x0by\x0cz q", "one two three four", "no break space here"]


def test_fingerprints(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(TEXTS)}


def near_values(rng, n):
    base = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randrange(0, 6)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_links(radius):
    rng = random.Random(radius)
    for _ in range(20):
        values = near_values(rng, rng.randrange(1, 300))
        run = np.sort(np.array([rng.randrange(3) for _ in values]))
        label = simhash.bit_sliced_links(np.array(values, np.uint64).view(np.int64), run, radius)
        links = [(i, j) for i, j in combinations(range(len(values)), 2) if run[i] == run[j] and (values[i] ^ values[j]).bit_count() <= radius]
        assert dict(enumerate(label.tolist())) == groups(range(len(values)), links)


@pytest.mark.parametrize("tile", [512, 16])
def test_near_links_equal_brute_force(spark, tile):
    rng = random.Random(9)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in near_values(rng, 400)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = components.connected_components(simhash.near_links(df, tile=tile))
    got = {r["node"]: r["root"] for r in found.collect()}
    links = [(a, b) for a, b in combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert got == {n: r for n, r in groups(values, links).items() if n != r}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "one"), (None, "alone in the world of rows")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, root string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    empties = {r["component_id"] for r in got if r["id"] in (0, 1, 2)}
    assert empties == {0}
    assert {r["component_id"] for r in got if r["id"] == 3} == {3}
    assert sorted((r["component_id"] is None) for r in got if r["id"] is None) == [False, True]
    kept = simhash.without_near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None)[0] == (0, "")
    assert len([r for r in kept if r["text"] == "one"]) == 1 and any(r["doc_id"] is None for r in kept)
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "root"}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.without_near_duplicates(df.limit(0)).count() == 0


def vectors(rng, n, dim):
    centres = rng.normal(size=(max(1, n // 6), dim))
    out = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.05, 0.2, 0.6], n)[:, None]
    return out


def brute(rows):
    def usable(v):
        return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    links, counts = [], {}
    for (i, a, la), (j, b, lb) in combinations(rows, 2):
        if la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
            continue
        x, y = np.array(a, float), np.array(b, float)
        if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links.append((i, j))
            counts[i], counts[j] = counts.get(i, 0) + 1, counts.get(j, 0) + 1
    return counts, groups([r[0] for r in rows], links)


@pytest.mark.parametrize(("dim", "tile"), [(3, 2048), (3, 24), (16, 40), (64, 2048)])
def test_embeddings_equal_brute_force(spark, dim, tile):
    rng = np.random.default_rng(dim + tile)
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors(rng, 300, dim))]
    rows += [(900 + i, rows[i][1], rows[i][2]) for i in range(40)]  # exact copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [float("nan")] * dim, 1), (2004, [None] * dim, 1), (2005, rows[0][1], None), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [float("inf")] + [1.0] * (dim - 1), 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, unit string").repartition(4)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, tile=tile).collect()}
    counts, component = brute(rows)
    assert got == {r[0]: (counts.get(r[0], 0), component[r[0]]) for r in rows}


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id long, embedding array<float>").selectExpr("*", "cast(null as int) as label")
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def linked_in_cells(x, tree, radius, threshold=0.98):
    """(pairs linked by cells and cores, each as often as it is found; pairs compared in full)."""
    row, cell, guest = tree.place(x, radius)
    core = tree.core(x, radius)
    found, compared = [(i, j) for i, j in combinations(range(len(x)), 2) if core[i] == core[j] >= 0], 0
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        own = row[at]
        compared += embed_dedup.tile_links(x[own], np.zeros(len(at), int), core[own], guest[at], np.ones(len(at), np.int64), threshold)[2]
        for i, j in combinations(range(len(at)), 2):
            if not (guest[at[i]] & guest[at[j]]).any() and not core[own[i]] == core[own[j]] >= 0 and x[own[i]] @ x[own[j]] >= threshold:
                found.append(tuple(sorted((int(own[i]), int(own[j])))))
    return found, compared


@pytest.mark.parametrize("dim", [2, 3, 8, 64])
def test_cells_meet_every_link_once(dim, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SMALLEST", 20)
    rng = np.random.default_rng(dim)
    x = vectors(rng, 240, dim)
    x = np.concatenate((x, x[0] + 0.02 * rng.normal(size=(120, dim)) * np.linalg.norm(x[0]) / math.sqrt(dim)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = math.sqrt(2 - 2 * 0.98)
    tree = embed_dedup.grow(x[::3], 3, radius)
    assert tree.splits  # the group of near copies is worth a split
    found, compared = linked_in_cells(x, tree, radius)
    near = x @ x.T >= 0.98
    assert sorted(found) == [(i, j) for i, j in combinations(range(len(x)), 2) if near[i, j]]
    assert compared < len(x) * (len(x) - 1) / 2


def test_few_pairs_are_compared_in_full():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ones = np.ones(len(x), np.int64)
    links, _, compared = embed_dedup.tile_links(x, 0 * ones, -ones, np.zeros((len(x), 0), np.uint64), ones, 0.98)
    assert not links.any() and compared < 0.01 * len(x) ** 2 / 2


def test_a_hot_core_takes_no_tiles(spark):
    """A third of the rows are near copies within half the radius of one another: no tile holds two of them alone."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 32))
    x[:300] = x[0] + 0.03 * rng.normal(size=(300, 32))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, tile=64).collect()}
    counts, component = brute(rows)
    assert got == {r[0]: (counts.get(r[0], 0), component[r[0]]) for r in rows} and counts[0] == 299
