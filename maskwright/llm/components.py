"""Connected components of an edge table, by alternating large-star and small-star steps.

The steps only use grouped minima (combined before the shuffle) and equi-joins
that adaptive execution may split where a node is hot, so no node's neighbours
ever meet in one task and nothing but two numbers a round reaches the driver.
Every round is written to shared storage and the round before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node long, root long) for every node but the roots.

    The root is the smallest node of the component. Self links, repeated and
    null edges don't matter; an empty table gives an empty table.
    """
    edges = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        smallest = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .where(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(lowest.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        last, edges = edges, stored(small, "edges")
        discard(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
