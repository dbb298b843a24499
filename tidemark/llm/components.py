"""Connected components by alternating large and small stars, in DataFrame aggregates and joins.

Each round lets every node point at the smallest node it knows; the number of rounds grows with the logarithm of
the component's diameter. Hubs are aggregated before the shuffle, and the joins are plain equi-joins,
which adaptive execution splits where a hub is hot. State is a table in the shared folder, written each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (src > dst). Large: neighbours above a node move to its minimum; small: those below it, and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        smallest = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        moved = both.join(smallest, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        smallest = edges.groupBy("src").agg(F.min("dst").alias("low"))
        below = edges.join(smallest, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        moved = below.unionByName(smallest.select("src", F.col("low").alias("dst")))
    return moved.where("src <> dst").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(src, dst))")).first()
    return tuple(row)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) for each node of ``links`` (src, dst). No row for others."""
    ordered = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    edges = materialise(ordered.where("src <> dst").distinct(), "links")
    before = _state(edges)
    if before[0]:
        for _ in range(max_rounds):
            old, edges = edges, materialise(_star(_star(edges, large=True), large=False), "stars")
            discard(old)
            after = _state(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
