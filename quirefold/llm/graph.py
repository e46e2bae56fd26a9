"""Connected components by alternating large-star and small-star steps, all in DataFrame operations.

Every step sends each edge to the smallest neighbour of one of its ends, until all edges are stars around a component's
smallest node. Minima are aggregated before the shuffle and joined back by a join that adaptive execution can split, so
a node with very many neighbours is not gathered in one task. Each round is written to the shared folder, in files
whose number follows that of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.store import materialize


def _least(pairs: DataFrame, rows: int) -> DataFrame:
    """(_k, _m): for each u of (u, v) the smallest of u and its v."""
    return materialize(pairs.groupBy(F.col("u").alias("_k")).agg(F.min("v").alias("_v")).select("_k", F.least("_k", "_v").alias("_m")), "least", rows)


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h"), F.expr("bit_xor(xxhash64(v, u, 7))").alias("g")).first()
    return row["n"], row["h"] or 0, row["g"] or 0


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) without direction -> (node, component = the smallest node reachable). Nodes without edge are absent."""
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, rows = None, edges.count()
    while before != (now := _mark(edges)):
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, 2 * rows)
        large = both.filter("v > u").join(least, F.col("u") == F.col("_k")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = _least(large, rows)  # here v < u on every edge
        small = large.join(least, F.col("u") == F.col("_k")).select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v")
        own = least.select(F.col("_k").alias("u"), F.col("_m").alias("v")).filter("u <> v")
        edges = materialize(small.unionByName(own).distinct(), "edges", rows)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components", 2 * rows)
