"""Connected components of a graph given as edges, by alternating star contractions.

Each round points every node at the smallest neighbour it knows, first for larger neighbours, then
for smaller ones, until every component is a star around its smallest node.  The number of rounds
grows with the logarithm of the longest path.  Edges are written to the shared folder between
rounds; neighbours of a node are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import join_split, written


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Edges (u, v) with u > v after one contraction of ``edges``, of which there are ``total``."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")))
    met = join_split(both, least, "u", total)
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return written(out.filter("u <> v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def component_roots(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u that isn't the smallest of its component; v is that smallest node.

    ``edges`` has long columns u and v; direction, loops and repeats don't matter.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        edges = _star(_star(edges, 2 * state[0], True), 2 * state[0], False)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
