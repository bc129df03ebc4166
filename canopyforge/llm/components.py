"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, name: str = "edges", rows: int | None = None) -> DataFrame:
    """edges (a, b: long, not null) to (node, root): root is the least node reachable. Nodes that no edge joins to another
    are left out; loops and repeated edges do no harm; no edges give no rows.

    Every step keeps, of a node's neighbours, only links to the least one (Kiveris et al., 2014: O(log^2 n) steps), so that a
    node with very many neighbours is one row for each, never a list. Each step is written to the shared folder. rows: about
    how many different edges there are, if that is known; it bounds nothing but the files of the first step.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, name, rows)
    state = _state(e)
    while n := state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join deals both sides anew and can split a node with very many neighbours
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name, 2 * n)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, name, 2 * n)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), name, 2 * n)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, name, 2 * n)
        if (now := _state(e)) == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
