"""Connected components by alternating star contractions, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    Ids are longs. Null ends and self-links are ignored; repeated and reversed links count once; no edges, no rows.
    Each round sets aside the nodes with one neighbour, a smaller one, whose root is that neighbour's, and contracts what
    is left; at the end the nodes set aside get their roots, the last first. What a round leaves is written to shared
    storage. A node with very many links is met by aggregates that combine before the shuffle and by joins that adaptive
    execution can split, never gathered in one task.
    """
    e = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u is not null and v is not null and u != v").distinct()
    e, leaves = written(e), []
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        leaf = near.where("n = 1 and m < u").select(F.col("u").alias("node"), F.col("m").alias("parent"))
        leaves.append(leaf)
        rest = e.join(leaf, e["u"] == leaf["node"], "left_anti")
        large = rest.join(near.select(F.col("u").alias("c"), "m"), F.col("v") == F.col("c")).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        e = written(small)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))  # of no rows
    for leaf in reversed(leaves):
        of = roots.select(F.col("node").alias("parent"), "root")
        roots = cut(roots.unionAll(leaf.join(of, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
