"""Connected components by randomised contraction.

In every round each node points to the neighbour, itself included, whose hash is least in this round, and the graph is
contracted along these pointers; the expected number of nodes shrinks by a constant factor.  Pointers are then composed
from the last round to the first.  Every step is a join or an aggregation of edges; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.base import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node of an edge, one node of its component, the same for all of them.

    Edges may repeat and may go either way; those with a null end or equal ends are left out.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges, pointers = stage(edges, "edges"), []
    while True:
        both = edges.union(edges.select("b", "a"))
        salt = F.lit(len(pointers) * 7919 + 17)
        # struct(hash, node): the least by hash, the node itself as one of the choices
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("n"))
        pointer = stage(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["n"].alias("to")), "pointers")
        if pointer.isEmpty():
            break
        pointers.append(pointer)
        left = pointer.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = pointer.select(F.col("node").alias("b"), F.col("to").alias("y"))
        joined = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = stage(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not pointers:
        return pointer.select("node", F.col("to").alias("root"))
    roots = pointers.pop()
    roots = roots.select("node", F.col("to").alias("root"))
    while pointers:  # a node that the next round no longer has is a root already
        earlier = pointers.pop()
        later = roots.select(F.col("node").alias("to"), "root")
        roots = stage(earlier.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots
