"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges(a long, b long); two nodes share a root if links connect them.

    Each round gives every node a random rank, moves it to the best-ranked of itself and its
    neighbours, and keeps the edges that still join different nodes; their number shrinks by a
    constant factor in expectation, whatever the shape. No edges: no rows. Self-links: the node alone.
    """
    edges = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    n = edges.count()
    roots = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots", 2 * n)
    nodes = roots.count()
    step, loops = 0, edges
    edges = edges.where("a <> b")
    while n and not edges.isEmpty():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("rank"), c.alias("to"))
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy(F.col("a").alias("from")).agg(F.min(rank(F.col("b"))).alias("near"))
        moves = written(best.select("from", F.least("near", rank(F.col("from")))["to"].alias("to")), "moves", min(nodes, 2 * n))
        old = (roots, edges, loops)
        loops = None
        roots = written(
            roots.join(moves, roots["root"] == moves["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots", nodes
        )
        left = moves.select(F.col("from").alias("a"), F.col("to").alias("a2"))
        right = moves.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = written(moved.where("a <> b").distinct(), "edges", n)
        n = edges.count()
        discard(*old, moves)
    discard(edges, loops)
    return roots
