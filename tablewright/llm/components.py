"""Connected components of a graph that is given as a table of edges.

Every round contracts the graph: a node points to the smallest of itself and
its neighbours, pointers are followed to their roots, and edges between roots
form the next, smaller graph. Only grouped minima and equi-joins run, so a hub
node costs a partial aggregate, not one large group; joins on a hub are plain
sort-merge joins that adaptive execution may split. Each round is written to
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _follow(pointers: DataFrame) -> DataFrame:
    """(node, root): pointers followed until none moves."""
    while True:
        up = pointers.select(F.col("node").alias("root"), F.col("root").alias("above"))
        pointers = checkpoint(pointers.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
        if pointers.filter("moved").isEmpty():
            return pointers.select("node", "root")
        pointers = pointers.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order, repeats and loops allowed, nulls ignored.

    Returns (node, root): every node that has an edge to another one, with the
    smallest node of its component. No edges: no rows.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    graph = checkpoint(both.union(both.select("b", "a")).distinct())
    result = None
    while not graph.isEmpty():
        near = graph.groupBy("a").agg(F.min("b").alias("least"))
        step = _follow(near.select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        if result is None:
            result = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            result = checkpoint(result.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root")))
        a, b = (step.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        graph = checkpoint(graph.join(a, "a").join(b, "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    return result if result is not None else graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
