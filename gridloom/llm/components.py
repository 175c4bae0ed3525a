"""Connected components of a large graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import save


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns (id, root) for each end of an edge; root is the same for all that are connected.

    Each round every node points at its smallest neighbour if that is smaller, pointers are doubled until they end, and the
    edges are rewritten between those ends and made distinct. The graph shrinks by a factor each round, and rounds
    go on until no edge is left, so the depth of a component sets no limit. Only whether rows are left reaches the driver. Each step is
    saved, and small ones, whose size is known then, are joined without a shuffle.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "step")
        moving = True
        while moving:  # pointers of pointers, until all point at their last one
            for _ in range(2):
                up = step.select(F.col("a").alias("p"), F.col("p").alias("q"))
                step = step.join(up, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved"))
            step = save(step, "step")
            moving = not step.where("moved").isEmpty()
            step = step.select("a", "p")
        if roots is None:
            roots = step.select(F.col("a").alias("id"), F.col("p").alias("root"))
        else:
            roots = roots.join(step.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        roots = save(roots, "roots")
        left, right = step.select("a", F.col("p").alias("x")), step.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = save(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")) if roots is None else roots
