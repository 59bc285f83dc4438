"""Connected components of a table of links, by repeated minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dealscope.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of ``links`` (a, b).

    Each round takes the smallest root among the neighbours and then that root's own root, so paths halve. Minima are
    combined before the shuffle; rows of a node with very many links meet only as partial minima.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stage(both, "edges")
    roots = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                  .select("node", F.least("node", "near").alias("root")), "roots")
    while True:
        near = (edges.join(roots.withColumnsRenamed({"node": "b", "root": "near"}), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = stage(lower.join(jump, "next").select("node", "root", F.least("next", "far").alias("next")), "roots")
        roots = moved.select("node", F.col("next").alias("root"))
        if moved.where(F.col("next") != F.col("root")).isEmpty():
            return roots
