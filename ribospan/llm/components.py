"""Connected components of links, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links(a, b)``; the root is the component's smallest node.

    A round gives each node the smallest root among its neighbours and then its root's root, so
    roots travel twice as far each time. Each round is written and reread: a lost executor costs
    its tasks, not the rounds before. Links without an end are none; without links the result
    is empty.
    """
    edges = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(edges.union(edges.select("b", "a")).distinct())
    roots = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    total = F.sum(F.col("root").cast("decimal(20,0)"))
    before = roots.agg(total).first()[0]
    while before is not None:
        near = (
            edges.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        moved = materialize(roots.join(near, "node").select("node", F.least("root", "near").alias("root")))
        above = moved.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = materialize(moved.join(above, "root").select("node", F.least("root", "above").alias("root")))
        after = roots.agg(total).first()[0]
        if after == before:
            break
        before = after
    return roots
