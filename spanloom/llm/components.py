"""Connected components of an edge table, wholly distributed.

Every round takes each node to the least of itself and its neighbours, follows these pointers to their ends by
doubling, and keeps the edges between different ends only: a dense group is one node after a round, so its edges
are read once.  At least half of the nodes that still have edges go in a round.  Only sums of labels reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, keep


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges(src, dst)``; root is the component's smallest node.

    Null ends and self-loops are ignored, repeated edges count once, an empty table gives an empty table.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    e = keep(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "cc-edges")
    labels = None
    for _ in range(max_rounds):
        roots = _jumped(keep(e.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("root")), "cc-roots"))
        if labels is None:
            labels = roots
        else:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels, old = keep(labels.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "cc-labels"), labels
            forget(old)
        ends = e.join(roots.select(F.col("node").alias("src"), F.col("root").alias("s")), "src").join(roots.select(F.col("node").alias("dst"), F.col("root").alias("d")), "dst")
        e, old = keep(ends.where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct(), "cc-edges"), e
        forget(old)
        if roots is not labels:
            forget(roots)
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    forget(e)
    return labels


def _jumped(roots: DataFrame) -> DataFrame:
    """``roots(node, root)``, each node's root a smaller node or itself, with the end of each node's path instead."""
    total = _total(roots)
    while total is not None:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = keep(roots.join(above, "root").select("node", F.col("above").alias("root")), "cc-roots")
        forget(roots)
        roots, before, total = jumped, total, _total(jumped)
        if total == before:
            break
    return roots


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
