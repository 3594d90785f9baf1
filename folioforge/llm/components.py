"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import delete, written

#: A key of more rows than this is hot. Of n rows at most n / HOT_ROWS keys are hot, and only their labels are broadcast.
HOT_ROWS = 200_000
#: Hot keys that are broadcast at most (rows of two nodes); where there are more, they are shuffled as all others.
HOT_KEYS = 500_000


def _hot(rows: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame | None, str | None]:
    """The keys of more than ``hot_rows`` rows as a written table of ``hot``, and its path; None if there are none, or too many for a broadcast."""
    found, at = written(rows.groupBy(F.col(key).alias("hot")).count().where(F.col("count") > hot_rows).select("hot"), "hot")
    if 0 < found.count() <= HOT_KEYS:
        return found, at
    delete(rows.sparkSession, at)
    return None, None


def _labelled(rows: DataFrame, key: str, labels: DataFrame, hot: DataFrame | None, name: str) -> DataFrame:
    """The rows with ``name``, the label of the node in ``key``; every key has one. A hot key's rows stay where they are, and its label goes to
    them; the other rows and labels are shuffled. So no task gets more than ``hot_rows`` rows of one key."""
    told = labels.select(F.col("node").alias("_node"), F.col("component").alias(name))
    if hot is None:
        return rows.join(told, F.col(key) == F.col("_node")).drop("_node")
    few = told.join(F.broadcast(hot), F.col("_node") == F.col("hot"), "left_semi")
    many = rows.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left_anti").join(told, F.col(key) == F.col("_node"))
    return many.unionByName(rows.join(F.broadcast(few), F.col(key) == F.col("_node"))).drop("_node")


def connected_components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For links (a, b) of any orderable type: node and component, its component's smallest node.

    Nodes are those in links; repeated links and those of a node to itself count once or not at all, links with a null are left out.
    Each round takes the smallest label among neighbours, and the label of the own label; the labels are written to the
    shared folder after every round. A hub, with links to very many nodes, and the label that a large component's nodes share, are
    hot keys of the joins: their labels are broadcast to the rows instead.
    """
    spark = links.sparkSession
    pairs = links.select("a", "b").where("a <> b")
    both, both_at = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hubs, hubs_at = _hot(both, "b", hot_rows)
    start = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels, at = written(start, "labels")
    while True:
        shared, shared_at = _hot(labels, "component", hot_rows)
        near = _labelled(both, "b", labels, hubs, "near").groupBy(F.col("a").alias("at")).agg(F.min("near").alias("near"))
        far = _labelled(labels, "component", labels, shared, "far")
        low = F.least("near", "far")
        new, new_at = written(far.join(near, F.col("node") == F.col("at")).select("node", F.least("component", low).alias("component"), (low < F.col("component")).alias("moved")), "labels")
        for path in (at, shared_at):
            if path:
                delete(spark, path)
        moved = new.where("moved").limit(1).count()
        labels, at = new.select("node", "component"), new_at
        if not moved:
            for path in (both_at, hubs_at):
                if path:
                    delete(spark, path)
            return labels
