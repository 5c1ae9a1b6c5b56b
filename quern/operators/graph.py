"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared_folder


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): the smallest node that edges a-b reach, by minimum labels until nothing changes."""
    # both directions of one pass: a union would compute the edges twice
    ends = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    graph = _checkpointed(edges.select(F.inline(F.array(ends(a, b), ends(b, a)))).distinct())
    labels = graph.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp"))
    while True:
        labels = _checkpointed(labels)
        near = graph.join(labels, graph.v == labels.node).groupBy("u").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        hop = labels.select(F.col("node").alias("root"), F.col("comp").alias("root_comp"))
        new = _checkpointed(step.join(hop, step.comp == hop.root).select("node", "old", F.least("comp", "root_comp").alias("comp")))
        labels = new.select("node", "comp")
        if not new.where("old <> comp").limit(1).count():
            return labels
