"""Distributed connected components over an edge table: min-label hooking with contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n vertices over the edges a-b (dense indices)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (root, other) with the same components as the edges a-b of any ids."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = local_labels(inv[: len(a)], inv[len(a) :], len(ids))
    other = np.flatnonzero(lab != np.arange(len(ids)))
    return ids[lab[other]], ids[other]


def _low_pointers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, p), the smallest neighbour, and (u, label): the smallest neighbour's smallest neighbour of each end of an edge, itself counted as its neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "pointers")
    return low, stored(low.alias("x").join(low.select(F.col("u").alias("q"), F.col("p").alias("label")), F.col("p") == F.col("q")).select("u", "label"), "labels")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each end of an edge, comp the smallest node reached.

    Edges with a null end are ignored; loops and repeated edges change nothing; an empty table gives an empty one.
    Each round sends every node to its smallest neighbour's smallest neighbour and goes on with the edges between
    different labels only, so that a round's table is a fraction of the one before; at the end the rounds' labels are
    composed, the smallest tables first. Minima are combined before the shuffle; a label that many nodes share is a hot key
    of one side of a join only, which AQE splits. The rounds' tables go to the shared folder.
    """
    at = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    graph, steps = stored(at.distinct(), "graph"), []
    while not steps or not graph.isEmpty():
        low, labels = _low_pointers(graph)
        forget(low)
        steps.append(labels)
        of_u = labels.select("u", F.col("label").alias("lu"))
        of_v = labels.select(F.col("u").alias("v"), F.col("label").alias("lv"))
        across = graph.join(of_u, "u").join(of_v, "v").select("lu", "lv")
        # a label that was sent on itself stays joined to where it went
        moved = labels.select(F.col("label").alias("lu")).distinct().join(labels.select(F.col("u").alias("lu"), F.col("label").alias("lv")), "lu")
        rest = across.unionByName(moved).where("lu <> lv").select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct()
        new = stored(rest, "graph")
        forget(graph)
        graph = new
    forget(graph)
    final = steps.pop()
    while steps:
        here = steps.pop()
        after = final.select(F.col("u").alias("l"), F.col("label").alias("then"))
        out = stored(here.join(after, here.label == after.l, "left").select("u", F.coalesce("then", "label").alias("label")), "labels")
        forget(here)
        forget(final)
        final = out
    out = final.select(F.col("u").alias("node"), F.col("label").alias("comp"))
    out._quern_path = final._quern_path
    return out


def spanning_edges(spark_rows: DataFrame, width: int, keyed=None) -> DataFrame:
    """(a, b) edges that join all nodes sharing a key, of rows (key, node): a star per key and task first, so that a
    key of any size sends one row a task through the shuffle, then a star over what is left of each key. keyed, if given,
    makes the (key, node) batches of a task's rows, in the same Python worker: two operators in one stage keep twice as
    many workers, which stay with their memory for all later stages."""
    made = keyed or (lambda it: it)
    tasks = spark_rows.mapInArrow(lambda it: _stars(made(it), True), "key long, a long, b long")
    local = stored(tasks, "stars")
    rest = local.where("key is not null").select("key", F.col("a").alias("node")).repartition(width, "key").mapInArrow(lambda it: _stars(it, False), "key long, a long, b long")
    return local.where("key is null").select("a", "b").unionByName(rest.select("a", "b"))


def _stars(batches, forward: bool):
    """Rows (null, root, node) of a forest, and with forward (key, node, null) for one node of each key."""
    got = [(b.column("key").to_numpy(zero_copy_only=False), b.column("node").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not got:
        return
    key, node = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    head = np.r_[True, key[1:] != key[:-1]]
    start = np.flatnonzero(head)
    centre = np.repeat(node[start], np.diff(np.r_[start, len(key)]))
    if forward:
        yield pa.record_batch([pa.array(key[start], pa.int64()), pa.array(node[start], pa.int64()), pa.nulls(len(start), pa.int64())], ["key", "a", "b"])
    keep = node != centre
    if keep.any():
        root, other = forest(centre[keep], node[keep])
        yield pa.record_batch([pa.nulls(len(root), pa.int64()), pa.array(root, pa.int64()), pa.array(other, pa.int64())], ["key", "a", "b"])
