"""Exact set-similarity components by signature trees.

A tree node holds the OR of its sets' token bitmaps, the range of their sizes and the largest number of tokens that
share a bit with another token of the same set. Two nodes are compared by the largest overlap that any of their sets
could have; only pairs of leaves that pass are intersected exactly. Sets already known to be connected are skipped, so
that a group of n near copies costs about n intersections and never n * n rows.

Several small candidate components share a tree (node pairs without a common component are pruned like those of unlike
sizes). Blocks hold at most `block` sets. A larger candidate component is dealt out in chunks: (1) components inside each
chunk, (2) one leader of each of those, compared with each other, (3) every set that is not in the component's largest
group so far, against all chunks. A link missing after (1) has an end that (3) takes up, so none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, stored
from .components import connected_components

BITS = 2048
FANOUT = 4
BLOCK = 1024


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b| for sorted distinct arrays."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * same >= num * (len(both) - same)


class _Tree:
    """Bulk-loaded over sets sorted by group, size and first token; level 0 is the leaves."""

    def __init__(self, sets: list[np.ndarray], group: np.ndarray):
        n = len(sets)
        size = np.array([len(s) for s in sets])
        bits = np.zeros((n, BITS // 64), np.uint64)
        owner = np.repeat(np.arange(n), size)
        place = (np.concatenate(sets) >> np.uint64(11)) % np.uint64(BITS)
        np.bitwise_or.at(bits, (owner, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        shared = size - np.bitwise_count(bits).sum(1)
        #: per level: bitmaps, smallest size, largest size, most tokens beyond the bits, first group, last group
        self.levels = [(bits, size, size, shared, group, group)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, x, g0, g1 = self.levels[-1]
            cut = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(x, cut), g0[cut], np.maximum.reduceat(g1, cut)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs (i <= j) may hold a link, by group, size range and largest possible overlap."""
        b, lo, hi, extra, g0, g1 = self.levels[level]
        ok = (g0[j] <= g1[i]) & (hi[i] * den >= num * lo[j]) & (hi[j] * den >= num * lo[i])
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 13):
            k = np.flatnonzero(ok[at : at + (1 << 13)]) + at
            common = np.bitwise_count(b[i[k]] & b[j[k]]).sum(1, dtype=np.int64)
            most = np.minimum(common + np.minimum(extra[i[k]], extra[j[k]]), np.minimum(hi[i[k]], hi[j[k]]))
            out[k] = most * (den + num) >= num * (lo[i[k]] + lo[j[k]])
        return out

    def pairs(self, num: int, den: int, label: np.ndarray):
        """Dual traversal from the root: batches of leaf pairs (i < j) that may be linked."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
            keep = self.possible(level, i, j, num, den)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            below = len(self.levels[level - 1][0])
            a = (i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
            b = (j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
            ok = (a < below) & (b < below) & ((a < b) if level == 1 else (a <= b))
            a, b = a[ok], b[ok]
            for at in range(0, len(a), 1 << 14):
                stack.append((level - 1, a[at : at + (1 << 14)], b[at : at + (1 << 14)]))


def block_labels(sets: list[np.ndarray], num: int, den: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest position among the sets of its group that chains of links reach; empty sets stay alone."""
    n = len(sets)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def test(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b and linked(sets[i], sets[j], num, den):
            parent[max(a, b)] = min(a, b)

    own = np.zeros(n, np.int64) if group is None else np.asarray(group)
    full = [i for i in range(n) if len(sets[i])]
    if len(full) > 1:
        order = sorted(full, key=lambda i: (own[i], int(sets[i][0]), len(sets[i])))
        for i, j in zip(order, order[1:]):
            if own[i] == own[j]:
                test(i, j)
        order.sort(key=lambda i: (own[i], len(sets[i]), int(sets[i][0])))
        tree = _Tree([sets[i] for i in order], own[order])
        label = np.array([find(i) for i in order])
        for left, right in tree.pairs(num, den, label):
            for i, j in zip(left.tolist(), right.tolist()):
                test(order[i], order[j])
            label[:] = [find(i) for i in order]
    return np.array([find(i) for i in range(n)], np.int64)


def _resolve(batches, as_sets, num: int, den: int):
    """Rows (comp, chunk, node, content) sorted by comp, chunk and node -> (comp, chunk, node, label): one tree over
    several whole groups of about BLOCK sets together."""
    keys, nodes, groups, sets = [], [], [], []

    def done():
        if nodes:
            group, ids = np.array(groups), np.array(nodes, np.int64)
            lab = block_labels(sets, num, den, group)  # nodes ascend in a group: the first position is the smallest node
            comp, chunk = (np.array(x, np.int64) for x in zip(*keys))
            yield pa.record_batch([pa.array(comp[group]), pa.array(chunk[group]), pa.array(ids), pa.array(ids[lab])], ["comp", "chunk", "node", "label"])
            keys.clear(), nodes.clear(), groups.clear(), sets.clear()

    for whole in batches:
        for batch in slices([whole], "content", 1 << 20):
            comp, chunk, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "chunk", "node"))
            new = np.r_[True, (node[1:] != node[:-1]) | (comp[1:] != comp[:-1]) | (chunk[1:] != chunk[:-1])]
            at = np.flatnonzero(new)
            for i, own in zip(at.tolist(), as_sets(batch.column("content").take(pa.array(at)))):
                now = (int(comp[i]), int(chunk[i]))
                if not keys or keys[-1] != now:
                    if len(nodes) >= BLOCK:
                        yield from done()
                    keys.append(now)
                elif groups[-1] == len(keys) - 1 and nodes[-1] == node[i]:
                    continue
                nodes.append(int(node[i]))
                groups.append(len(keys) - 1)
                sets.append(own)
    yield from done()


def resolve(rows: DataFrame, as_sets, num: int, den: int, width: int) -> DataFrame:
    out = rows.select("comp", "chunk", "node", "content").repartition(width, "comp", "chunk").sortWithinPartitions("comp", "chunk", "node")
    return out.mapInArrow(lambda it: _resolve(it, as_sets, num, den), "comp long, chunk long, node long, label long")


def chunked(labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, comp) -> (node, comp, chunk, chunks): candidate components of more than `block` nodes are dealt out by hash."""
    sizes = labels.groupBy("comp").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / block).cast("long")
    return labels.join(sizes, "comp").select("node", "comp", F.pmod(F.xxhash64("node"), chunks).alias("chunk"), chunks.alias("chunks"))


def verified_links(sets: DataFrame, as_sets, num: int, den: int, width: int, has_large: bool) -> DataFrame:
    """(a, b) edges with the components of the links between sets (node, comp, chunk, chunks, content) of one candidate
    component. as_sets makes a list of sorted arrays of 64-bit values of a column of contents: what travels is the text,
    which takes far less room than its shingles. A node may come several times, in several components, with one content."""
    as_edges = lambda t: t.where("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b"))
    if not has_large:
        return as_edges(resolve(sets, as_sets, num, den, width))
    small, large = sets.where("chunks = 1"), stored(sets.where("chunks > 1"), "sets")
    first = stored(resolve(large, as_sets, num, den, width), "chunks")
    # (2) leaders meet, again in blocks
    lead = first.where("node = label").select("comp", "node").join(large.select("comp", "node", "chunks", "content").dropDuplicates(["comp", "node"]), ["comp", "node"])
    counts = lead.groupBy("comp").agg(F.count("*").alias("k"))
    lead = lead.join(counts, "comp").withColumn("chunk", F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.ceil(F.col("k") / BLOCK).cast("long")))
    second = stored(resolve(lead, as_sets, num, den, width), "leaders")
    own = first.select("comp", "node", F.col("label").alias("one"))
    two = second.select("comp", F.col("node").alias("one"), F.col("label").alias("two"))
    state = stored(own.join(two, ["comp", "one"], "left").select("comp", "node", F.coalesce("two", "one").alias("label")), "state")
    # (3) whoever is not in the largest group of its component meets every chunk
    group = state.groupBy("comp", "label").agg(F.count("*").alias("n"))
    top = group.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    rest = large.join(state, ["comp", "node"]).join(top, "comp").where("label <> top")
    blocks = rest.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    rest = rest.join(blocks, "comp").withColumn("part", F.pmod(F.xxhash64(F.col("node"), F.lit(2)), F.col("parts")))
    asked = rest.select("comp", "node", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), F.col("part").alias("p"))
    there = large.join(blocks, "comp").select("comp", "node", "content", F.col("chunk").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    third = asked.unionByName(there).select("comp", (F.col("c") * 1_000_003 + F.col("p")).alias("chunk"), "node", "content")
    edges = as_edges(resolve(small, as_sets, num, den, width)).unionByName(as_edges(state)).unionByName(as_edges(resolve(third, as_sets, num, den, width)))
    edges = stored(edges, "links")
    for t in (large, first, second, state):
        forget(t)
    return edges


def verified_components(sets: DataFrame, as_sets, num: int, den: int, width: int, has_large: bool) -> DataFrame:
    """(node, label) of sets as in `verified_links`, where every node is in one candidate component: label is the smallest
    node that chains of links reach."""
    if not has_large:
        return resolve(sets, as_sets, num, den, width).select("node", "label")
    edges = verified_links(sets, as_sets, num, den, width, True)
    out = connected_components(edges).select("node", F.col("comp").alias("label"))
    forget(edges)
    return out
