"""N-gram Jaccard join: documents linked when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Verification is by signature trees (`signature_tree`). To spread that over a cluster, documents are first brought
together by necessary shared shingles, in four exact steps (nothing that could link is dropped):

1. Equal sets are one class; from here on a class stands for its documents.
2. In hash order, two linked sets share at least l(n) of their first n - ceil(0.75 n) + l(n) shingles, for
   l(n) = 1 + n div 4 and the smaller n. These prefixes go to buckets by hash range, each bucket counts in how many
   classes a shingle occurs and tells the classes their shingles with two or more.
3. A class of which fewer than l(ceil(0.75 n)) prefix shingles occur elsewhere has no partner. The others need only the
   s - l + 1 rarest of their s shared shingles (ordered by class count, then hash) to meet every partner.
4. Classes connected through those rare shingles form a candidate component, in which a signature tree finds the links.

Shingles are 64-bit hashes of their words; step 2 uses 32 bits within a bucket, which can only add candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, digest, documents, forget, shingle_sets, shuffle_width, slices, stored, string_buffers
from .components import connected_components, spanning_edges
from .signature_tree import BLOCK, chunked, verified_components

NUM, DEN, SHINGLE = 75, 100, 5
#: Node lists of up to so many ids are broadcast (8 bytes each); longer ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _sets(texts, k: int) -> list[np.ndarray]:
    """The shingle sets of a column of texts."""
    words = Words(*string_buffers(texts), SPACE, lower=True)
    return shingle_sets(words.hashes(), words.first, k)


def classes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, node, row): node is a 64-bit fingerprint of the document's set, null for an empty set; row is
    a hash of the text, which with doc_id tells rows apart."""

    def run(batches):
        for b in slices(batches, "text"):
            sets = _sets(b.column("text"), k)
            n = np.array([len(s) for s in sets])
            node = pa.array([digest(s) for s in sets], pa.int64(), mask=n == 0)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), node, b.column("row")], ["doc_id", "n_shingles", "node", "row"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, n_shingles long, node long, row long")


def _prefixes(batches, buckets: int, k: int, num: int, den: int):
    """A row for each slice and bucket: the slice's classes, and (32-bit shingle, index of class) of their prefixes."""
    seen: set[int] = set()
    for b in slices(batches, "text"):
        ids, need, tok = [], [], []
        for s in _sets(b.column("text"), k):
            if not len(s) or (node := digest(s)) in seen:
                continue
            seen.add(node)
            n = len(s)
            share = n // 4 + 1
            prefix = min(n, n - -(-n * num // den) + share)
            least = -(-n * num // den)
            need.append(min(least // 4 + 1, least))
            ids.append(node)
            tok.append(s[:prefix])
        if not ids:
            continue
        yield from bucketed(np.array(ids, np.int64), np.array(need, np.uint32), np.repeat(np.arange(len(ids)), [len(t) for t in tok]), np.concatenate(tok), buckets)


def bucketed(ids: np.ndarray, need: np.ndarray, own: np.ndarray, tok: np.ndarray, buckets: int):
    """Record batches of one row a bucket: ids and need of some nodes, and the 64-bit tokens that they own (`own`
    ascending indices of ids) as a 32-bit value and a 16-bit place among the row's ids."""
    for lo in range(0, len(ids), 60_000):
        x, y = np.searchsorted(own, [lo, lo + 60_000])
        o, t = own[x:y], tok[x:y]
        if x == y:
            continue
        # the low 32 bits travel, remixed ones choose the bucket
        bucket = (((t * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, o, t = bucket[order], o[order], (t[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        start = np.r_[True, bucket[1:] != bucket[:-1]]
        new = start | np.r_[True, o[1:] != o[:-1]]
        cut, place = np.r_[np.flatnonzero(start), len(bucket)], np.cumsum(new) - 1
        first = place[cut[:-1]]
        ref = (place - np.repeat(first, np.diff(cut))).astype(np.uint16)
        here, idcut = o[new], np.r_[first, int(new.sum())]
        blobs = (_blobs(ids[here], idcut), _blobs(need[here], idcut), _blobs(ref, cut), _blobs(t, cut))
        yield pa.record_batch([pa.array(bucket[cut[:-1]]), *blobs], ["bucket", "ids", "need", "ref", "tok"])


def _blobs(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary column: the bytes of the values between neighbouring cuts."""
    off = (cut * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


BUCKETED = "bucket long, ids binary, need binary, ref binary, tok binary"


def shared_tokens(rows: DataFrame, width: int) -> DataFrame:
    """(node, need, tok, df) for each token that two or more nodes of `bucketed` rows own."""
    return rows.repartition(width, "bucket").mapInArrow(_shared, "node long, need int, tok long, df int")


def _shared(batches):
    """All rows of some buckets -> (node, need, shingle, classes) for shingles of two or more classes."""
    node, need, tok = [], [], []
    for b in batches:
        for bucket, ids, least, ref, t in zip(*(b.column(c).to_pylist() for c in ("bucket", "ids", "need", "ref", "tok"))):
            r = np.frombuffer(ref, np.uint16)
            node.append(np.frombuffer(ids, np.int64)[r])
            need.append(np.frombuffer(least, np.uint32)[r])
            tok.append(np.frombuffer(t, np.uint32).astype(np.int64) | (bucket << 32))
    if not node:
        return
    node, need, tok = np.concatenate(node), np.concatenate(need), np.concatenate(tok)
    order = np.argsort(tok, kind="stable")
    same = tok[order[1:]] == tok[order[:-1]]
    order = order[np.r_[same, False] | np.r_[False, same]]  # shingles that occur once go early
    node, need, tok = node[order], need[order], tok[order]
    order = np.lexsort((node, tok))
    node, need, tok = node[order], need[order], tok[order]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])] if len(tok) else np.zeros(0, bool)
    node, need, tok = node[new], need[new], tok[new]
    _, inv, count = np.unique(tok, return_inverse=True, return_counts=True)
    df = count[inv] if len(tok) else count
    keep = df >= 2
    for x in range(0, int(keep.sum()), 1 << 16):
        k = np.flatnonzero(keep)[x : x + (1 << 16)]
        yield pa.record_batch([pa.array(node[k]), pa.array(need[k].astype(np.int32)), pa.array(tok[k]), pa.array(df[k].astype(np.int32))], ["node", "need", "tok", "df"])


def _rarest(batches):
    """All shared shingles of some classes -> (key, node) for the rarest ones that each class needs."""
    got = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "need", "tok", "df")] for b in batches if b.num_rows]
    if not got:
        return
    node, need, tok, df = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((tok, df, node))
    node, need, tok = node[order], need[order], tok[order]
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    count = np.diff(np.r_[start, len(node)])
    place = np.arange(len(node)) - np.repeat(start, count)
    keep = place < np.repeat(count, count) - need + 1
    yield pa.record_batch([pa.array(tok[keep]), pa.array(node[keep])], ["key", "node"])


def candidate_components(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, comp): classes that may have a link, by candidate component (steps 2 to 4)."""
    width = shuffle_width(docs.sparkSession)
    buckets = 4 * width
    blobs = docs.select("text").mapInArrow(lambda it: _prefixes(it, buckets, k, num, den), BUCKETED)
    shared = shared_tokens(blobs, width).repartition(width, "node")
    return connected_components(spanning_edges(shared, width, _rarest))


def labelled(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, row, label) of each row of docs; rows of one component have one label, rows without a
    shingle none."""
    width = shuffle_width(docs.sparkSession)
    own = stored(classes(docs, k), "classes")
    found = candidate_components(docs, k, num, den)
    cand = stored(chunked(found, block), "candidates")
    forget(found)
    facts = cand.agg(F.count("*").alias("n"), F.coalesce(F.max("chunks"), F.lit(0)).alias("c")).first()
    one = own.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("one"))
    one = one.join(cand, "node").select(F.col("one.doc_id").alias("one_id"), F.col("one.row").alias("one_row"), "node", "comp", "chunk", "chunks")
    if facts["n"] <= BROADCAST_IDS:
        one = F.broadcast(one)
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").alias("content"))
    texts = texts.join(one, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("row") == F.col("one_row"))).select("node", "comp", "chunk", "chunks", "content")
    labels = stored(verified_components(texts, lambda column: _sets(column, k), num, den, width, facts["c"] > 1), "links")
    forget(cand)
    return own.join(labels, "node", "left").select("doc_id", "n_shingles", "row", F.coalesce("label", "node").alias("label"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; more columns are ignored).

    Null and empty texts, and texts of white space, have no shingles and are their own component. A repeated row is a
    copy and gets the same component; a null doc_id is no id and never becomes a component's id unless all are null.
    Texts of any length are used whole. No limit is put on the size of a group. An empty table gives an empty one.
    """
    grouped = labelled(docs, k, num, den, block)
    least = grouped.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = grouped.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (null ids first), then of the smallest text hash.

    Of rows with one doc_id and text one stays; rows without a shingle are no copies of anything and all others of them
    stay. Only repeated rows are shuffled with their texts.
    """
    rows = stored(labelled(docs), "labelled")
    one = rows.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("one")).where("label is not null").select("one.*")
    place = one.unionByName(rows.where("label is null").select("doc_id", "row"))
    times = rows.groupBy("doc_id", "row").agg(F.count("*").alias("_quern_times"))
    keep = stored(place.distinct().alias("p").join(times.alias("t"), F.expr("p.doc_id <=> t.doc_id and p.row <=> t.row")).select(F.col("p.doc_id").alias("_quern_id"), F.col("p.row").alias("_quern_row"), "_quern_times"), "kept")
    forget(rows)
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(F.col("_quern_id")) & (F.xxhash64(docs["text"]) == F.col("_quern_row")))
    single = kept.where("_quern_times = 1").select(*docs.columns)
    return single.unionByName(kept.where("_quern_times > 1").dropDuplicates(["_quern_id", "_quern_row"]).select(*docs.columns))
