"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

Words are runs of ASCII letters and digits and of anything beyond ASCII, lower-cased in A-Z. A window is 10 neighbouring
words of a benchmark item (the whole item if it is shorter). A window occurs in a document only if each of its shingles
of 3 words does, so its necessary prefix is one shingle: the rarest. Rarity is counted over all documents, of the
benchmark's shingles only. A document joins a window where that shingle stands; the shingle's place in the window then
bounds where the window must start and end, and the words there are compared exactly, byte by byte.

The benchmark is joined in blocks of WINDOWS_PER_BLOCK windows, each broadcast (at most about 100 bytes a word), so that
a benchmark of any size has bounded memory; every block meets all documents. With more than one block the documents get
a stored unique row id first, by which alone the blocks' hits of a row are put together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, documents, forget, sequence_hashes, slices, stored, string_buffers

WINDOW, SHINGLE = 10, 3
WINDOWS_PER_BLOCK = 200_000


def _words(text: str | None) -> list[bytes]:
    data, off = string_buffers(pa.array([text], pa.string()))
    w = Words(data, off, NOT_ALNUM, lower=True)
    raw = w.data.tobytes()
    return [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return Words(data, np.array([0, len(data)]), NOT_ALNUM).hashes()


def windows(items: list[tuple[str, list[bytes]]], window: int) -> list[tuple[str, list[bytes]]]:
    """(item_id, words) of every distinct window of an item."""
    out = {}
    for item, words in items:
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            out[item, tuple(words[i : i + size])] = None
    return [(item, list(w)) for item, w in out]


def _shingles(words: list[bytes], k: int) -> np.ndarray:
    h = _hashes(words)
    return sequence_hashes(h, min(k, len(h)))


class WindowIndex:
    """The windows of one block by their rarest shingle."""

    def __init__(self, block: list[tuple[str, list[bytes]]], rarity: dict[int, int], k: int):
        rows = []
        for i, (_, words) in enumerate(block):
            g = _shingles(words, k)
            at = min(range(len(g)), key=lambda j: (rarity.get(int(g[j]), 0), int(g[j])))
            rows.append((int(g[at]), min(k, len(words)), at, i))
        self.items = [item for item, _ in block]
        self.words = [words for _, words in block]
        #: by shingle length: sorted keys, and (place of the shingle in the window, window) of each
        self.by_length = {}
        for n in {r[1] for r in rows}:
            own = sorted((key, at, i) for key, m, at, i in rows if m == n)
            self.by_length[n] = (np.array([r[0] for r in own], np.uint64), np.array([r[1] for r in own]), np.array([r[2] for r in own]))

    def occurrences(self, w: Words):
        """(window, first word) of each place in a slice where a window occurs; the caller's texts are `w.first`."""
        h = w.hashes()
        raw = w.data.tobytes()
        start, end = w.start, w.end
        text_end = np.repeat(w.first[1:], np.diff(w.first))
        text_start = np.repeat(w.first[:-1], np.diff(w.first))
        for n, (keys, place, window) in self.by_length.items():
            g = sequence_hashes(h, n)
            lo = np.searchsorted(keys, g, "left")
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == g)
            if not len(hit):
                continue
            lo, hi = lo[hit], np.searchsorted(keys, g[hit], "right")
            for x, a, b in zip(hit.tolist(), lo.tolist(), hi.tolist()):
                for j in range(a, b):
                    i = int(window[j])
                    words, first = self.words[i], x - int(place[j])
                    last = first + len(words)
                    if first < text_start[x] or last > text_end[x]:  # positional and length bounds
                        continue
                    if all(raw[start[first + m] : end[first + m]] == v for m, v in enumerate(words)):
                        yield i, first, last


def rarity_counts(docs: DataFrame, shingles: np.ndarray, lengths: list[int]) -> dict[int, int]:
    """In how many documents each of the benchmark's shingles occurs, over all documents."""
    keys = np.unique(shingles)

    def run(batches):
        total = np.zeros(len(keys), np.int64)
        for b in slices(batches, "text"):
            w = Words(*string_buffers(b.column("text")), NOT_ALNUM, lower=True)
            h, owner = w.hashes(), np.repeat(np.arange(b.num_rows), np.diff(w.first))
            for n in lengths:
                g = sequence_hashes(h, n)
                at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == g)
                hit = hit[owner[hit] == owner[hit + n - 1]]
                pair = np.unique(np.stack([owner[hit], at[hit]]), axis=1)
                np.add.at(total, pair[1], 1)
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(keys[k].view(np.int64)), pa.array(total[k])], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {int(np.int64(r["shingle"]).view(np.uint64)): r["n"] for r in rows.toLocalIterator()}  # no more rows than shingles asked for


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items array) per row of docs (doc_id, text).

    n_hit counts the words inside any occurrence of a window of any item, n_items the items with such windows. Null and
    empty texts have no words and no hits; items without words match nothing; repeated items and repeated rows are
    treated alike; an empty benchmark gives zeros; other columns are ignored.
    """
    spark = docs.sparkSession
    items = [(str(r["item_id"]), _words(r["text"])) for r in benchmark.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator()]
    every = windows(items, window)
    found = None
    if every:
        grams = [(_shingles(words, k), min(k, len(words))) for _, words in every]
        rarity = rarity_counts(docs, np.concatenate([g for g, _ in grams]), sorted({n for _, n in grams}))
    texts = docs.select("doc_id", "text")
    blocks = range(0, max(1, len(every)), WINDOWS_PER_BLOCK)
    numbered = stored(texts.withColumn("row", F.monotonically_increasing_id()), "rows") if len(blocks) > 1 else texts.withColumn("row", F.lit(0).cast("long"))
    for at in blocks:
        index = WindowIndex(every[at : at + WINDOWS_PER_BLOCK], rarity, k) if every else None
        shared = spark.sparkContext.broadcast(index)
        part = numbered.mapInArrow(lambda it, s=shared: _scan(it, s), "doc_id long, row long, n_words long, hits binary, items array<string>")
        if len(blocks) > 1:
            part = stored(part, "hits")
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:
        forget(numbered)
        merged = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = merged.mapInArrow(_merged, "doc_id long, n_words long, n_hit long, items array<string>")
    else:
        found = found.select("doc_id", "n_words", (F.length("hits") / 8).cast("long").alias("n_hit"), "items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items"
    )


def _scan(batches, shared):
    index = shared.value
    for b in slices(batches, "text"):
        data, off = string_buffers(b.column("text"))
        w = Words(data, off, NOT_ALNUM, lower=True)
        n = b.num_rows
        hit = np.zeros(len(w) + 1, np.int64)
        owner = np.repeat(np.arange(n), np.diff(w.first))
        items: list[set] = [set() for _ in range(n)]
        for i, first, last in index.occurrences(w) if index else ():
            hit[first] += 1
            hit[last] -= 1
            items[owner[first]].add(index.items[i])
        inside = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        cut = np.searchsorted(inside, w.first)
        hits = [(inside[x:y] - f).tobytes() for x, y, f in zip(cut[:-1], cut[1:], w.first[:-1])]
        yield pa.record_batch(
            [b.column("doc_id").cast(pa.int64()), b.column("row"), pa.array(np.diff(w.first), pa.int64()), pa.array(hits, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
            ["doc_id", "row", "n_words", "hits", "items"],
        )


def _merged(batches):
    for b in batches:
        n = [len(np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in h]))) for h in b.column("h").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("n_words"), pa.array(n, pa.int64()), b.column("items")], ["doc_id", "n_words", "n_hit", "items"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_quern_id"))
    return docs.join(bad.distinct(), docs["doc_id"].eqNullSafe(F.col("_quern_id")), "left_anti")
