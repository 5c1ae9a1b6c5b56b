"""Quality rules with cross-document line frequency.

Base rules look at one document. Then the lines of all documents are hashed in a normal form (lower case, digits as 0,
white space as one space), the distinct documents that hold each line are counted per host (column `source`), and lines
held by more than HOST_SHARE of a host's documents, and by more than LEAST of them, are boilerplate. A document of which less
than KEPT_SHARE of the words would be left without them is rejected. Documents of equal text are one document: copies of a
page don't make its lines boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, documents, sequence_hashes, slices, stored, string_buffers
from .lines import Lines

HOST_SHARE, LEAST = 0.05, 10
KEPT_SHARE = 0.3

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _base(batches):
    for b in slices(batches, "text"):
        data, off = string_buffers(b.column("text"))
        w = Words(data, off, SPACE)
        chars = _per_text(w.inside & ((data & 0xC0) != 0x80), off)
        symbols = _per_text(_SYMBOL[data], off)
        lines = Lines(data, off, w)
        raw = data.tobytes()
        dup, seen, at = np.zeros(b.num_rows, np.int64), set(), -1
        for t, x, y in zip(lines.text.tolist(), lines.start.tolist(), lines.end.tolist()):
            if t != at:
                seen, at = set(), t
            line = raw[x:y]
            if line in seen:
                dup[t] += 1
            seen.add(line)
        g = sequence_hashes(w.hashes(), 5)
        repeated = np.zeros(b.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            if y - x < 6:
                continue
            own = g[x : y - 4]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                twice = order[np.r_[same, False] | np.r_[False, same]]
                cover = np.zeros(y - x + 1, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + 5, -1)
                repeated[i] = np.count_nonzero(np.cumsum(cover)[:-1])
        cols = [np.diff(w.first), chars, symbols, dup, repeated]
        yield pa.record_batch([b.column("doc_id"), b.column("row"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def _lines(batches):
    for b in slices(batches, "text"):
        data, off = string_buffers(b.column("text"))
        data = _NORMAL[data]
        w = Words(data, off, SPACE)
        lines = Lines(data, off, w)
        key = lines.hashes(w.hashes())
        # a line that a text repeats is one row, with all its words
        order = np.lexsort((key, lines.text))
        text, key, count = lines.text[order], key[order], lines.count[order]
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])]) if len(text) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, new) if len(new) else count
        take = pa.array(text[new])
        yield pa.record_batch([*(b.column(c).take(take) for c in ("host", "row", "content")), pa.array(key[new].view(np.int64)), pa.array(total, pa.int64())], ["host", "row", "content", "line", "n_words"])


def _row():
    parts = ("doc_id", "source", "text")
    return F.xxhash64(*parts, *(F.col(c).isNull() for c in parts))  # a hash alone passes over nulls


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row": _row(), "content": F.xxhash64(F.coalesce("text", F.lit("")), F.lit(7)), "host": F.coalesce("source", F.lit(""))})


def frequent_lines(docs: DataFrame, max_documents: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All (host, row, content, line, n_words), and the (host, line, n_docs) above the limit: max_documents, or if that is
    None the greater of LEAST and HOST_SHARE of the host's documents."""
    keyed = _keyed(docs)
    lines = stored(keyed.select("host", "row", "content", "text").mapInArrow(_lines, "host string, row long, content long, line long, n_words long"), "lines")
    counts = lines.select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    if max_documents is not None:
        above = counts.where(F.col("n_docs") > max_documents)
    else:
        hosts = keyed.select("host", "content").distinct().groupBy("host").agg(F.greatest(F.lit(float(LEAST)), HOST_SHARE * F.count("*")).alias("limit"))
        above = counts.where(F.col("n_docs") > LEAST).join(hosts, "host").where("n_docs > limit").drop("limit")
    return lines, stored(above, "frequent")


def _verdicts(docs: DataFrame, lines: DataFrame, frequent: DataFrame, kept_share: float) -> DataFrame:
    lost = lines.join(frequent, ["host", "line"]).dropDuplicates(["row", "line"]).groupBy("row").agg(F.sum("n_words").alias("lost"))
    base = _keyed(docs).select("doc_id", "row", "text").mapInArrow(_base, "doc_id long, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = base.join(lost, "row", "left").withColumn("n_frequent_words", F.coalesce("lost", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_frequent_words") >= kept_share * F.col("n_words"))
    return out.select("doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_frequent_words")


def quality_rules(docs: DataFrame, max_documents: int | None = None, kept_share: float = KEPT_SHARE) -> DataFrame:
    """(doc_id, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_frequent_words)
    per row of docs (doc_id, text, source).

    Null and empty texts have no words and fail. A null source is a host of its own (the empty name). Repeated rows get
    equal verdicts. A line held by just as many documents as the limit stays. Texts of any length are read whole. An empty
    table gives an empty one. Other columns are ignored.
    """
    return _verdicts(docs, *frequent_lines(docs, max_documents), kept_share)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("row")


def _without(batches, names: list[str]):
    """Texts without the lines whose hashes are in `_quern_drop`."""
    for b in slices(batches, "text"):
        drop = b.column("_quern_drop").to_pylist()
        text = b.column("text")
        if any(drop):
            data, off = string_buffers(text)
            w = Words(_NORMAL[data], off, SPACE)
            lines = Lines(data, off, w)
            key = lines.hashes(w.hashes()).view(np.int64)
            cut = np.searchsorted(lines.text, np.arange(b.num_rows + 1))
            texts = text.to_pylist()
            for i, d in enumerate(drop):
                if d:
                    x, y = cut[i], cut[i + 1]
                    gone = set(lines.number[x:y][np.isin(key[x:y], d)].tolist())
                    texts[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in gone)
            text = pa.array(texts, pa.string())
        yield pa.record_batch([text if n == "text" else b.column(n) for n in names], names)


def apply_rules(docs: DataFrame, max_documents: int | None = None, kept_share: float = KEPT_SHARE) -> DataFrame:
    """docs without the documents that the rules reject and, in the others, without the lines above the limit."""
    lines, frequent = frequent_lines(docs, max_documents)
    verdict = stored(_verdicts(docs, lines, frequent, kept_share).where("kept").select("row", "n_frequent_words").distinct(), "verdicts")
    hit = verdict.where("n_frequent_words > 0").select("row")
    drop = lines.join(frequent.select("host", "line"), ["host", "line"]).join(hit, "row").groupBy("row").agg(F.collect_set("line").alias("_quern_drop"))
    plan = verdict.select("row").join(drop, "row", "left").withColumnRenamed("row", "_quern_row")
    rows = docs.withColumn("_quern_row", _row()).join(plan, "_quern_row").select(*docs.columns, "_quern_drop")
    names = docs.columns
    return rows.mapInArrow(lambda it: _without(it, names), docs.schema)
