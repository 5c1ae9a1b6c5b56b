"""Language identification by words first, then character n-grams.

A known word scores by its log frequency in each language. An unseen word falls back to the longest of its character
n-grams (5 down to 1, with word edges) that any language knows, averaged over its positions. A text's language is the
one with the largest sum over all its words, its score the posterior probability.

Fitted on at most SAMPLE distinct labelled texts, drawn by hash within each language (a stated bound); every text is
scored whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, documents, slices

SAMPLE = 6000
WORDS, GRAMS, LONGEST = 50_000, 30_000, 5
CACHE = 300_000
_BACKOFF = 0.4


def _words(text: str) -> list[str]:
    """Runs of letters of a lower-case text."""
    out: list[str] = []
    for chunk in text.split():
        if chunk.isalpha():
            out.append(chunk)
        else:
            out.extend("".join(c if c.isalpha() else " " for c in chunk).split())
    return out


class Model:
    """Rows of scores by language in one table: row 0 is zero, then known words, then n-grams with the price of backing off."""

    def __init__(self, languages: list[str], words: dict[str, Counter], priors: dict[str, int]):
        self.languages = languages
        total = sum(priors.values())
        self.prior = np.log(np.array([priors[x] / total for x in languages]))
        self.word: dict[str, int] = {}
        self.gram: dict[str, int] = {}
        self._rows: list[np.ndarray] = [np.zeros((1, len(languages)))]
        self._size = 1
        self._learn(self.word, words, WORDS, 0.0)
        for n in range(1, LONGEST + 1):
            grams = {x: Counter() for x in languages}
            for x in languages:
                for w, c in words[x].items():
                    e = f"^{w}$"
                    for i in range(len(e) - n + 1):
                        grams[x][e[i : i + n]] += c
            self._learn(self.gram, grams, GRAMS, math.log(_BACKOFF) * (LONGEST - n))
        self.table = np.concatenate(self._rows)
        del self._rows

    def _learn(self, into: dict[str, int], counts: dict[str, Counter], most: int, price: float) -> None:
        known = sorted({w for x in self.languages for w, c in counts[x].most_common(most) if c >= 2})
        into.update(zip(known, range(self._size, self._size + len(known))))
        self._size += len(known)
        seen = np.array([[counts[x][w] for x in self.languages] for w in known], float).reshape(len(known), len(self.languages))
        size = np.array([sum(counts[x].values()) for x in self.languages])
        self._rows.append(np.log((seen + 0.01) / (size + 1)) + price)

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: its own, or the mean over the positions' longest known n-grams."""
        flat, starts, parts = [], [], []
        word, gram = self.word.get, self.gram.get
        for w in words:
            starts.append(len(flat))
            at = word(w)
            if at is not None:
                flat.append(at)
                parts.append(1)
                continue
            e = f"^{w}$"
            parts.append(len(e))
            flat.append(0)
            for i in range(len(e)):
                for j in range(min(i + LONGEST, len(e)), i, -1):
                    at = gram(e[i:j])
                    if at is not None:
                        flat.append(at)
                        break
        if not words:
            return self.table[:0]
        return np.add.reduceat(self.table[flat], starts, 0) / np.array(parts, float)[:, None]


class Scorer:
    """Scores texts by the scores of their chunks between ASCII white space, which are kept."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, bool)

    def _add(self, chunks: list[bytes]) -> None:
        words, owner = [], []
        for k, c in enumerate(chunks):
            got = _words(c.decode().lower())
            words += got
            owner += [k] * len(got)
        own, rows = np.array(owner, np.int64), self.model.of_words(words)
        sums = [np.bincount(own, rows[:, x], len(chunks)) for x in range(rows.shape[1])]
        self.table = np.concatenate([self.table, np.stack(sums, 1)])
        self.letters = np.concatenate([self.letters, np.bincount(own, minlength=len(chunks)) > 0])

    def score(self, texts: list[bytes]) -> list[tuple[str, float]]:
        out = []
        chunked = [t.split() for t in texts]
        if len(self.known) > CACHE:
            self._forget()
        known, new = self.known, []
        for chunks in chunked:
            for c in chunks:
                if c not in known:
                    known[c] = len(known)
                    new.append(c)
        if new:
            self._add(new)
        table, get = self.table, known.__getitem__
        for chunks in chunked:
            ids = np.fromiter(map(get, chunks), np.int64, len(chunks))
            if not len(ids) or not self.letters[ids].any():
                out.append(("und", 0.0))
                continue
            count = np.bincount(ids, minlength=len(table)) if len(ids) > len(table) // 4 else None
            s = self.model.prior + (count @ table if count is not None else table[ids].sum(0))
            best = int(np.argmax(s))
            out.append((self.model.languages[best], float(1 / np.exp(s - s[best]).sum())))
        return out


def sample_of(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of at most `sample` distinct labelled texts, as many of each language as fit, and its distinct texts.

    Texts are drawn by the smallest hashes of their language, found on hashes alone: whole texts are read only of the
    drawn rows, and a copy never counts twice. Of more than `sample` languages the most frequent are learned.
    """
    spark = docs.sparkSession
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    keys = rows.select("lang", "h").distinct()
    per = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(sample).collect()}
    if not per:
        return rows.select("lang", "text").limit(0), {}
    quota = max(1, sample // len(per))
    # hashes are uniform: below this share of their range lie the quota's hashes of a language, and some more
    share = {x: min(1.0, (quota + 6 * math.sqrt(quota) + 10) / n) for x, n in per.items()}
    below = spark.createDataFrame([(x, int(-(2**63) + f * (2**64 - 1)) if f < 1 else 2**63 - 1) for x, f in share.items()], "lang string, below long")
    near: dict[str, list[int]] = {}
    for r in keys.join(F.broadcast(below), "lang").where("h <= below").select("lang", "h").collect():
        near.setdefault(r["lang"], []).append(r["h"])
    last = [(x, sorted(hs)[min(quota, len(hs)) - 1]) for x, hs in near.items()]
    cut = spark.createDataFrame(last, "lang string, last long")
    drawn = rows.join(F.broadcast(cut), "lang").where("h <= last").dropDuplicates(["lang", "h"])
    return drawn.select("lang", "text"), per


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From text and non-null lang of at most `sample` distinct texts of docs; a language's prior counts all its texts."""
    drawn, per = sample_of(docs, sample)
    words: dict[str, Counter] = {}
    for r in drawn.toLocalIterator() if per else ():
        words.setdefault(r["lang"], Counter()).update(_words(r["text"].lower()))
    return Model(sorted(words) or ["und"], words or {"und": Counter()}, {x: per[x] for x in words} or {"und": 1})


def languages(docs: DataFrame, learn_from: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs' doc_id and held_out, and (lang_pred, score).

    A null text and one without a letter are `und` with score 0; so is every text if nothing was learned. Repeated rows
    get equal answers; languages equally likely give the first by name.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(learn_from, sample))

    def run(batches):
        scorer = Scorer(model.value)
        for b in slices(batches, "text"):
            got = scorer.score([(t or "").encode() for t in b.column("text").to_pylist()])
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_remainder("doc_id", 3) == 1)
    return languages(docs, docs.where("not held_out"))
