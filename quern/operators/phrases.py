"""Key phrases and extractive summaries, as expressions within a document, and groups by (document, word) of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CODE_STOP_WORDS, _let

_BLANKS = r"[ \t-\r]+"


def candidate_phrases(text: Column, stop_words: list[str] = CODE_STOP_WORDS, max_words: int = 3) -> Column:
    """Runs of words between stop words and sentence ends, in order, without the runs of more than max_words words."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"[.!?\n]+", " \n "), r"[^\p{L}\p{N}_\n]+", " ")
    words = F.filter(F.split(t, " "), lambda w: w != "")
    runs = F.split(F.array_join(F.transform(words, lambda w: F.when(w.isin(stop_words), F.lit("\n")).otherwise(w)), " "), "\n")
    return F.filter(F.transform(runs, lambda p: F.trim(p)), lambda p: (p != "") & (F.size(F.split(p, " ")) <= max_words))


def rake_phrases(docs: DataFrame, k: int, stop_words: list[str] = CODE_STOP_WORDS, max_words: int = 3) -> DataFrame:
    """(doc_id, rank, phrase, score): the k phrases of docs (doc_id, content) with the largest sums of degree / frequency.

    Ties go to the phrase that appears first. Texts that are null or have no phrase give no row.
    """
    found = docs.select("doc_id", F.posexplode(candidate_phrases(F.col("content"), stop_words, max_words)).alias("pos", "phrase"))
    phrases = found.groupBy("doc_id", "phrase").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    words = phrases.withColumn("parts", F.split("phrase", " ")).withColumn("size", F.size("parts")).withColumn("word", F.explode("parts"))
    of_word = Window.partitionBy("doc_id", "word")
    scored = words.withColumn("score", F.sum(F.col("n") * F.col("size")).over(of_word) / F.sum("n").over(of_word))
    total = scored.groupBy("doc_id", "phrase", "pos").agg(F.round(F.sum("score"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "pos"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", F.col("rank").cast("long").alias("rank"), "phrase", "score")


def _runs(sorted_items: Column, key: str) -> Column:
    """(first, n) of each run of equal keys in a sorted array of structs, bound by the caller."""
    n = F.size(sorted_items)
    starts = F.filter(F.sequence(F.lit(1), n), lambda k: (k == 1) | (sorted_items[k - 1][key] != sorted_items[k - 2][key]))
    return _let(starts, lambda s: F.transform(s, lambda k, j: F.struct(k.alias("first"), (F.when(j + 1 < F.size(s), s[j + 1]).otherwise(n + 1) - k).alias("n"))))


def _frequencies(words: Column, places: Column) -> Column:
    """The sum of the frequencies of the words at each place (from 0 on), of an array of (word, i): two sorts, no shuffle."""

    def by_word(w: Column) -> Column:
        of = lambda r: F.transform(F.slice(w, r["first"], r["n"]), lambda x: F.struct(x["i"].alias("i"), r["n"].alias("n")))
        return F.flatten(F.transform(_runs(w, "word"), of))

    def by_place(p: Column) -> Column:
        return F.transform(_runs(p, "i"), lambda r: F.aggregate(F.slice(p, r["first"], r["n"]), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))

    none = F.array().cast("array<struct<i:int,n:int>>")
    found = _let(F.sort_array(words), lambda w: F.when(F.size(w) > 0, by_word(w)).otherwise(none))
    every = F.transform(F.sequence(F.lit(0), places - 1), lambda i: F.struct(i.alias("i"), F.lit(0).alias("n")))  # places without words
    return _let(F.sort_array(F.concat(found, every)), by_place)


def extractive_summary(docs: DataFrame, ratio: float = 0.3) -> DataFrame:
    """(doc_id, n_sentences, summary) of docs (doc_id, content); doc_id is unique.

    Sentences score by position, by the mean frequency of their words (words of up to 3 characters count 0) and by length.
    They are taken from the best on, until the first that would exceed ratio of the text, and keep the text's order; ties
    go to the earlier one. A text without sentences is its own summary; null has none. All is done within a document's row.
    """
    trimmed = F.transform(F.split("content", r"[.!?]+"), lambda s: F.regexp_replace(s, rf"^{_BLANKS}|{_BLANKS}\z", ""))

    def parts(sentences: Column) -> Column:
        """(i, sentence, size in words, long words)"""
        words = lambda s: F.split(F.lower(s), _BLANKS)
        each = lambda s, i: _let(words(s), lambda w: F.struct(s.alias("sentence"), F.size(w).alias("n"), F.transform(F.filter(w, lambda x: F.length(x) > 3), lambda x: F.struct(x.alias("word"), i.alias("i"))).alias("long")))
        return F.transform(sentences, each)

    def scored(p: Column, sums: Column) -> Column:
        def score(x: Column, i: Column) -> Column:
            position = (1 - i / F.size(p) * 0.5) * 0.3
            mean = sums[i] / x["n"]
            value = F.round(position + mean * 0.5 + F.least(F.lit(1.0), F.length(x["sentence"]) / 100) * 0.2, 9)
            return F.struct((-value).alias("o"), i.alias("i"), F.length(x["sentence"]).alias("size"))

        return F.sort_array(F.transform(p, score))

    def taken(order: Column, target: Column) -> Column:
        """The places of the sentences up to the first that exceeds the target, in the text's order."""
        zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct((acc["used"] + x["size"]).alias("used"), (acc["n"] + (acc["used"] + x["size"] <= target).cast("int")).alias("n"))
        return F.sort_array(F.transform(F.slice(order, F.lit(1), F.aggregate(order, zero, step, lambda acc: acc["n"])), lambda x: x["i"]))

    def summary(p: Column) -> Column:
        target = F.floor(F.length("content") * F.lit(ratio))  # bound: in a lambda it would be computed for every sentence
        sums = _frequencies(F.flatten(F.transform(p, lambda x: x["long"])), F.size(p))
        places = _let(_let(sums, lambda x: scored(p, x)), lambda order: _let(target, lambda most: taken(order, most)))
        joined = lambda at: F.array_join(F.transform(at, lambda i: p[i]["sentence"]), " ")
        found = lambda at: F.struct(F.size(at).cast("long").alias("n"), joined(at).alias("text"))
        return F.when(F.size(p) > 0, _let(places, found)).otherwise(F.struct(F.lit(0).cast("long").alias("n"), F.col("content").alias("text")))

    found = docs.select("doc_id", F.when(F.col("content").isNotNull(), _let(F.filter(trimmed, lambda s: s != ""), lambda s: _let(parts(s), summary))).alias("s"))
    return found.select("doc_id", F.coalesce("s.n", F.lit(0).cast("long")).alias("n_sentences"), F.col("s.text").alias("summary"))
