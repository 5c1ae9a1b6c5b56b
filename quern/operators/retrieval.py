"""Corpus statistics, BM25 and TF-IDF over an index of one row a document; dense-vector similarity.

A corpus is tokenised once, into a written index of (doc_id, dl, terms); counts, document frequencies and scores read that.
For a query the index holds only the query's terms, so nothing of the corpus' size is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import code_tokens, counted
from .storage import positions, written

#: Document frequencies of at most so many terms are broadcast; more are joined by shuffle, where AQE splits hot terms.
BROADCAST_TERMS = 500_000
#: Documents a block, within which a term's documents are counted in order.
BLOCK = 10_000


def index(files: DataFrame, query: DataFrame | None = None, dedup: bool = True) -> DataFrame:
    """(doc_id, dl, terms of (term, tf)): all terms, or those of a query; dl counts all of a document's tokens.

    Documents without tokens are not part of the corpus. With dedup a term counts once a document.
    """
    rows = files.select("doc_id", code_tokens(F.col("content"), dedup=dedup).alias("tokens"))
    rows = rows.withColumn("dl", F.size("tokens").cast("long"))
    if query is not None:
        wanted = query.agg(F.collect_set("term").alias("wanted"))  # one row, as long as the prompt
        kept = F.array_intersect("tokens", "wanted") if dedup else F.filter("tokens", lambda t: F.array_contains("wanted", t))
        rows = rows.join(F.broadcast(wanted)).select("doc_id", "dl", kept.alias("tokens"))
    once = lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("tf"))
    terms = F.transform("tokens", once) if dedup else counted(F.col("tokens"))
    return _nonempty(written(rows.select("doc_id", "dl", terms.alias("terms")), "index"))


def _nonempty(idx: DataFrame) -> DataFrame:
    # on the written table: before it, the filter would be pushed below the tokens and compute them twice
    return idx.where("dl > 0")


def postings(idx: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf)"""
    return idx.select("doc_id", "dl", F.inline("terms"))


def sizes(idx: DataFrame) -> DataFrame:
    """One row: documents n and their average length."""
    return idx.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def frequencies(idx: DataFrame) -> DataFrame:
    """(term, df)"""
    return idx.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(idx: DataFrame) -> DataFrame:
    """One row: documents, average length, distinct terms."""
    terms = frequencies(idx).agg(F.count("*").alias("n_terms"))
    return sizes(idx).withColumnRenamed("n", "n_docs").join(terms)  # one row each


def query_terms(spark: SparkSession, prompt: str, distinct: bool = True) -> DataFrame:
    tokens = spark.range(1).select(F.explode(code_tokens(F.lit(prompt), dedup=distinct)).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("qtf"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_terms(idx: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, term, tf, idf, component): each term's part of each document's score; idx holds the query's terms."""
    df = F.broadcast(frequencies(idx))  # as many rows as query terms
    rows = postings(idx).join(df, "term").join(F.broadcast(sizes(idx)))  # one row
    tf, idf = F.col("tf"), bm25_idf(F.col("n"), F.col("df"))
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.select("doc_id", "term", "tf", idf.alias("idf"), part.alias("component"))


def bm25(idx: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    return bm25_terms(idx, k1, b).groupBy("doc_id").agg(F.sum("component").alias("score")).where("score > 0")


def sublinear(tf: Column) -> Column:
    return 1 + F.log(tf)


def tfidf_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1e-12 * F.greatest(F.lit(1), n) + 1


def _raw_weights(idx: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, raw): raw weights by corpus-wide document frequency; df (term, df) holds them if they are stored already."""
    df = written(frequencies(idx), "frequencies") if df is None else df
    df = F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    raw = sublinear(F.col("tf")) * tfidf_idf(F.col("n"), F.col("df"))
    return postings(idx).join(df, "term").join(F.broadcast(sizes(idx))).select("doc_id", "term", raw.alias("raw"))


def tfidf_vectors(idx: DataFrame) -> DataFrame:
    """(doc_id, norm, weights of (term, raw)): raw weights by corpus-wide document frequency, and their length."""
    rows = _raw_weights(idx)
    return rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.collect_list(F.struct("term", "raw")).alias("weights"))


def tfidf_similarity(idx: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, similarity) of documents that share terms with a query's: cosines; sums, no lists of weights, are shuffled."""
    df = written(frequencies(idx), "frequencies")
    query = df.join(F.broadcast(terms), "term").join(F.broadcast(sizes(idx))).select("term", tfidf_idf(F.col("n"), F.col("df")).alias("q"))
    length = query.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))  # one row
    rows = _raw_weights(idx, df).join(F.broadcast(query), "term", "left")  # as long as the prompt
    raw = F.col("raw")
    per = rows.groupBy("doc_id").agg(F.sqrt(F.sum(raw * raw)).alias("norm"), F.sum(raw * F.col("q")).alias("s"))
    return per.where("s is not null").join(F.broadcast(length)).select("doc_id", F.least(F.lit(1.0), F.col("s") / F.col("norm") / F.col("qnorm")).alias("similarity"))


def tfidf_weights(idx: DataFrame) -> DataFrame:
    """(doc_id, term, weight): L2-normalised weights by corpus-wide document frequency."""
    rows = tfidf_vectors(idx).select("doc_id", "norm", F.inline("weights"))
    return rows.select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def tfidf_insertion_weights(idx: DataFrame) -> DataFrame:
    """(doc_id, term, raw): weights by the corpus as it was when each document, in order of doc_id, was added.

    A term's documents are counted within blocks of documents; a block starts at the sum of those before it, so the
    postings of a frequent term are no single task's.
    """
    placed = positions(idx, [F.col("doc_id")], "n")
    posts = placed.select("doc_id", "n", F.inline("terms")).withColumn("block", F.floor(F.col("n") / BLOCK))
    within = F.row_number().over(Window.partitionBy("term", "block").orderBy("n"))
    counts = posts.groupBy("term", "block").agg(F.count("*").alias("c"))
    earlier = F.sum("c").over(Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("term", "block", F.coalesce(earlier, F.lit(0)).alias("before"))
    rows = posts.withColumn("within", within).join(before, ["term", "block"]).withColumn("df", F.col("before") + F.col("within"))
    return rows.select("doc_id", "term", (sublinear(F.col("tf")) * tfidf_idf(F.col("n"), F.col("df"))).alias("raw"))


def top_terms(weights: DataFrame, n: int, value: str = "weight") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round(value, 9).desc(), "term"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= n)


def top_terms_of(vectors: DataFrame, n: int) -> DataFrame:
    """(doc_id, rank, term, weight): as top_terms of the vectors' weights, within each row."""
    weight = lambda w: w["raw"] / F.col("norm")
    # only weights that can round to the n-th largest or more are rounded
    least = F.element_at(F.sort_array(F.col("weights.raw"), False), F.least(F.lit(n), F.size("weights"))) / F.col("norm") - 2e-9
    rows = vectors.select("doc_id", "norm", "weights", least.alias("least"))
    few = F.filter("weights", lambda w: weight(w) >= F.col("least"))
    order = F.sort_array(F.transform(few, lambda w: F.struct((-F.round(weight(w), 9)).alias("o"), w["term"].alias("term"), weight(w).alias("weight"))))
    return rows.select("doc_id", F.posexplode(F.slice(order, 1, n)).alias("rank", "w")).select("doc_id", (F.col("rank") + 1).alias("rank"), "w.term", "w.weight")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def corpus_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, action): what an index of old must do to become one of new; signatures are length and md5."""
    sign = lambda d, c: d.select("doc_id", F.concat_ws(":", F.length("content").cast("string"), F.md5("content")).alias(c))
    both = sign(old, "was").join(sign(new, "now"), "doc_id", "full_outer")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "update")
    return both.select("doc_id", action.alias("action")).where("action is not null")
