"""Queries over documents: tokens, corpus statistics, retrieval, ranking, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking, retrieval
from ..sources.fixtures import SQL, files, table

PROMPT = "the reader that erand onthe thing heshand"
KEYWORDS = ["thing", "src1", "erand", "onth"]
BUDGET = 20_000

_TOKENS = (
    SQL
    + """, words AS (SELECT doc_id, list_filter(regexp_extract_all(content, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND (length(w) > 1 OR lower(w) IN ('i','a','x','y','z'))) AS ws FROM files),
tok AS (SELECT doc_id, flatten(list_transform(ws, lambda w: CASE
    WHEN regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') THEN list_concat(list_transform(list_filter(list_transform(
        regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') || ' ', '[A-Z][a-z]+|[a-z]+|[A-Z]+ '), lambda x: trim(x)), lambda x: length(x) > 1), lambda x: lower(x)), [lower(w)])
    WHEN contains(w, '_') THEN list_concat(list_filter(string_split(lower(w), '_'), lambda x: x <> ''), [lower(w)])
    ELSE [lower(w)] END)) AS ts FROM words),
allposts AS (SELECT doc_id, unnest(ts) AS term FROM tok),
dl AS (SELECT doc_id, count(DISTINCT term) AS dl FROM allposts GROUP BY 1),
posts AS (SELECT DISTINCT doc_id, term FROM allposts),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
"""
)
_BM25 = (
    _TOKENS
    + f""", q AS (SELECT DISTINCT unnest(string_split('{PROMPT}', ' ')) AS term),
part AS (SELECT doc_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS component
  FROM posts JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st),
score AS (SELECT doc_id, sum(component) AS s FROM part GROUP BY 1)
"""
)
_RAW = "(ln((1 + n) / (1 + df)) + 1e-12 * greatest(1, n) + 1)"
_TFIDF = _TOKENS + f", raw AS (SELECT doc_id, term, {_RAW} AS raw FROM posts JOIN df USING (term), st), w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"


def _index(spark, d):
    return retrieval.index(files(spark, d))


def _query_index(spark, d):
    return retrieval.index(files(spark, d), retrieval.query_terms(spark, PROMPT))


def t1_code_tokens(spark, d):
    f = files(spark, d).select("doc_id", T.code_tokens(F.col("content")).alias("t"))
    return f.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.concat_ws(" ", "t")).alias("digest"))


def t3_text_tokens(spark, d):
    t = files(spark, d).select("doc_id", T.text_tokens(F.col("content")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.concat_ws(" ", "t")).alias("digest"))


def t4_bigrams(spark, d):
    t = files(spark, d).select(F.explode(T.ngrams(T.text_tokens(F.col("content")), 2)).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n"))


def t10_singular(spark, d):
    t = files(spark, d).select(F.explode(T.text_tokens(F.col("content"))).alias("word")).distinct()
    return t.select("word", T.singular(F.col("word")).alias("form"))


def t12_condensed(spark, d):
    return files(spark, d).select("doc_id", F.md5(T.condensed(F.col("content"))).alias("digest"))


def t15_token_count(spark, d):
    return files(spark, d).select("doc_id", T.token_count(F.col("content")).alias("tokens"))


def t17_chunks(spark, d):
    c = files(spark, d).select("doc_id", F.posexplode(T.chunks(F.col("content"))).alias("k", "chunk"))
    return c.select("doc_id", F.col("k").cast("long").alias("k"), F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


def t18_head_tail(spark, d):
    return files(spark, d).select("doc_id", F.md5(T.head_tail(F.col("content"))).alias("digest"))


def r2_idf(spark, d):
    idx = _index(spark, d)
    df = retrieval.frequencies(idx).join(F.broadcast(retrieval.sizes(idx)))  # one row
    return df.select("term", "df", F.round(retrieval.bm25_idf(F.col("n"), F.col("df")), 6).alias("idf"))


def r3_bm25_top_k(spark, d):
    s = retrieval.bm25(_query_index(spark, d))
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20)


def r4_bm25_normalised(spark, d):
    s = retrieval.bm25(_query_index(spark, d))
    return s.select("doc_id", F.round(F.col("score") / (F.col("score") + 10), 6).alias("normalised"), F.round(F.least(F.lit(1.0), F.col("score") / 10), 6).alias("factor"))


def r5_bm25_explain(spark, d):
    t = retrieval.bm25_terms(_query_index(spark, d))
    return t.select("doc_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("component", 6).alias("component"))


def r6_corpus_stats(spark, d):
    return retrieval.corpus_stats(_index(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms")


def r8_term_frequency(spark, d):
    """Both forms of term frequency, repeats counted: 1 + ln(c), and c by the document's length."""
    p = retrieval.postings(retrieval.index(files(spark, d), dedup=False))
    return p.select("doc_id", "term", "tf", F.round(retrieval.sublinear(F.col("tf")), 6).alias("sublinear"), F.round(F.col("tf") / F.col("dl"), 6).alias("relative"))


def r9_tfidf_weights(spark, d):
    w = retrieval.tfidf_weights(_index(spark, d))
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("top"))


def r9_tfidf_insertion(spark, d):
    w = retrieval.tfidf_insertion_weights(_index(spark, d))
    return w.groupBy("doc_id").agg(F.round(F.sum("raw"), 5).alias("total"), F.round(F.max("raw"), 6).alias("top"))


def r10_tfidf_similarity(spark, d):
    s = retrieval.tfidf_similarity(_index(spark, d), retrieval.query_terms(spark, PROMPT))
    return s.select("doc_id", F.round("similarity", 6).alias("similarity"))


def r11_top_terms(spark, d):
    w = retrieval.top_terms_of(retrieval.tfidf_vectors(_index(spark, d)), 3)
    return w.select("doc_id", F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 6).alias("weight"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e, q


def r14_cosine(spark, d):
    e, q = _vectors(spark, d)
    return e.join(F.broadcast(q)).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


def r16_distances(spark, d):
    e, q = _vectors(spark, d)
    a, b = F.col("embedding"), F.col("q")
    eu, ma = retrieval.euclidean(a, b), retrieval.manhattan(a, b)
    return e.join(F.broadcast(q)).select("vec_id", F.round(eu, 5).alias("euclidean"), F.round(ma, 5).alias("manhattan"), F.round(1 / (1 + eu), 5).alias("similarity"))


def r17_vector_top_k(spark, d):
    return r14_cosine(spark, d).orderBy(F.col("cosine").desc(), "vec_id").limit(10)


def r18_similarity_threshold(spark, d):
    return r14_cosine(spark, d).where("cosine >= 0.1")


def r22_corpus_changes(spark, d):
    f = files(spark, d)
    # the old state knew no French text and had not yet lower-cased the German ones; the new one lost the Spanish ones
    old = f.where("language <> 'fr'").withColumn("content", F.when(F.col("language") == "de", F.upper("content")).otherwise(F.col("content")))
    return retrieval.corpus_changes(old, f.where("language <> 'es'"))


def _scored(spark, d, keywords=None):
    f = files(spark, d)
    k = keywords or KEYWORDS
    rows = f.select(
        "doc_id", "path", "content", ranking.keyword_score(F.col("content"), F.col("path"), k).alias("keyword_match"), ranking.path_score(F.col("path"), k).alias("path_relevance"), ranking.type_score(F.col("path"), "feature").alias("type_relevance")
    )
    return rows.withColumn("score", ranking.weighted(ranking.FAST))


def f1_keyword_score(spark, d):
    return _scored(spark, d).select("doc_id", F.round("keyword_match", 6).alias("keyword_match"))


def f2_path_score(spark, d):
    return _scored(spark, d).select("doc_id", F.round("path_relevance", 6).alias("path_relevance"), F.round("type_relevance", 6).alias("type_relevance"))


def f19_weighted_score(spark, d):
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def f22_rank_files(spark, d):
    return ranking.rank_files(_scored(spark, d).select("doc_id", "path", F.round("score", 6).alias("score")), threshold=0.1)


def f27_compare_rankings(spark, d):
    one = f22_rank_files(spark, d)
    two = ranking.rank_files(_scored(spark, d, ["onth", "er"]).select("doc_id", "path", F.round("score", 6).alias("score")), threshold=0.1)
    return ranking.compare_rankings(one, two)


def f28_ranking_stats(spark, d):
    s = _scored(spark, d).select(F.round("score", 6).alias("score"))
    n = s.agg(F.count("*").alias("n"))
    counts = s.groupBy("score").agg(F.count("*").alias("c"))
    from pyspark.sql.window import Window

    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("score"))).join(F.broadcast(n))
    median = upto.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("score"))).alias("median"))
    facts = s.agg(F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.var_pop("score"), 6).alias("variance"))
    return facts.join(median)


def p2_greedy_selection(spark, d):
    ranked = f22_rank_files(spark, d).join(files(spark, d).select("doc_id", T.token_count(F.col("content")).alias("tokens")), "doc_id")
    return ranking.greedy_selection(ranked, BUDGET)


def x7_top_and_others(spark, d):
    """Documents by source: the five largest, and the rest as one."""
    from pyspark.sql.window import Window

    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")))
    return c.groupBy(F.when(F.col("r") <= 5, F.col("source")).otherwise("Others").alias("name")).agg(F.sum("n").alias("n"))


def g52_size_buckets(spark, d):
    lines = F.size(F.split("content", "\n", -1))
    bucket = F.when(lines <= 50, "small").when(lines <= 200, "medium").when(lines <= 500, "large").when(lines <= 1000, "huge").otherwise("extreme")
    return files(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def g55_language_rollup(spark, d):
    lines = F.size(F.split("content", "\n", -1)).cast("long")
    f = files(spark, d).select("language", lines.alias("lines"), F.length("content").cast("long").alias("size"))
    return f.rollup("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("size"), F.round(F.avg("lines"), 6).alias("mean_lines"))


_KW = "(CASE WHEN {m} = 0 THEN 0.0 ELSE least(1.0, (CASE WHEN {n} > 0 THEN 0.6 ELSE 0.0 END) + 0.5 * {m} / {k} + least(0.2, ln(1 + {h}) / 6)) END)"


def _keyword_sql(keywords: list[str]) -> str:
    hit = lambda w: f"CAST((length(lower(content)) - length(replace(lower(content), '{w}', ''))) / {len(w)} AS BIGINT)"
    name = "lower(string_split(path, '/')[-1])"
    named = " + ".join(f"CAST(contains({name}, '{w}') AS INT)" for w in keywords)
    hits = " + ".join(hit(w) for w in keywords)
    matched = f"({named} + " + " + ".join(f"CAST({hit(w)} > 0 AS INT)" for w in keywords) + ")"
    return _KW.format(m=matched, n=f"({named})", h=f"({hits})", k=f"{len(keywords)}.0")


def _path_sql(keywords: list[str]) -> str:
    p = "lower(path)"
    words = " + ".join(f"(CASE WHEN contains({p}, '{w}') THEN 0.3 ELSE 0.0 END)" for w in keywords)
    important = " OR ".join(f"contains({p}, '{w}')" for w in ranking.IMPORTANT)
    return f"least(1.0, ({words} + CASE WHEN {important} THEN 0.2 ELSE 0.0 END) * CASE WHEN contains({p}, 'test') OR contains({p}, 'spec') THEN 0.5 ELSE 1.0 END)"


def _scored_sql(keywords: list[str], name: str) -> str:
    return f"""{name} AS (SELECT doc_id, path, content, k, p, t, round(CAST((k * 0.6 + p * 0.3 + t * 0.1) / 1.0 AS DOUBLE), 6) AS score FROM
  (SELECT *, CAST({_keyword_sql(keywords)} AS DOUBLE) AS k, CAST({_path_sql(keywords)} AS DOUBLE) AS p, CASE WHEN contains(lower(path), 'test') THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS t FROM files)),
{name}_r AS (SELECT doc_id, path, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM {name} WHERE score >= 0.1 OR ((SELECT max(score) FROM {name}) < 0.1 AND doc_id IN (SELECT doc_id FROM {name} ORDER BY score DESC, doc_id LIMIT 3)))
"""


_RANK = SQL + ", " + _scored_sql(KEYWORDS, "a")
_STOP = ", ".join(f"'{w}'" for w in T.CODE_STOP_WORDS)
_TEXT = SQL + f", tt AS (SELECT doc_id, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9]*') AND length(w) >= 2 AND w NOT IN ({_STOP})) AS t FROM files)"
_VEC = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id, round(list_cosine_similarity(v, q), 5) AS cosine FROM e, q) "

QUERIES = {f.__name__: f for f in (
    t1_code_tokens, t3_text_tokens, t4_bigrams, t10_singular, t12_condensed, t15_token_count, t17_chunks, t18_head_tail, r2_idf, r3_bm25_top_k, r4_bm25_normalised, r5_bm25_explain, r6_corpus_stats, r8_term_frequency, r9_tfidf_weights, r9_tfidf_insertion,
    r10_tfidf_similarity, r11_top_terms, r14_cosine, r16_distances, r17_vector_top_k, r18_similarity_threshold, r22_corpus_changes, f1_keyword_score, f2_path_score, f19_weighted_score, f22_rank_files, f27_compare_rankings, f28_ranking_stats,
    p2_greedy_selection, x7_top_and_others, g52_size_buckets, g55_language_rollup,
)}

ORACLES = {
    "t1_code_tokens": _TOKENS + "SELECT doc_id, CAST(coalesce(len(u), 0) AS BIGINT) AS n, md5(coalesce(array_to_string(u, ' '), '')) AS digest FROM (SELECT doc_id, list_filter(list_transform(ts, lambda x, i: CASE WHEN list_position(ts, x) = i THEN x END), lambda x: x IS NOT NULL) AS u FROM tok)",
    "t3_text_tokens": _TEXT + " SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM tt",
    "t4_bigrams": _TEXT + ", g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM tt) SELECT gram, count(*) AS n FROM g GROUP BY 1",
    "t10_singular": _TEXT + ", w AS (SELECT DISTINCT unnest(t) AS word FROM tt) SELECT word, CASE WHEN ends_with(word, 'ies') AND length(word) > 3 THEN left(word, length(word) - 3) || 'y' WHEN ends_with(word, 'es') AND NOT ends_with(word, 'ses') AND length(word) > 2 THEN left(word, length(word) - 2) WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') AND length(word) > 1 THEN left(word, length(word) - 1) ELSE word END AS form FROM w",
    "t12_condensed": SQL + r" SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(content || chr(10), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n+$', '') || chr(10)) AS digest FROM files",
    "t15_token_count": SQL + " SELECT doc_id, CAST(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END AS BIGINT) AS tokens FROM files",
    "t17_chunks": SQL + ", k AS (SELECT doc_id, content, unnest(range(0, length(content), 900)) AS pos FROM files WHERE length(content) > 0) SELECT doc_id, CAST(pos / 900 AS BIGINT) AS k, CAST(length(substr(content, pos + 1, 1000)) AS BIGINT) AS n, md5(substr(content, pos + 1, 1000)) AS digest FROM k",
    "t18_head_tail": SQL + " SELECT doc_id, md5(CASE WHEN length(content) <= 2000 THEN content ELSE left(content, 1000) || chr(10) || '...' || chr(10) || right(content, 1000) END) AS digest FROM files",
    "r2_idf": _TOKENS + "SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st",
    "r3_bm25_top_k": _BM25 + "SELECT doc_id, round(s, 6) AS score FROM score ORDER BY round(s, 6) DESC, doc_id LIMIT 20",
    "r4_bm25_normalised": _BM25 + "SELECT doc_id, round(s / (s + 10), 6) AS normalised, round(least(1.0, s / 10), 6) AS factor FROM score",
    "r5_bm25_explain": _BM25 + "SELECT doc_id, term, CAST(1 AS BIGINT) AS tf, round(idf, 6) AS idf, round(component, 6) AS component FROM part",
    "r6_corpus_stats": _TOKENS + "SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms FROM st",
    "r8_term_frequency": _TOKENS + ", c AS (SELECT doc_id, term, count(*) AS tf FROM allposts GROUP BY 1, 2), l AS (SELECT doc_id, count(*) AS n FROM allposts GROUP BY 1) SELECT doc_id, term, tf, round(1 + ln(tf), 6) AS sublinear, round(tf / n, 6) AS relative FROM c JOIN l USING (doc_id)",
    "r9_tfidf_weights": _TFIDF + "SELECT doc_id, count(*) AS terms, round(sum(weight), 5) AS total, round(max(weight), 6) AS top FROM w GROUP BY 1",
    "r9_tfidf_insertion": _TOKENS + f", o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM dl), x AS (SELECT doc_id, term, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS df FROM posts), y AS (SELECT doc_id, {_RAW} AS raw FROM x JOIN o USING (doc_id)) SELECT doc_id, round(sum(raw), 5) AS total, round(max(raw), 6) AS top FROM y GROUP BY 1",
    "r10_tfidf_similarity": _TFIDF + f", q AS (SELECT term, {_RAW} AS q FROM df, st WHERE term IN (SELECT unnest(string_split('{PROMPT}', ' ')))) SELECT doc_id, round(least(1.0, sum(weight * q) / (SELECT sqrt(sum(q * q)) FROM q)), 6) AS similarity FROM w JOIN q USING (term) GROUP BY 1",
    "r11_top_terms": _TFIDF + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM w) SELECT doc_id, CAST(rank AS BIGINT) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 3",
    "r14_cosine": _VEC + "SELECT * FROM c",
    "r16_distances": _VEC + ", m AS (SELECT vec_id, list_distance(v, q) AS d, list_sum(list_transform(list_zip(v, q), lambda x: abs(x[1] - x[2]))) AS l FROM e, q) SELECT vec_id, round(d, 5) AS euclidean, round(l, 5) AS manhattan, round(1 / (1 + d), 5) AS similarity FROM m",
    "r17_vector_top_k": _VEC + "SELECT * FROM c ORDER BY cosine DESC, vec_id LIMIT 10",
    "r18_similarity_threshold": _VEC + "SELECT * FROM c WHERE cosine >= 0.1",
    "r22_corpus_changes": SQL + ", o AS (SELECT doc_id, CASE WHEN language = 'de' THEN upper(content) ELSE content END AS was FROM files WHERE language <> 'fr'), n AS (SELECT doc_id, content AS now FROM files WHERE language <> 'es') SELECT doc_id, CASE WHEN was IS NULL THEN 'insert' WHEN now IS NULL THEN 'delete' ELSE 'update' END AS action FROM o FULL JOIN n USING (doc_id) WHERE was IS DISTINCT FROM now",
    "f1_keyword_score": _RANK + " SELECT doc_id, round(k, 6) AS keyword_match FROM a",
    "f2_path_score": _RANK + " SELECT doc_id, round(p, 6) AS path_relevance, round(t, 6) AS type_relevance FROM a",
    "f19_weighted_score": _RANK + " SELECT doc_id, score FROM a",
    "f22_rank_files": _RANK + " SELECT * FROM a_r",
    "f27_compare_rankings": _RANK + ", " + _scored_sql(["onth", "er"], "b") + " SELECT doc_id, coalesce(x.rank, (SELECT count(*) + 1 FROM a_r)) AS rank_a, coalesce(y.rank, (SELECT count(*) + 1 FROM b_r)) AS rank_b, coalesce(x.rank, (SELECT count(*) + 1 FROM a_r)) - coalesce(y.rank, (SELECT count(*) + 1 FROM b_r)) AS delta FROM a_r x FULL JOIN b_r y USING (doc_id)",
    "f28_ranking_stats": _RANK + " SELECT min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS variance, list_sort(list(score))[count(*) // 2 + 1] AS median FROM a",
    "p2_greedy_selection": "WITH RECURSIVE " + _RANK.strip().removeprefix("WITH") + f""", it AS (SELECT r.doc_id, r.rank, CAST(CASE WHEN length(f.content) = 0 THEN 0 ELSE greatest(1, length(f.content) // 4) END AS BIGINT) AS t FROM a_r r JOIN files f USING (doc_id)),
fold AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS take, false AS full_, false AS ok
  UNION ALL SELECT it.rank, it.doc_id, used + CASE WHEN used + t <= {BUDGET} THEN t WHEN least(t // 4, {BUDGET} - used) > 100 THEN least(t // 4, {BUDGET} - used) ELSE 0 END,
    CASE WHEN used + t <= {BUDGET} THEN t ELSE least(t // 4, {BUDGET} - used) END, used + t <= {BUDGET}, used + t <= {BUDGET} OR least(t // 4, {BUDGET} - used) > 100
  FROM fold JOIN it ON it.rank = fold.rank + 1 WHERE used < {BUDGET} * 0.95)
SELECT doc_id, CASE WHEN full_ THEN 'full' ELSE 'summary' END AS mode, take AS tokens FROM fold WHERE ok""",
    "x7_top_and_others": "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS r FROM c) SELECT CASE WHEN r <= 5 THEN source ELSE 'Others' END AS name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "g52_size_buckets": SQL + ", l AS (SELECT len(string_split(content, chr(10))) AS n FROM files) SELECT CASE WHEN n <= 50 THEN 'small' WHEN n <= 200 THEN 'medium' WHEN n <= 500 THEN 'large' WHEN n <= 1000 THEN 'huge' ELSE 'extreme' END AS bucket, count(*) AS n FROM l GROUP BY 1",
    "g55_language_rollup": SQL + ", l AS (SELECT language, len(string_split(content, chr(10))) AS lines, length(content) AS size FROM files) SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS size, round(avg(lines), 6) AS mean_lines FROM l GROUP BY ROLLUP (language)",
}
