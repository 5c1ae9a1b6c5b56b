"""Hand-computed cases of the text primitives."""

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import history, ranking, retrieval, storage


def one(spark, c, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(c.alias("v")).first()["v"]


def test_code_tokens(spark):
    assert one(spark, T.code_tokens(F.col("c0")), "parseHTTPRequest get_user_name x q XMLHttp") == ["parse", "http", "request", "parsehttprequest", "get", "user", "name", "get_user_name", "x", "xml", "xmlhttp"]
    assert one(spark, T.code_tokens(F.col("c0")), "caf\u00e9 the the cat") == ["the", "cat"]
    assert one(spark, T.code_tokens(F.col("c0"), dedup=False), "cat cat") == ["cat", "cat"]


def test_text_tokens_and_ngrams(spark):
    assert one(spark, T.text_tokens(F.col("c0")), "The cat and 2cats a Cat") == ["cat", "cat"]
    assert one(spark, T.ngrams(F.split(F.col("c0"), " "), 2), "a b c") == ["a b", "b c"]
    assert one(spark, T.ngrams(F.split(F.col("c0"), " "), 3), "a b") == []


def test_singular_and_condensed(spark):
    for word, form in [("queries", "query"), ("boxes", "box"), ("classes", "classe"), ("cats", "cat"), ("class", "class")]:
        assert one(spark, T.singular(F.col("c0")), word) == form
    assert one(spark, T.condensed(F.col("c0")), "a  \n\n\n\nb\n\n") == "a\n\nb\n"


def test_token_count(spark):
    assert [one(spark, T.token_count(F.col("c0")), x) for x in ("", "ab", "x" * 41)] == [0, 1, 10]


def test_commit_type(spark):
    cases = {"Merge pull 1": "merge", "Revert \"x\"": "revert", "feat(api): y": "feat", "patch it": "fix", "more specs": "test", "added z": "feat", "the readme": "docs", "cleanup": "refactor", "x": "other"}
    for message, kind in cases.items():
        assert one(spark, history.commit_type(F.col("c0")), message) == kind


def test_greedy_selection_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 600), (2, 2, 700), (3, 3, 300), (4, 4, 50)], "rank long, doc_id long, tokens long")
    got = [tuple(r) for r in ranking.greedy_selection(rows, 1000).collect()]
    assert got == [(1, "full", 600), (2, "summary", 175), (4, "full", 50)]


def test_hot_and_quiet_periods_and_bus_factor(spark):
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 9), ("2024-01-03", 9), ("2024-01-10", 1)], "day string, commits long").withColumn("day", F.to_date("day"))
    assert [(r["days"], r["commits"]) for r in history.hot_periods(days, 1.5).collect()] == [(2, 18)]
    assert [r["days"] for r in history.quiet_periods(days).collect()] == [6]
    authors = spark.createDataFrame([(a,) for a in [1] * 4 + [2] * 2 + [3] * 2 + [4] * 2], "author long")
    assert history.bus_factor(authors).first()["bus_factor"] == 2


def test_positions_and_selection_over_several_blocks(spark):
    rows = spark.createDataFrame([(i, float(i % 7), 300 + 10 * (i % 5)) for i in range(100)], "doc_id long, score double, tokens long")
    placed = storage.positions(rows, [F.col("score").desc(), F.col("doc_id")], "rank")
    want = [r["doc_id"] for r in sorted(rows.collect(), key=lambda r: (-r["score"], r["doc_id"]))]
    assert [r["doc_id"] for r in sorted(placed.collect(), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in placed.collect()) == list(range(1, 101))
    one = [tuple(r) for r in ranking.greedy_selection(placed, 9000).collect()]
    assert sorted(tuple(r) for r in ranking.greedy_selection(placed, 9000, block=4).collect()) == sorted(one) and len(one) > 20
    assert ranking.greedy_selection(placed.limit(0), 9000).collect() == []


def test_code_tokens_of_mixed_runs(spark):
    """Runs with other letters go as a whole, also behind and before letters beyond the basic plane; short names stay."""
    text = "aé éa abc \U0001d400abc abc\U0001d400 \U0001f600def 9a a9 _ __ x X b B ABC AbC Ab1 snake_Case"
    got = spark.createDataFrame([(text,)], "c string").select(T.code_tokens(F.col("c"), dedup=False).alias("t")).first()["t"]
    assert got == ["abc", "def", "a9", "__", "x", "x", "abc", "ab", "abc", "ab", "ab1", "snake", "case", "snake_case"]


def test_counted_terms(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["z"],)], "t array<string>")
    got = [[tuple(x) for x in r["c"]] for r in rows.select(T.counted(F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 2)], [], [("z", 1)]]


def test_term_counts_need_no_shuffle(spark, monkeypatch):
    """The index, as it is written, is made within the documents' rows."""
    plans = []
    monkeypatch.setattr(retrieval, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    docs = spark.createDataFrame([(1, "one two one"), (2, "")], "doc_id long, content string")
    got = retrieval.postings(retrieval.index(docs, dedup=False)).collect()
    assert sorted(map(tuple, got)) == [(1, 3, "one", 2), (1, 3, "two", 1)]
    assert "Exchange" not in plans[0]


def test_top_terms_of_a_row_are_those_of_the_rows(spark):
    """Ties go to the first term, also those of weights that differ after the ninth digit only."""
    rows = [(1, 2.0, [("b", 1.0), ("a", 1.0 + 1e-10), ("c", 1.0 + 2e-10), ("d", 0.5)]), (2, 1.0, [("x", 0.25)])]
    v = spark.createDataFrame(rows, "doc_id long, norm double, weights array<struct<term:string,raw:double>>")
    flat = v.select("doc_id", "norm", F.inline("weights")).select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))
    want = sorted((r["doc_id"], r["rank"], r["term"]) for r in retrieval.top_terms(flat, 2).collect())
    got = sorted((r["doc_id"], r["rank"], r["term"]) for r in retrieval.top_terms_of(v, 2).collect())
    assert got == want == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]


def test_similarity_shuffles_no_lists(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, "four")], "doc_id long, content string")
    idx = retrieval.index(docs)
    out = retrieval.tfidf_similarity(idx, retrieval.query_terms(spark, "one four six"))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]
