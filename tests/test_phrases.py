"""Hand-computed cases of phrases and summaries, and the windows of a stream against those of the table."""

from pyspark.sql import functions as F

from quern.operators import phrases, ranking
from quern.plans.phrase_queries import AS_OF
from quern.streaming.activity import windowed_activity
from tests.oracle import DATA


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def test_rake(spark):
    got = phrases.rake_phrases(docs(spark, "Big red car and the car. Blue sky!", None, "", "one two three four"), 5).collect()
    assert sorted((r["doc_id"], r["rank"], r["phrase"], r["score"]) for r in got) == [(0, 1, "big red car", 8.0), (0, 2, "blue sky", 4.0), (0, 3, "car", 2.0)]


def test_extractive_summary(spark):
    got = {r["doc_id"]: (r["n_sentences"], r["summary"]) for r in phrases.extractive_summary(docs(spark, "Alpha alpha alpha. Bee. Cee dee.", None, "", "..."), 0.6).collect()}
    assert got == {0: (1, "Alpha alpha alpha"), 1: (0, None), 2: (0, ""), 3: (0, "...")}


def test_change_factors(spark):
    rows = spark.createDataFrame([(None, 0), (7, 5), (8, 20), (90, 50), (91, 10**6)], "days long, n long")
    got = rows.select(ranking.recency_steps(F.col("days")).alias("s"), ranking.change_frequency(F.col("n")).alias("f")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0), (1.0, 0.3), (0.7, 0.6), (0.4, 0.8), (0.1, 1.0)]
    assert AS_OF == "2001-08-01"


def test_stream_has_the_windows_of_the_table(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(f"{DATA}/sf0.001")
    q = windowed_activity(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["events"]) for r in df.collect())
    assert key(spark.table("windows")) == key(windowed_activity(batch)) != []


def test_summaries_need_no_shuffle(spark):
    """Documents without sentences, without long words, with a sentence that repeats, and none."""
    texts = ["", "...", "a b. c d!", "Same words here. Same words here. Other things there? x", " \t. One", "no end", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    out = phrases.extractive_summary(docs, ratio=0.5)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: (r["n_sentences"], r["summary"]) for r in out.collect()}
    assert got == {0: (0, ""), 1: (0, "..."), 2: (1, "a b"), 3: (1, "Same words here"), 4: (1, "One"), 5: (0, ""), 6: (0, None)}
