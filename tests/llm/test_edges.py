"""Nulls, empty and repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, html_extract, langid, line_dedup, ngram_join, packing, pii, quality_crf, quality_rules, warc

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ROWS = [(1, None, None, None), (2, "", "en", "a"), (None, "no id here at all", "en", "a"), (4, "one two three four five six", None, "b"), (4, "one two three four five six", None, "b"), (5, " \n\t\n", "fr", ""), (6, LONG, "de", "a"), (7, "Ünïcode 12 ✓", "de", None)]
CLASH = ("node", "comp", "chunk", "chunks", "tokens", "label", "row", "host", "line", "content", "drop", "t", "kept", "n_words", "hits", "items", "rank", "length", "task", "rep", "key")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASH})


def held(df):
    return df.withColumn("held_out", F.lit(False))


FORMS = {
    "join": ngram_join.jaccard_components,
    "one": ngram_join.keep_one_per_component,
    "packed": packing.packed,
    "pii": pii.personal_data,
    "rules": quality_rules.quality_rules,
    "apply": quality_rules.apply_rules,
    "lines": line_dedup.deduplicated,
    "language": lambda d: langid.languages(held(d), d),
    "quality": lambda d: quality_crf.quality(held(d), d.select("text", (F.col("doc_id") % 2).cast("int").alias("quality"))),
    "leaks": lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 4")),
    "clean": lambda d: decontaminate.without_contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 4")),
}
EVERY_ROW = ("join", "packed", "pii", "rules", "lines", "language", "quality", "leaks")


@pytest.mark.parametrize("name", sorted(FORMS))
def test_odd_rows(docs, name):
    rows = FORMS[name](docs).collect()
    if name == "packed":
        rows = [r for r in rows if r["piece"] == 0]
    if name in EVERY_ROW:
        assert len(rows) == len(ROWS)
    if name == "one":
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 4, 5, 6, 7]
        assert set(rows[0].asDict()) == set(docs.columns)
    if name == "clean":
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 5, 6, 7]
    if name == "language":
        assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 5)} == {"und"}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_empty_table(docs, name):
    assert FORMS[name](docs.limit(0)).collect() == []


def test_pages(spark):
    schema = "page_id long, url string, html string, digest string, top string"
    df = spark.createDataFrame([(1, None, None, "", ""), (None, "u", "", "", ""), (2, "u", "<p>a b</p>", "", ""), (2, "u", "<p>a b</p>", "", "")], schema)
    for form in (html_extract.main_text, warc.archive_round_trip):
        assert len(form(df).collect()) == 4
        assert form(df.limit(0)).collect() == []
