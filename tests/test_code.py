"""Hand-computed cases of comments, languages, times and factors."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import code as C


def one(spark, c, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("python", "a = 1  # one\nb = '#no' # yes\n", "a = 1\nb = '#no'"),
        ("python", 'x = "a\\"#b" # c\ny = 2', 'x = "a\\"#b"\ny = 2'),
        ("python", "it's # kept\nz", "it's # kept\nz"),
        ("javascript", "a / b // c\n/* d\ne */f", "a / b\nf"),
        ("javascript", "u = 'http://x' // y\nv", "u = 'http://x'\nv"),
        ("sql", "select 1 - 2 -- three\nfrom t", "select 1 - 2\nfrom t"),
        ("python", "# a\n# b\n# c\nd", "# a\n# b\n# c\nd"),
        ("", "a # b", "a # b"),
        ("python", "", ""),
        ("python", None, None),
    ],
)
def test_without_comments(spark, language, text, want):
    assert one(spark, C.without_comments(F.col("c0"), F.col("c1")), text, language) == want


def test_without_comments_of_a_long_line(spark):
    text = "'a' " * 50_000 + "# end"
    assert one(spark, C.without_comments(F.col("c0"), F.col("c1")), text, "python") == text[:-5].rstrip()


def test_transformed(spark):
    got = one(spark, C.transformed(F.col("c0"), F.col("c1")), "a  \n\n\n\nb # c\n# d\ne", "python")
    assert tuple(got) == ("a\n\nb\n\ne\n", 1, 1, True)
    assert tuple(one(spark, C.transformed(F.col("c0"), F.col("c1")), "a\n", "")) == ("a\n", 0, 0, False)


def test_languages(spark):
    assert [one(spark, C.language_of(F.col("c0")), p) for p in ("a/B.PY", "x.tar.rs", "py", "a.unknown")] == ["python", "rust", "", ""]


def test_scores(spark):
    assert one(spark, C.documentation_score(F.col("c0"), F.col("c1")), '"""Doc\nArgs: x\n', "python") == pytest.approx(0.5)
    assert one(spark, C.test_relevance(F.col("c0"), F.col("c1")), "assert Mock", "src/a.py") == pytest.approx(2 / 3)
    assert one(spark, C.test_relevance(F.col("c0"), F.col("c1")), None, "spec/a.py") == 1.0
    none = F.array().cast("array<string>")
    score = C.position_keyword_score(F.col("c0"), F.col("c1"), ["Key"], none, none, F.array(F.lit("monkey")))
    assert one(spark, score, "x\na key\n", "src/b.py") == pytest.approx(1.1 * (0.4 + 0.15 * 0.995))


def test_relative_time(spark):
    base = F.lit("2024-03-31 12:00:00").cast("timestamp")
    days = {"2 weeks ago": 14, "3 Days ago": 3, "1 month ago": 30, "yesterday": 1, "today": 0, "last month": 30, "whenever": 30}
    start = datetime.datetime(2024, 3, 31, 12)
    got = {p: one(spark, C.relative_time(F.col("c0"), base).cast("string"), p) for p in days}
    assert got == {p: str(start - datetime.timedelta(days=d)) for p, d in days.items()}


def _scanned(line, markers):
    """A line up to a marker outside quotes, by a scan of its characters."""
    quote, i = "", 0
    while i < len(line):
        if quote:
            i += line[i] == "\\"
            quote = "" if i < len(line) and line[i] == quote and line[i - 1 : i] != "\\" else quote
            # an escaped character never closes
        elif line[i] in "'\"":
            quote = line[i]
        elif any(line.startswith(m, i) for m in markers):
            kept = line[:i]
            return kept.rstrip() if kept.strip() else kept
        i += 1
    return line


@pytest.mark.parametrize(("language", "markers"), [("ruby", ["#"]), ("php", ["//", "#"]), ("sql", ["--"]), ("lua", ["--"])])
def test_cut_lines_against_a_scan(spark, language, markers):
    """Every string of up to five characters of a small alphabet, between lines that stay."""
    from itertools import product

    all_lines = ["x" + "".join(p) for n in range(1, 6) for p in product("'\"#/-b ", repeat=n)]
    got = one(spark, C.without_comments(F.col("c0"), F.col("c1")), "\n".join(all_lines), language)
    assert got.split("\n") == [_scanned(x, markers) for x in all_lines]


@pytest.mark.parametrize(("line", "want"), [('"a\\', '"a\\'), ('"\\\\" # b', '"\\\\"'), ('"\\" # b', '"\\" # b'), ("\\' # b", "\\' # b"), ("'a\"' # \"", "'a\"'"), ("'' ''#'", "'' ''")])
def test_cut_lines_with_escapes(spark, line, want):
    assert one(spark, C.without_comments(F.col("c0"), F.col("c1")), line, "ruby") == want


def test_lines_are_split_once(spark):
    """Of each language's text: its lines, and those of what is left."""
    rows = spark.range(1).selectExpr("string(id) t", "string(id) l")
    plan = rows.select(C.transformed(F.col("t"), F.col("l")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 * len(C.COMMENTS)
