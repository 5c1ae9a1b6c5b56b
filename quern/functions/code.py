"""Source code as text: languages, comments, documentation and test signs. Column to column, without Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _let, condensed

#: Language by extension.
EXTENSIONS = {
    "py": "python", "pyw": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "c": "c",
    "cc": "cpp", "cpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby", "sh": "shell", "bash": "bash", "sql": "sql",
    "kt": "kotlin", "kts": "kotlin", "scala": "scala", "swift": "swift", "hs": "haskell", "lua": "lua",
}
#: Fixed values: (languages, line markers, block marks) of comments.
COMMENTS = [
    (["python"], ["#"], [('"""', '"""'), ("'''", "'''")]),
    (["javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "kotlin", "scala", "swift"], ["//"], [("/*", "*/")]),
    (["php"], ["//", "#"], [("/*", "*/")]),
    (["ruby", "shell", "bash"], ["#"], []),
    (["sql"], ["--"], [("/*", "*/")]),
    (["haskell"], ["--"], [("{-", "-}")]),
    (["lua"], ["--"], [("--[[", "]]--")]),
]
#: Signs of documentation, and of tests (in any case).
DOC_SIGNS = ["@param", "@return", "@throws", "Args:", "Returns:", "Raises:", ":param", ":return:", ":raises:"]
TEST_SIGNS = ["@test", "def test_", "describe(", "it(", "expect(", "assert", "mock", "fixture"]

#: White space and line ends of Unicode, for classes of regular expressions.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def language_of(path: Column) -> Column:
    """By the text after the last dot; empty if unknown."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(path.contains("."), F.coalesce(F.element_at(known, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit(""))).otherwise("")


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    return _let(F.split(text, BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def _filled(rows: Column) -> Column:
    return F.size(F.filter(rows, lambda x: x.rlike(f"[^{SPACE}]"))).cast("long")


def filled(text: Column) -> Column:
    """How many lines hold more than white space."""
    return _filled(lines(text))


def _cutter(markers: list[str]):
    """A line up to a marker that stands outside quotes: runs of other characters, and strings up to their end or the line's.

    All loops are possessive: none goes back, and none takes the stack of a recursion.
    """
    starts = "".join(sorted({re.escape(m[0]) for m in markers}))
    string = lambda q: rf"{q}(?:[^{q}\\]++|\\.?+)*+(?:{q}|\z)"
    other = f"(?!{'|'.join(re.escape(m) for m in markers)})[{starts}]"
    head = rf"^(?s:[^'\"{starts}]++|{string('"')}|{string("'")}|{other})*+"

    def cut(line: Column) -> Column:
        strip = lambda kept: F.when((kept == line) | ~kept.rlike(f"[^{SPACE}]"), kept).otherwise(F.regexp_replace(kept, f"[{SPACE}]+\\z", ""))
        return _let(F.regexp_extract(line, head, 0), strip)

    return cut


def _facts(text: Column, had: Column, has: Column) -> Column:
    return F.struct(text.alias("bare"), had.alias("filled"), has.alias("left"))


def _stripper(text: Column, markers: list[str], blocks: list[tuple[str, str]]):
    def of(rows: Column) -> Column:
        bare = F.array_join(F.transform(rows, _cutter(markers)), "\n")
        for start, end in blocks:
            bare = F.regexp_replace(bare, re.escape(start) + r"[\s\S]*?" + re.escape(end), "")
        done = _let(bare, lambda b: _facts(b, _filled(rows), filled(b)))
        return _let(done, lambda d: F.when((d["filled"] > 0) & (d["left"] / d["filled"] < 0.4), _facts(text, d["filled"], d["filled"])).otherwise(d))

    return of


def _stripped(text: Column, language: Column) -> Column:
    """(bare, filled, left): the text without comments, and how many filled lines it had and has; 0 and 0 if it was not looked at."""
    out = _facts(text, F.lit(0).cast("long"), F.lit(0).cast("long"))
    for names, markers, blocks in COMMENTS:
        of = _stripper(text, markers, blocks)
        out = F.when(language.isin(names) & (text != ""), _let(lines(text), of)).otherwise(out)
    return out


def without_comments(text: Column, language: Column) -> Column:
    """Text without the language's comments; unchanged if it is empty, the language unknown or 60 % of its lines would go.

    Quotes are followed within a line, escapes within quotes. Line comments go first, block comments after.
    """
    return _stripped(text, language)["bare"]


def transformed(text: Column, language: Column) -> Column:
    """(content, removed_comment_lines, condensed_blank_runs, changed): comments stripped, then white space condensed."""
    runs = lambda t: ((F.length(t) - F.length(F.replace(t, F.lit("\n\n\n"), F.lit("")))) / 3).cast("long")
    zero = F.lit(0).cast("long")

    def facts(s: Column) -> Column:
        return _let(condensed(s["bare"], one_newline=False), lambda done: F.struct(
            done.alias("content"), F.greatest(zero, s["filled"] - s["left"]).alias("removed_comment_lines"),
            F.greatest(zero, runs(s["bare"]) - runs(done)).alias("condensed_blank_runs"), (done != text).alias("changed"),
        ))

    return _let(_stripped(text, language), facts)


def documentation_score(text: Column, language: Column) -> Column:
    """Signs of documentation, of five: an opening docstring two, tenths of comment lines one each, known tags a half each."""
    rows = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, f"^[{SPACE}]+", ""))
    opening = (language == "python") & (rows[0].startswith('"""') | rows[0].startswith("'''"))
    share = F.size(F.filter(rows, lambda x: x.startswith("#") | x.startswith("//"))) / F.size(rows)
    score = F.when(opening, 2.0).otherwise(0.0) + (share > 0.1).cast("double") + (share > 0.2).cast("double")
    for sign in DOC_SIGNS:
        score = score + F.when(text.contains(sign), 0.5).otherwise(0.0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), score / 5))


def test_relevance(text: Column, path: Column) -> Column:
    """1 of a test's path, else a third for each sign of tests, at most 1."""
    low, p = F.lower(F.coalesce(text, F.lit(""))), F.lower(path)
    signs = F.lit(0)
    for sign in TEST_SIGNS:
        signs = signs + low.contains(sign).cast("int")
    return F.when(p.contains("test") | p.contains("spec"), 1.0).otherwise(F.least(F.lit(1.0), signs / 3))


def position_keyword_score(text: Column, path: Column, keywords: list[str], imports: Column, classes: Column, functions: Column) -> Column:
    """Keywords in the file's name, in imported, class and function names, and in its first 100 lines, earlier ones more."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    head = F.slice(F.split(F.lower(text), "\n", -1), 1, 100)

    def part(k: str) -> Column:
        found = F.when(name.contains(k), 0.4).otherwise(0.0)
        for names, weight in ((imports, 0.3), (classes, 0.3), (functions, 0.4)):
            found = found + F.when(F.exists(names, lambda n: F.lower(n).contains(k)), weight).otherwise(0.0)
        at = F.transform(head, lambda x, i: F.when(x.contains(k), 0.15 * (1 - i / 100 * 0.5)).otherwise(0.0))
        return F.least(F.lit(1.0), found + F.aggregate(at, F.lit(0.0), lambda acc, x: acc + x))

    total = F.lit(0.0)
    for k in keywords:
        total = total + part(k.lower())
    score = F.least(F.lit(1.0), total / max(1, len(keywords)) * 1.1)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(score) if keywords else F.lit(0.0)


def depth_score(depth: Column) -> Column:
    """1, 0.8, 0.6, 0.4 for files 0 to 3 imports deep, 0.2 beyond, 0.5 where unknown."""
    return F.when(depth.isNull() | (depth < 0), 0.5).when(depth > 3, 0.2).otherwise(1 - depth * 0.2)


def relative_time(phrase: Column, base: Column) -> Column:
    """The time that a phrase such as "2 weeks ago" names, seen from base; 30 days before it if it names none."""
    p = F.lower(F.trim(phrase))
    count = lambda unit: F.regexp_extract(p, rf"(\d+)\s*{unit}s?\s*ago", 1)
    days = F.lit(None).cast("int")
    for found, value in reversed([
        (count("day") != "", count("day").cast("int")), (count("week") != "", count("week").cast("int") * 7), (count("month") != "", count("month").cast("int") * 30),
        (p.contains("yesterday"), F.lit(1)), (p.contains("today"), F.lit(0)), (p.rlike(r"last\s*week"), F.lit(7)), (p.rlike(r"last\s*month"), F.lit(30)),
    ]):
        days = F.when(found, value).otherwise(days)
    return base - F.make_dt_interval(F.coalesce(days, F.lit(30)))
