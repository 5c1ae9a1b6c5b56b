"""Queries over source code: languages, comments, documentation and test signs, keyword positions, relative times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..sources.fixtures import SQL, files, table

KEYWORDS = ["thing", "src1", "erand", "onth"]
#: Programming languages that stand for those of the documents.
_EXTENSION = {"en": "py", "de": "js", "fr": "sql", "es": "rb"}


def code_files(spark, d):
    """Documents as code: sentences open line comments, quotes and escapes stay, one word opens a block."""
    f = files(spark, d)
    known = F.create_map(*[F.lit(x) for pair in _EXTENSION.items() for x in pair])
    path = F.concat(F.split("path", r"\.")[0], F.lit("."), F.coalesce(F.element_at(known, F.col("language")), F.lit("txt")))
    f = f.select("doc_id", path.alias("path"), "content").withColumn("language", C.language_of(F.col("path")))
    mark = F.when(F.col("language") == "javascript", "//").when(F.col("language") == "sql", "--").otherwise("#")
    text = F.replace(F.replace(F.col("content"), F.lit(". "), F.concat(F.lit(". "), mark, F.lit(" "))), F.lit(", "), F.lit(' "\\" '))
    return f.withColumn("content", F.regexp_replace(text, " (und|des) ", r" /\* $1 \*/ "))


def t11_without_comments(spark, d):
    c = code_files(spark, d).select("doc_id", C.without_comments(F.col("content"), F.col("language")).alias("bare"))
    return c.select("doc_id", F.length("bare").cast("long").alias("n"), F.md5("bare").alias("digest"))


def t13_transformed(spark, d):
    c = code_files(spark, d).select("doc_id", C.transformed(F.col("content"), F.col("language")).alias("t"))
    return c.select("doc_id", F.md5("t.content").alias("digest"), "t.removed_comment_lines", "t.condensed_blank_runs", "t.changed")


def t14_languages(spark, d):
    return code_files(spark, d).groupBy("language").agg(F.count("*").alias("files"))


def f5_position_keywords(spark, d):
    words = F.split(F.substring("content", 1, 200), " ", -1)
    c = code_files(spark, d).select("doc_id", "path", "content", F.slice(words, 1, 2).alias("i"), F.slice(words, 3, 2).alias("c"), F.slice(words, 5, 2).alias("f"))
    return c.select("doc_id", F.round(C.position_keyword_score(F.col("content"), F.col("path"), KEYWORDS, F.col("i"), F.col("c"), F.col("f")), 6).alias("score"))


def f13_documentation(spark, d):
    return code_files(spark, d).select("doc_id", F.round(C.documentation_score(F.col("content"), F.col("language")), 6).alias("score"))


def f14_test_relevance(spark, d):
    return code_files(spark, d).select("doc_id", F.round(C.test_relevance(F.col("content"), F.col("path")), 6).alias("score"))


def f15_depth_score(spark, d):
    depth = F.when(F.col("p_size") > 40, None).otherwise(F.col("p_size") % 7 - 1)
    return table(spark, d, "part").select("p_partkey", F.round(C.depth_score(depth), 6).alias("score"))


_PHRASES = ["{n} days ago", "{n}weeks ago", "{n} month ago", "Yesterday", " today", "last  week", "last month", "some time"]


def g15_relative_times(spark, d):
    n = F.col("p_size").cast("string")
    phrase = F.element_at(F.array(*[F.concat(*[n if x == "{n}" else F.lit(x) for x in p.replace("{n}", "\0{n}\0").split("\0")]) for p in _PHRASES]), (F.col("p_partkey") % len(_PHRASES) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.relative_time(phrase, F.lit("2024-03-31 12:00:00").cast("timestamp")).alias("at"))


QUERIES = {f.__name__: f for f in (t11_without_comments, t13_transformed, t14_languages, f5_position_keywords, f13_documentation, f14_test_relevance, f15_depth_score, g15_relative_times)}

_CODE = SQL + r""", lang AS (SELECT doc_id, string_split(path, '.')[1] || '.' || CASE language WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'sql' WHEN 'es' THEN 'rb' ELSE 'txt' END AS path, content FROM files),
marked AS (SELECT doc_id, path, content, string_split(path, '.')[-1] AS ext FROM lang),
code AS (SELECT doc_id, path, ext, CASE ext WHEN 'js' THEN '//' WHEN 'sql' THEN '--' ELSE '#' END AS mark,
  regexp_replace(replace(replace(content, '. ', '. ' || CASE ext WHEN 'js' THEN '//' WHEN 'sql' THEN '--' ELSE '#' END || ' '), ', ', ' "\" '), ' (und|des) ', ' /* \1 */ ', 'g') AS content FROM marked)
"""


def _lines(x: str) -> str:
    return f"regexp_split_to_array({x}, '{C.BREAK}')"


def _filled(x: str) -> str:
    return f"CAST(len(list_filter({_lines(x)}, lambda l: regexp_matches(l, '[^{C.SPACE}]'))) AS BIGINT)"


def _head_sql(mark: str) -> str:
    """The part of a line before the first open mark: strings as wholes, a half mark only before something else."""
    c = mark[0]
    strings = r""""(?s:[^"\\]|\\.)*"|''(?s:[^''\\]|\\.)*''"""
    half = f"{c}?" if len(mark) == 2 else ""
    return f"""regexp_extract(l, '^(?:{half}(?:[^''"{c}]|{strings}))*', 0)"""


_CUT = "CASE ext " + " ".join(f"WHEN '{e}' THEN {_head_sql(m)}" for e, m in {"py": "#", "js": "//", "sql": "--", "rb": "#"}.items()) + " ELSE l END"
_BARE = (
    _CODE
    + rf""", split AS (SELECT doc_id, ext, mark, content, {_lines('content')} AS ls FROM code),
each AS (SELECT doc_id, ext, mark, content, unnest(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) AS l, unnest(range(1, len(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) + 1)) AS i FROM split),
cuts AS (SELECT doc_id, ext, content, i, l, {_CUT} AS h, mark FROM each),
kept AS (SELECT doc_id, ext, content, i, CASE WHEN NOT starts_with(substr(l, length(h) + 1), mark) THEN l WHEN NOT regexp_matches(h, '[^{C.SPACE}]') THEN h ELSE regexp_replace(h, '[{C.SPACE}]+$', '') END AS l FROM cuts),
joined AS (SELECT doc_id, ext, any_value(content) AS content, string_agg(l, chr(10) ORDER BY i) AS b FROM kept GROUP BY 1, 2),
blocks AS (SELECT doc_id, ext, content, CASE ext WHEN 'py' THEN regexp_replace(regexp_replace(b, '"{{3}}(?s:.*?)"{{3}}', '', 'g'), '''{{3}}(?s:.*?)''{{3}}', '', 'g') WHEN 'js' THEN regexp_replace(b, '/\*(?s:.*?)\*/', '', 'g') WHEN 'sql' THEN regexp_replace(b, '/\*(?s:.*?)\*/', '', 'g') ELSE b END AS b FROM joined),
bare AS (SELECT c.doc_id, c.content, CASE WHEN c.content = '' OR c.ext = 'txt' OR b.b IS NULL THEN c.content WHEN {_filled('c.content')} > 0 AND {_filled('b.b')} / {_filled('c.content')} < 0.4 THEN c.content ELSE b.b END AS b FROM code c LEFT JOIN blocks b USING (doc_id))
"""
)
_HEAD = "string_split(lower(content), chr(10))[1:100]"


def _keyword_part(k: str) -> str:
    named = lambda names, w: f"CASE WHEN len(list_filter({names}, lambda n: contains(lower(n), '{k}'))) > 0 THEN {w} ELSE 0 END"
    at = f"coalesce(list_sum(list_transform({_HEAD}, lambda x, i: CASE WHEN contains(x, '{k}') THEN 0.15::DOUBLE * (1 - (i - 1) / 100 * 0.5) ELSE 0 END)), 0)"
    return f"least(1.0, CASE WHEN contains(lower(string_split(path, '/')[-1]), '{k}') THEN 0.4 ELSE 0 END + {named('w[1:2]', 0.3)} + {named('w[3:4]', 0.3)} + {named('w[5:6]', 0.4)} + {at})"


_DOC = " + ".join(f"CASE WHEN contains(content, '{s}') THEN 0.5 ELSE 0 END" for s in C.DOC_SIGNS)
_TEST = " + ".join(f"CAST(contains(lower(content), '{s}') AS INT)" for s in C.TEST_SIGNS)
_DAYS = "CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size * 7 WHEN 2 THEN p_size * 30 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 7 ELSE 30 END"

ORACLES = {
    "t11_without_comments": _BARE + "SELECT doc_id, CAST(length(b) AS BIGINT) AS n, md5(b) AS digest FROM bare",
    "t13_transformed": _BARE + rf""", done AS (SELECT doc_id, content, b, CASE WHEN b = '' THEN b WHEN ends_with(c, chr(10)) THEN c ELSE c || chr(10) END AS c FROM (SELECT *, regexp_replace(regexp_replace(b, '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS c FROM bare))
SELECT doc_id, md5(c) AS digest, greatest(0, {_filled('content')} - {_filled('b')}) AS removed_comment_lines, greatest(0, CAST((length(b) - length(replace(b, repeat(chr(10), 3), ''))) / 3 AS BIGINT) - CAST((length(c) - length(replace(c, repeat(chr(10), 3), ''))) / 3 AS BIGINT)) AS condensed_blank_runs, c <> content AS changed FROM done""",
    "t14_languages": _CODE + "SELECT CASE ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'sql' THEN 'sql' WHEN 'rb' THEN 'ruby' ELSE '' END AS language, count(*) AS files FROM code GROUP BY 1",
    "f5_position_keywords": _CODE + f", w AS (SELECT *, string_split(substr(content, 1, 200), ' ') AS w FROM code) SELECT doc_id, round(CASE WHEN coalesce(content, '') = '' THEN 0.0 ELSE least(1.0, ({' + '.join(_keyword_part(k) for k in KEYWORDS)}) / {len(KEYWORDS)} * 1.1) END::DOUBLE, 6) AS score FROM w",
    "f13_documentation": _CODE + rf", x AS (SELECT doc_id, ext, content, list_transform(string_split(content, chr(10)), lambda l: regexp_replace(l, '^[{C.SPACE}]+', '')) AS ls FROM code), y AS (SELECT *, len(list_filter(ls, lambda l: starts_with(l, '#') OR starts_with(l, '//'))) / len(ls) AS share FROM x) SELECT doc_id, round(CASE WHEN coalesce(content, '') = '' THEN 0.0 ELSE least(1.0, (CASE WHEN ext = 'py' AND (starts_with(ls[1], '\"\"\"') OR starts_with(ls[1], repeat(chr(39), 3))) THEN 2 ELSE 0 END + CAST(share > 0.1 AS INT) + CAST(share > 0.2 AS INT) + {_DOC}) / 5) END::DOUBLE, 6) AS score FROM y",
    "f14_test_relevance": _CODE + f"SELECT doc_id, round(CASE WHEN contains(lower(path), 'test') OR contains(lower(path), 'spec') THEN 1.0 ELSE least(1.0, ({_TEST}) / 3) END::DOUBLE, 6) AS score FROM (SELECT doc_id, path, coalesce(content, '') AS content FROM code)",
    "f15_depth_score": "SELECT p_partkey, CASE WHEN p_size > 40 OR p_size % 7 = 0 THEN 0.5 WHEN p_size % 7 - 1 > 3 THEN 0.2 ELSE round(1 - (p_size % 7 - 1) * 0.2, 6) END::DOUBLE AS score FROM part",
    "g15_relative_times": f"SELECT p_partkey, TIMESTAMP '2024-03-31 12:00:00' - to_days(CAST({_DAYS} AS INT)) AS at FROM part",
}
