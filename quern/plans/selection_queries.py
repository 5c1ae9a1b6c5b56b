"""Queries of scans, factors, rules and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources.fixtures import SQL, changes, commits, files, table
from .history_queries import _r

PROMPT = "Why does src1 fail to handle the main order"
KEYWORDS = ["src1", "en", "7"]


def _sized(spark, d):
    return files(spark, d).withColumn("size", F.length(F.coalesce("content", F.lit(""))))


def s2_included_files(spark, d):
    ok = S.included(F.col("path"), F.col("size"), include=["*.en", "*.[df][er]"], exclude=["src1/*", "src?/*7.en"], largest=5000)
    return _sized(spark, d).where(ok).select("doc_id", "path")


def s4_find_by_name(spark, d):
    return files(spark, d).where(S.find_by_name(F.col("path"), "1?*.E[!S]")).select("doc_id", "path")


def s5_find_by_content(spark, d):
    return files(spark, d).where(S.find_by_content(F.col("content"), "LICENSE")).select("doc_id")


def s10_commits_between(spark, d):
    return S.commits_between(commits(spark, d), "1999-01-01", "1999-12-31", merges=False).select("commit_id", "author")


def s11_recent_commits(spark, d):
    return S.recent_commits(commits(spark, d), 25)


def s11_recent_of_files(spark, d):
    return S.recent_commits(commits(spark, d), 25, changes(spark, d), [1, 2, 3])


def s13_changed_files(spark, d):
    return S.changed_files(commits(spark, d), changes(spark, d), "2001-06-30", "2001-07-15")


def f6_path_structure(spark, d):
    cols = [F.round(S.path_structure(F.col("path"), KEYWORDS, t), 6).alias(t) for t in ("feature", "test")]
    return files(spark, d).select("doc_id", *cols)


def f10_complexity_relevance(spark, d):
    c = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", *(S.complexity_relevance(c, t).alias(t) for t in ("refactor", "debug", "feature")))


def f11_type_relevance(spark, d):
    path = F.lower(F.concat_ws("/", "p_type", "p_name"))
    return table(spark, d, "part").select("p_partkey", *(F.round(S.type_relevance(path, t), 6).alias(t) for t in ("test", "debug", "feature", "refactor", "other")))


def f16_author_relevance(spark, d):
    who = files(spark, d).select("doc_id", S.author_relevance(F.array(F.split("path", "/")[0]), PROMPT).alias("relevance"))
    return who


def f20_top_factors(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("size"), (F.length("p_name") / 100).alias("name"), F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(0.5).alias("third"))
    return _r(S.contributions(p, "p_partkey", {"size": 0.5, "name": 0.3, "third": 0.2}), "value", "contribution", "percent")


def t19_code_like(spark, d):
    return files(spark, d).groupBy(S.looks_like_code(F.col("content")).alias("code")).agg(F.count("*").alias("files"))


def m8_truncated(spark, d):
    return files(spark, d).select("doc_id", S.simple_truncate(F.col("content"), 0.3, 500).alias("summary"))


def n5_tasks(spark, d):
    words = F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("intent")
    rows = table(spark, d, "conversations").select(words).where("intent <> ''")
    return rows.groupBy(S.task_of(F.col("intent")).alias("task")).agg(F.count("*").alias("n"))


def n15_references(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", S.first_url(F.concat_ws(" ", F.lit("see"), "url", "html")).alias("url"))


def u4_injection_counts(spark, d):
    return _sized(spark, d).select("doc_id", S.injection_count(F.col("size"), F.lit(4)).alias("rules"))


def w1_sessions(spark, d):
    return S.sessions(table(spark, d, "conversations"))


def w4_tool_search(spark, d):
    tools = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return S.search_tools(tools, "a").select("p_partkey")


def p4_first_by_directory(spark, d):
    return S.first_of_each(_sized(spark, d).withColumn("dir", F.split("path", "/")[0]), "dir", [F.col("size").desc(), F.col("doc_id")]).select("dir", "doc_id", F.col("size").cast("long").alias("size"))


def p9_pinned_first(spark, d):
    f = files(spark, d)
    pinned = f.where(F.col("path").startswith("src3/")).select("doc_id", F.col("doc_id").alias("place"))
    found = f.where("language = 'en'").select("doc_id", F.col("doc_id").alias("place"))
    return S.pinned_first(pinned, found)


def r13_padded(spark, d):
    e = table(spark, d, "embeddings")
    v = F.slice(F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 384)), 1, 384)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", F.size(v).cast("long").alias("dimensions"), F.round(total, 5).alias("total"))


def r21_memory(spark, d):
    """Bytes that the vectors take, and the same in MB."""
    e = table(spark, d, "embeddings").agg(F.sum(F.size("embedding").cast("long") * 4).alias("bytes"))
    return e.select("bytes", F.round(F.col("bytes") / (1024 * 1024), 6).alias("mb"))


QUERIES = {k: f for k, f in sorted(globals().items()) if k[0] in "sftmnuwpr" and k[1:2].isdigit() and callable(f)}

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_GLOB = "regexp_matches({x}, '^(?s:.*\\.en)$') OR regexp_matches({x}, '^(?s:.*\\.[df][er])$')"
_OFF = "regexp_matches({x}, '^(?s:src1/.*)$') OR regexp_matches({x}, '^(?s:src./.*7\\.en)$')"
_IGN = "^(?s:\\.git|\\.svn|\\.hg|\\.bzr|node_modules|vendor|bower_components|__pycache__|.*\\.pyc|.*\\.pyo|\\.pytest_cache|\\.mypy_cache|venv|\\.venv|env|\\.env|build|dist|out|target|.*\\.egg-info|\\.idea|\\.vscode|.*\\.swp|.*\\.swo|\\.DS_Store|.*\\.log|.*\\.tmp|.*\\.temp|.*\\.cache)$"
_ARCH = "CASE " + " ".join(f"WHEN contains(p, '{k}') THEN {w}" for k, w in S.ARCHITECTURE.items()) + " ELSE 0.0 END"
_KEYS = " + ".join(f"CASE WHEN contains(p, '{k}') THEN 0.3 ELSE 0.0 END" for k in KEYWORDS)


def _type_sql(task):
    names, hit, miss, off, penalty = S.TYPES[task]
    has = lambda words: "(" + " OR ".join(f"contains(p, '{w}')" for w in words) + ")"
    score = f"CASE WHEN {has(names)} THEN {hit} ELSE {miss} END" if names else str(miss)
    return f"round(({score}) * CASE WHEN {has(off)} THEN {penalty} ELSE 1.0 END, 6)" if off else f"round({score}, 6)"


_SIGNS = " + ".join("CAST(contains(h, '" + s.replace("'", "''") + "') AS INT)" for s in S.CODE_SIGNS)
_TASK = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TASKS.items()) + " ELSE 'general' END"

ORACLES = {
    "s2_included_files": SQL + f", x AS (SELECT *, length(coalesce(content, '')) AS size, {_NAME} AS name FROM files) SELECT doc_id, path FROM x WHERE size <= 5000 AND ({_GLOB.format(x='path')} OR {_GLOB.format(x='name')}) AND NOT ({_OFF.format(x='path')} OR {_OFF.format(x='name')}) AND NOT regexp_matches(name, '{_IGN}')",
    "s4_find_by_name": SQL + f"SELECT doc_id, path FROM files WHERE regexp_matches(lower({_NAME}), '^1..*\\.e[^s]$')",
    "s5_find_by_content": SQL + "SELECT doc_id FROM files WHERE contains(lower(content), 'license')",
    "s10_commits_between": SQL + "SELECT commit_id, author FROM commits WHERE CAST(ts AS DATE) BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND NOT starts_with(lower(message), 'merge ')",
    "s11_recent_commits": SQL + "SELECT commit_id, string_split(message, chr(10))[1] AS title, strftime(ts, '%Y-%m-%d') AS day FROM commits ORDER BY ts DESC, commit_id LIMIT 25",
    "s11_recent_of_files": SQL + "SELECT commit_id, string_split(message, chr(10))[1] AS title, strftime(ts, '%Y-%m-%d') AS day FROM commits WHERE commit_id IN (SELECT commit_id FROM changes WHERE file IN (1, 2, 3)) ORDER BY ts DESC, commit_id LIMIT 25",
    "s13_changed_files": SQL + "SELECT DISTINCT file FROM changes JOIN commits USING (commit_id) WHERE CAST(ts AS DATE) > DATE '2001-06-30' AND CAST(ts AS DATE) <= DATE '2001-07-15'",
    "f6_path_structure": SQL + f", x AS (SELECT doc_id, p, len(string_split(p, '/')) AS n, {_KEYS} + {_ARCH} AS s, contains(p, 'test') OR contains(p, 'spec') AS t FROM (SELECT doc_id, lower(path) AS p FROM files)) SELECT doc_id, round(greatest(0.0, least(1.0, CASE WHEN t THEN s * 0.5 ELSE s END - greatest(0, n - 4) * 0.05)), 6)::DOUBLE AS feature, round(greatest(0.0, least(1.0, s + CASE WHEN t THEN 0.5 ELSE 0.0 END - greatest(0, n - 4) * 0.05)), 6)::DOUBLE AS test FROM x",
    "f10_complexity_relevance": "SELECT p_partkey, CASE WHEN c IS NULL THEN 0.5 WHEN c > 20 THEN 1.0 WHEN c > 10 THEN 0.8 WHEN c > 5 THEN 0.5 ELSE 0.2 END::DOUBLE AS refactor, CASE WHEN c IS NULL THEN 0.5 WHEN c > 15 THEN 0.8 WHEN c > 10 THEN 0.6 ELSE 0.4 END::DOUBLE AS debug, 0.5::DOUBLE AS feature FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END AS c FROM part)",
    "f11_type_relevance": f"SELECT p_partkey, {_type_sql('test')}::DOUBLE AS test, {_type_sql('debug')}::DOUBLE AS debug, {_type_sql('feature')}::DOUBLE AS feature, {_type_sql('refactor')}::DOUBLE AS refactor, 0.5::DOUBLE AS other FROM (SELECT p_partkey, lower(p_type || '/' || p_name) AS p FROM part)",
    "f16_author_relevance": SQL + f"SELECT doc_id, CASE WHEN contains('{PROMPT.lower()}', lower(string_split(path, '/')[1])) THEN 1.0 ELSE 0.5 END::DOUBLE AS relevance FROM files",
    "f20_top_factors": "WITH x AS (SELECT p_partkey, 'size' AS factor, p_size / 50 AS value, p_size / 50 * 0.5 AS c FROM part UNION ALL SELECT p_partkey, 'name', length(p_name) / 100, length(p_name) / 100 * 0.3 FROM part UNION ALL SELECT p_partkey, 'third', CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 0.5 END, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 0.5 END * 0.2 FROM part) SELECT p_partkey, factor, round(value, 6) AS value, round(c, 6) AS contribution, round(c / sum(c) OVER (PARTITION BY p_partkey) * 100, 6) AS percent, row_number() OVER (PARTITION BY p_partkey ORDER BY c DESC, factor) AS place FROM x WHERE c > 0",
    "t19_code_like": SQL + f"SELECT {_SIGNS} >= 2 AS code, count(*) AS files FROM (SELECT array_to_string(string_split(coalesce(content, ''), chr(10))[1:10], chr(10)) AS h FROM files) GROUP BY 1",
    "m8_truncated": SQL + ", x AS (SELECT doc_id, content, CAST(least(floor(length(content) * 0.3), 500) AS INT) AS n FROM files), y AS (SELECT *, substr(content, 1, n) AS h FROM x), z AS (SELECT *, CASE WHEN contains(h, '.') THEN n - strpos(reverse(h), '.') + 1 ELSE 0 END AS stop, CASE WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') ELSE length(h) END AS cut FROM y) SELECT doc_id, CASE WHEN length(content) <= n THEN content WHEN stop > 0 AND stop - 1 > n * 0.8 THEN substr(h, 1, stop) ELSE substr(h, 1, cut) || '...' END AS summary FROM z",
    "n5_tasks": f"SELECT {_TASK} AS task, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS intent FROM conversations) WHERE intent <> '' GROUP BY 1",
    "n15_references": r"""SELECT page_id, nullif(regexp_extract(concat_ws(' ', 'see', url, html), 'https?://[^\s<>"{}|\\^`\[\]]+', 0), '') AS url FROM pages""",
    "u4_injection_counts": SQL + "SELECT doc_id, CAST(least(CASE WHEN n < 1000 THEN 1 WHEN n < 5000 THEN 2 WHEN n < 20000 THEN 3 WHEN n < 50000 THEN 5 ELSE 7 END, 4, 33) AS BIGINT) AS rules FROM (SELECT doc_id, length(coalesce(content, '')) AS n FROM files)",
    "w1_sessions": "SELECT conv_id, count(*) AS turns, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, max(turn) AS last_turn, conv_id = max(conv_id) OVER () AS active FROM conversations GROUP BY 1",
    "w4_tool_search": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')",
    "p4_first_by_directory": SQL + "SELECT dir, doc_id, size FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY size DESC, doc_id) AS r FROM (SELECT doc_id, string_split(path, '/')[1] AS dir, length(coalesce(content, '')) AS size FROM files)) WHERE r = 1",
    "p9_pinned_first": SQL + "SELECT doc_id, min(part) AS part, doc_id AS place FROM (SELECT doc_id, 0 AS part FROM files WHERE starts_with(path, 'src3/') UNION ALL SELECT doc_id, 1 FROM files WHERE language = 'en') GROUP BY 1",
    "r13_padded": "SELECT vec_id, CAST(384 AS BIGINT) AS dimensions, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings",
    "r21_memory": "SELECT CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes, round(sum(len(embedding) * 4) / (1024 * 1024), 6) AS mb FROM embeddings",
}
