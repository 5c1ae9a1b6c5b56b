"""Queries: key phrases, extractive summaries, recency factors, windowed activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import CODE_STOP_WORDS
from ..operators import history, phrases, ranking
from ..sources.fixtures import SQL, changes, commits, files, table
from ..streaming.activity import windowed_activity

AS_OF = "2001-08-01"


def t6_rake_phrases(spark, d):
    return phrases.rake_phrases(files(spark, d), 5)


def m2_extractive_summary(spark, d):
    s = phrases.extractive_summary(files(spark, d))
    return s.select("doc_id", "n_sentences", F.md5("summary").alias("digest"))


def f4_recency_frequency(spark, d):
    c = history.file_commits(commits(spark, d), changes(spark, d)).groupBy("file").agg(F.max("ts").alias("last"), F.sum("one").alias("n"))
    days = F.floor((F.lit(AS_OF).cast("timestamp").cast("long") - F.col("last").cast("long")) / 86400)
    c = c.withColumn("days", days)
    return c.select("file", ranking.recency_steps(F.col("days")).alias("steps"), F.round(ranking.recency_decay(F.col("days")), 6).alias("decay"), F.round(ranking.change_frequency(F.col("n")), 6).alias("frequency"))


def sw1_windowed_activity(spark, d):
    return windowed_activity(table(spark, d, "events"), "1 day").withColumn("total", F.round("total", 3)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (t6_rake_phrases, m2_extractive_summary, f4_recency_frequency, sw1_windowed_activity)}

_STOP = ", ".join(f"'{w}'" for w in CODE_STOP_WORDS)
ORACLES = {
    "t6_rake_phrases": SQL + f""", ws AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(lower(content), '[.!?\\n]+', ' \n ', 'g'), '[^\\p{{L}}\\p{{N}}_\\n]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM files),
runs AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(ws, lambda w: CASE WHEN w IN ({_STOP}) THEN chr(10) ELSE w END), ' '), chr(10)), lambda p: trim(p)), lambda p: p <> '' AND len(string_split(p, ' ')) <= 3) AS ps FROM ws),
f AS (SELECT doc_id, unnest(ps) AS phrase, unnest(range(len(ps))) AS pos FROM runs),
p AS (SELECT doc_id, phrase, min(pos) AS pos, count(*) AS n, len(string_split(phrase, ' ')) AS size FROM f GROUP BY doc_id, phrase),
w AS (SELECT *, unnest(string_split(phrase, ' ')) AS word FROM p),
sc AS (SELECT doc_id, word, sum(n * size) / sum(n) AS s FROM w GROUP BY 1, 2),
tot AS (SELECT doc_id, phrase, pos, round(sum(s), 6) AS score FROM w JOIN sc USING (doc_id, word) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM tot)
SELECT doc_id, rank, phrase, score FROM r WHERE rank <= 5""",
    "m2_extractive_summary": SQL + r""", sp AS (SELECT doc_id, content, floor(length(content) * 3e-1) AS target, list_filter(list_transform(regexp_split_to_array(content, '[.!?]+'), lambda s: regexp_replace(s, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')), lambda s: s <> '') AS a FROM files),
se AS (SELECT doc_id, target, len(a) AS n, unnest(a) AS sentence, unnest(range(len(a))) AS i FROM sp),
wo AS (SELECT doc_id, i, unnest(regexp_split_to_array(lower(sentence), '[ \t-\r]+')) AS word FROM se),
fr AS (SELECT doc_id, word, count(*) AS c FROM wo WHERE length(word) > 3 GROUP BY 1, 2),
de AS (SELECT doc_id, i, CAST(sum(coalesce(c, 0)) AS DOUBLE) / count(*) AS density FROM wo LEFT JOIN fr USING (doc_id, word) GROUP BY 1, 2),
sc AS (SELECT *, round((1e0 - i / n * 5e-1) * 3e-1 + density * 5e-1 + least(1e0, length(sentence) / 100) * 2e-1, 9) AS score FROM se JOIN de USING (doc_id, i)),
us AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) AS used FROM sc),
tk AS (SELECT doc_id, count(*) AS k, string_agg(sentence, ' ' ORDER BY i) AS joined FROM us WHERE used <= target GROUP BY 1)
SELECT doc_id, coalesce(k, 0) AS n_sentences, md5(CASE WHEN len(a) > 0 THEN coalesce(joined, '') ELSE content END) AS digest FROM sp LEFT JOIN tk USING (doc_id)""",
    "f4_recency_frequency": SQL + f""", c AS (SELECT file, max(ts) AS last, count(DISTINCT commit_id) AS n FROM changes JOIN commits USING (commit_id) GROUP BY 1),
x AS (SELECT file, n, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last))) / 86400) AS BIGINT) AS days FROM c)
SELECT file, CASE WHEN days <= 7 THEN 1e0 WHEN days <= 30 THEN 7e-1 WHEN days <= 90 THEN 4e-1 ELSE 1e-1 END AS steps, round(exp(-days / 30), 6) AS decay,
  round(CASE WHEN n = 0 THEN 0e0 WHEN n <= 5 THEN 3e-1 WHEN n <= 20 THEN 6e-1 WHEN n <= 50 THEN 8e-1 ELSE least(1e0, 8e-1 + ln(n / 50) / 10) END, 6) AS frequency FROM x""",
    "sw1_windowed_activity": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS events, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
}
