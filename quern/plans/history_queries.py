"""Queries over the change log: orders as commits, lineitem as file changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import reports as R
from ..sources.fixtures import SQL, changes, commits, table

AS_OF = "2001-08-01"
FROM, TO = "2001-01-01", "2001-07-31"


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def g1_contributors(spark, d):
    return H.contributors(commits(spark, d))


def g2_author_stats(spark, d):
    return H.author_stats(commits(spark, d), changes(spark, d))


def g8_commit_types(spark, d):
    return commits(spark, d).groupBy(H.commit_type(F.col("message")).alias("kind")).agg(F.count("*").alias("commits"))


def g4_issue_refs(spark, d):
    ref = F.explode(F.regexp_extract_all("message", F.lit(r"#(\d+)"), F.lit(1)))
    return commits(spark, d).select("commit_id", ref.alias("issue"))


def g5_daily_activity(spark, d):
    return _r(H.daily_activity(commits(spark, d), changes(spark, d)).drop("good"), "productivity")


def g9_most_changed_files(spark, d):
    c = changes(spark, d).groupBy("file").agg(F.count("*").alias("changes"), F.sum(F.col("insertions") + F.col("deletions")).alias("lines"))
    return c.orderBy(F.col("changes").desc(), "file").limit(20)


def _daily(spark, d):
    return commits(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("commits"))


def g10_hot_periods(spark, d):
    return H.hot_periods(_daily(spark, d), 1.6)


def g11_quiet_periods(spark, d):
    return H.quiet_periods(_daily(spark, d))


def g12_events(spark, d):
    rows = H.commit_lines(commits(spark, d), changes(spark, d))
    size = F.col("added") + F.col("removed")
    first = rows.agg(F.min(F.struct("ts", "commit_id")).alias("f")).select(F.col("f.commit_id").alias("commit_id"), F.lit("initial").alias("event"))
    return rows.where(size > 300).select("commit_id", F.lit("large").alias("event")).unionByName(first)


def g16_hour_weekday(spark, d):
    return commits(spark, d).groupBy(F.hour("ts").cast("long").alias("hour"), F.weekday("ts").cast("long").alias("weekday")).agg(F.count("*").alias("commits"))


def g18_commit_sizes(spark, d):
    rows = H.commit_lines(commits(spark, d), changes(spark, d)).select("commit_id", (F.col("added") + F.col("removed")).alias("size"))
    return rows.agg(F.round(F.avg("size"), 6).alias("mean"), F.percentile("size", 0.5).alias("median"), F.round(F.stddev_samp("size"), 6).alias("std"), F.max(F.struct("size", -F.col("commit_id"))).getField("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))


def g19_gini(spark, d):
    return _r(H.gini(commits(spark, d).groupBy("author").agg(F.count("*").alias("c")), "c"), "gini")


def g20_contributor_activity(spark, d):
    per = commits(spark, d).groupBy("author").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    now = F.lit(AS_OF).cast("timestamp")
    return per.agg(F.count_if(F.datediff(now, "z") <= 30).alias("active"), F.count_if(F.datediff(now, "a") <= 90).alias("new"), F.count("*").alias("authors"))


def g21_bus_factor(spark, d):
    return H.bus_factor(commits(spark, d))


def g23_collaboration(spark, d):
    return R.shared_files_of(commits(spark, d), changes(spark, d), 2)


def g25_churn(spark, d):
    return _r(H.churn(commits(spark, d), changes(spark, d), AS_OF), "churn")


def g33_file_hotspots(spark, d):
    return _r(H.file_hotspots(commits(spark, d), changes(spark, d), AS_OF), "frequency", "score")


def g34_coupling(spark, d):
    return H.pairs(changes(spark, d), "commit_id", "file", 2)


def g38_coupling_clusters(spark, d):
    from ..operators.graph import components

    return components(H.pairs(changes(spark, d), "commit_id", "file", 4), "a", "b")


def g39_bursts(spark, d):
    return H.bursts(commits(spark, d), changes(spark, d), days=30)


def g43_file_ownership(spark, d):
    return _r(H.file_ownership(commits(spark, d), changes(spark, d)), "share")


def g45_team_activity(spark, d):
    team = table(spark, d, "customer").select(F.col("c_custkey").alias("author"), F.col("c_mktsegment").alias("team"))
    rows = commits(spark, d).join(team, "author")
    return rows.groupBy("team").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))


def g60_daily_velocity(spark, d):
    return H.daily_velocity(commits(spark, d), FROM, TO)


def g61_weekly_velocity(spark, d):
    return _r(H.weekly_velocity(g60_daily_velocity(spark, d)), "mean", "variance")


def g63_velocity_trend(spark, d):
    return _r(H.velocity_trend(g60_daily_velocity(spark, d)), "mean", "slope", "stability")


def g64_sprints(spark, d):
    return _r(H.sprints(g60_daily_velocity(spark, d)), "velocity")


def g69_prediction(spark, d):
    return _r(H.prediction(H.sprints(g60_daily_velocity(spark, d))), "predicted", "confidence")


def g70_burndown(spark, d):
    from pyspark.sql.window import Window

    daily = g60_daily_velocity(spark, d)
    total = daily.agg(F.sum("commits").alias("total"))
    return daily.select("day", F.sum("commits").over(Window.orderBy("day")).alias("done")).join(F.broadcast(total)).select("day", "done", (F.col("total") - F.col("done")).alias("left"))


def v1_dependency_graph(spark, d):
    """The 50 files of highest degree in the coupling graph."""
    e = H.pairs(changes(spark, d), "commit_id", "file", 2)
    ends = e.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "node").limit(50)


_KIND = """CASE WHEN starts_with(lower(message), 'merge ') THEN 'merge' WHEN starts_with(lower(message), 'revert ') THEN 'revert'
 WHEN regexp_extract(message, '^(\\w+)(?:\\(.+?\\))?:', 1) <> '' THEN regexp_extract(message, '^(\\w+)(?:\\(.+?\\))?:', 1)
 WHEN regexp_matches(lower(message), 'fix|bug|patch') THEN 'fix' WHEN regexp_matches(lower(message), 'test|spec') THEN 'test' WHEN regexp_matches(lower(message), 'feat|add|new') THEN 'feat'
 WHEN regexp_matches(lower(message), 'doc|readme') THEN 'docs' WHEN regexp_matches(lower(message), 'refactor|clean') THEN 'refactor' ELSE 'other' END"""
_S = SQL + f""", typed AS (SELECT *, {_KIND} AS kind FROM commits),
sized AS (SELECT c.*, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM typed c LEFT JOIN (SELECT commit_id, CAST(sum(insertions) AS BIGINT) AS added, CAST(sum(deletions) AS BIGINT) AS removed FROM changes GROUP BY 1) x USING (commit_id)),
daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS commits FROM commits GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 DAY)) AS DATE) AS day),
vel AS (SELECT spine.day, coalesce(c, 0) AS commits, coalesce(a, 0) AS authors FROM spine LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS c, count(DISTINCT author) AS a FROM commits GROUP BY 1) x USING (day)),
spr AS (SELECT sprint, min(day) AS start, max(day) AS "end", CAST(sum(commits) AS BIGINT) AS commits, avg(commits) AS velocity FROM (SELECT *, CAST((row_number() OVER (ORDER BY day) - 1) // 14 AS BIGINT) AS sprint FROM vel) GROUP BY 1),
authored AS (SELECT DISTINCT file, author, commit_id FROM commits JOIN changes USING (commit_id))
"""
_PAIRS = _S + ", own AS (SELECT DISTINCT commit_id, file FROM changes), pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS weight FROM own x JOIN own y USING (commit_id) WHERE x.file < y.file GROUP BY 1, 2)"

QUERIES = {f.__name__: f for f in (
    g1_contributors, g2_author_stats, g4_issue_refs, g5_daily_activity, g8_commit_types, g9_most_changed_files, g10_hot_periods, g11_quiet_periods, g12_events, g16_hour_weekday, g18_commit_sizes, g19_gini, g20_contributor_activity, g21_bus_factor,
    g23_collaboration, g25_churn, g33_file_hotspots, g34_coupling, g38_coupling_clusters, g39_bursts, g43_file_ownership, g45_team_activity, g60_daily_velocity, g61_weekly_velocity, g63_velocity_trend, g64_sprints, g69_prediction, g70_burndown,
    v1_dependency_graph,
)}

ORACLES = {
    "g1_contributors": _S + "SELECT author, count(*) AS commits FROM commits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "g2_author_stats": _S + "SELECT author, commits, active_days, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(files, 0) AS files FROM (SELECT author, count(*) AS commits, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM commits GROUP BY 1) LEFT JOIN (SELECT author, CAST(sum(insertions) AS BIGINT) AS added, CAST(sum(deletions) AS BIGINT) AS removed, count(DISTINCT file) AS files FROM commits JOIN changes USING (commit_id) GROUP BY 1) USING (author)",
    "g4_issue_refs": _S + "SELECT commit_id, unnest(regexp_extract_all(message, '#(\\d+)', 1)) AS issue FROM commits",
    "g5_daily_activity": _S + "SELECT CAST(ts AS DATE) AS day, count(*) AS commits, count(DISTINCT author) AS authors, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, min(ts) AS first_ts, max(ts) AS last_ts, round(least(100.0, least(30, count(*) * 3) + least(20, count(DISTINCT author) * 5) + CASE WHEN sum(added + removed) > 0 THEN least(30.0, ln(1 + sum(added + removed)) * 3) ELSE 0.0 END + (count(*) FILTER (kind IN ('feat', 'fix'))) / count(*) * 20), 6) AS productivity FROM sized GROUP BY 1",
    "g8_commit_types": _S + "SELECT kind, count(*) AS commits FROM typed GROUP BY 1",
    "g9_most_changed_files": _S + "SELECT file, count(*) AS changes, CAST(sum(insertions + deletions) AS BIGINT) AS lines FROM changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "g10_hot_periods": _S + ", n AS (SELECT *, row_number() OVER (ORDER BY day) AS n FROM daily), h AS (SELECT *, n - row_number() OVER (ORDER BY day) AS run FROM n WHERE commits >= (SELECT avg(commits) FROM daily) * 1.6) SELECT min(day) AS start, max(day) AS \"end\", count(*) AS days, CAST(sum(commits) AS BIGINT) AS commits FROM h GROUP BY run",
    "g11_quiet_periods": _S + ", n AS (SELECT day, lead(day) OVER (ORDER BY day) AS nx FROM daily) SELECT CAST(day + 1 AS DATE) AS start, CAST(nx - 1 AS DATE) AS \"end\", CAST(nx - day - 1 AS BIGINT) AS days FROM n WHERE nx - day - 1 >= 3",
    "g12_events": _S + "SELECT commit_id, 'large' AS event FROM sized WHERE added + removed > 300 UNION ALL SELECT * FROM (SELECT commit_id, 'initial' AS event FROM commits ORDER BY ts, commit_id LIMIT 1)",
    "g16_hour_weekday": _S + "SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS weekday, count(*) AS commits FROM commits GROUP BY 1, 2",
    "g18_commit_sizes": _S + "SELECT round(avg(added + removed), 6) AS mean, CAST(quantile_cont(added + removed, 0.5) AS DOUBLE) AS median, round(stddev_samp(added + removed), 6) AS std, max(added + removed) AS largest, min(added + removed) FILTER (added + removed > 0) AS smallest FROM sized",
    "g19_gini": _S + ", v AS (SELECT count(*) AS v FROM commits GROUP BY author), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v) SELECT round((max(n) + 1 - 2 * sum((n - i) * v) / sum(v)) / max(n), 6) AS gini FROM r",
    "g20_contributor_activity": _S + f"SELECT count(*) FILTER (date_diff('day', CAST(z AS DATE), DATE '{AS_OF}') <= 30) AS active, count(*) FILTER (date_diff('day', CAST(a AS DATE), DATE '{AS_OF}') <= 90) AS \"new\", count(*) AS authors FROM (SELECT author, min(ts) AS a, max(ts) AS z FROM commits GROUP BY 1)",
    "g21_bus_factor": _S + ", c AS (SELECT author, count(*) AS c FROM commits GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY c DESC, author) AS r, sum(c) OVER (ORDER BY c DESC, author) AS s, sum(c) OVER () AS n FROM c) SELECT CAST(min(r) AS BIGINT) AS bus_factor FROM r WHERE s >= n * 0.5",
    "g23_collaboration": _S + ", own AS (SELECT DISTINCT file, author FROM authored) SELECT x.author AS a, y.author AS b, count(*) AS weight FROM own x JOIN own y USING (file) WHERE x.author < y.author GROUP BY 1, 2 HAVING count(*) >= 2",
    "g25_churn": _S + f", p AS (SELECT file, count(*) AS changes, CAST(date_diff('day', CAST(min(ts) AS DATE), DATE '{AS_OF}') AS BIGINT) AS age FROM commits JOIN changes USING (commit_id) GROUP BY 1), q AS (SELECT *, changes / greatest(1, age) AS churn FROM p), s AS (SELECT list_sort(list(churn)) AS l FROM q) SELECT file, changes, age, round(churn, 6) AS churn, CASE WHEN churn >= l[CAST(floor(len(l) * 0.8) AS INT) + 1] THEN 'hot' WHEN churn <= l[CAST(floor(len(l) * 0.2) AS INT) + 1] THEN 'stable' ELSE 'normal' END AS kind FROM q, s",
    "g33_file_hotspots": _S + f", p AS (SELECT file, count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, CAST(sum(insertions) AS BIGINT) AS added, CAST(sum(deletions) AS BIGINT) AS removed, count(*) FILTER (kind = 'fix') AS fixes, min(ts) AS first_ts, max(ts) AS last_ts FROM typed JOIN changes USING (commit_id) GROUP BY 1), q AS (SELECT *, commits / greatest(1, date_diff('day', CAST(first_ts AS DATE), CAST(last_ts AS DATE))) * 30 AS frequency FROM p), r AS (SELECT *, least(100.0, least(25.0, frequency * 10) + least(20.0, fixes / commits * 40) + CASE WHEN authors > 5 THEN least(15, (authors - 5) * 3) ELSE 0 END) AS score, CAST(date_diff('day', CAST(last_ts AS DATE), DATE '{AS_OF}') AS BIGINT) AS recency_days FROM q) SELECT file, commits, authors, added, removed, fixes, first_ts, last_ts, round(frequency, 6) AS frequency, round(score, 6) AS score, recency_days, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 50 OR (commits >= 50 AND fixes >= 15) THEN 'high' WHEN frequency >= 0.3 THEN 'medium' ELSE 'low' END AS risk FROM r",
    "g34_coupling": _PAIRS + " SELECT * FROM pairs WHERE weight >= 2",
    "g38_coupling_clusters": "WITH RECURSIVE " + _PAIRS.strip().removeprefix("WITH") + ", e AS (SELECT a, b FROM pairs WHERE weight >= 4 UNION SELECT b, a FROM pairs WHERE weight >= 4), w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a) SELECT node, min(seen) AS comp FROM w GROUP BY 1",
    "g39_bursts": _S + ", x AS (SELECT DISTINCT file, commit_id, ts FROM commits JOIN changes USING (commit_id)), y AS (SELECT *, lead(ts, 3) OVER (PARTITION BY file ORDER BY ts, commit_id) AS later, count(*) OVER (PARTITION BY file) AS n FROM x) SELECT file, min(ts) AS start FROM y WHERE n >= 5 AND floor((epoch(later) - epoch(ts)) / 86400) <= 30 GROUP BY 1",
    "g43_file_ownership": _S + ", c AS (SELECT file, author, count(*) AS c FROM authored GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c DESC, author) AS r, sum(c) OVER (PARTITION BY file) AS t FROM c) SELECT file, author AS owner, c AS owner_commits, CAST(t AS BIGINT) AS commits, round(c / t, 6) AS share FROM r WHERE r = 1",
    "g45_team_activity": _S + "SELECT c_mktsegment AS team, count(*) AS commits, count(DISTINCT author) AS authors FROM commits JOIN customer ON author = c_custkey GROUP BY 1",
    "g60_daily_velocity": _S + "SELECT * FROM vel",
    "g61_weekly_velocity": _S + "SELECT CAST(year(day) AS BIGINT) AS year, CAST(weekofyear(day) AS BIGINT) AS week, CAST(sum(commits) AS BIGINT) AS commits, round(avg(commits), 6) AS mean, round(var_pop(commits), 6) AS variance FROM vel GROUP BY 1, 2",
    "g63_velocity_trend": _S + ", a AS (SELECT commits AS v, row_number() OVER (ORDER BY day) - 1 AS i FROM vel WHERE commits > 0), f AS (SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM a) SELECT n, round(mean, 6) AS mean, round(sum((i - n / 2) * (v - mean)) / sum((i - n / 2) * (i - n / 2)), 6) AS slope, round(greatest(0.0, 100 * (1 - std / mean)), 6) AS stability FROM a, f GROUP BY n, mean, std",
    "g64_sprints": _S + 'SELECT sprint, start, "end", commits, round(velocity, 6) AS velocity FROM spr',
    "g69_prediction": _S + ", f AS (SELECT regr_slope(velocity, sprint) AS a, regr_intercept(velocity, sprint) AS b, regr_r2(velocity, sprint) AS r2, max(sprint) AS last FROM spr) SELECT k, round(greatest(0.0, a * (last + k) + b), 6) AS predicted, round(coalesce(r2, 1.0) * pow(0.9, k - 1), 6) AS confidence FROM f, (SELECT unnest([CAST(1 AS BIGINT), 2, 3]) AS k)",
    "g70_burndown": _S + "SELECT day, CAST(sum(commits) OVER (ORDER BY day) AS BIGINT) AS done, CAST(sum(commits) OVER () - sum(commits) OVER (ORDER BY day) AS BIGINT) AS \"left\" FROM vel",
    "v1_dependency_graph": _PAIRS + ", e AS (SELECT a, b FROM pairs WHERE weight >= 2), d AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e) SELECT node, count(*) AS degree FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
}
