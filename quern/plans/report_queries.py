"""Report queries over the change log: orders as commits, lineitem as changes, part as the files' attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import reports as R
from ..sources.fixtures import changes, commits, files, table
from .history_queries import _PAIRS, _S, AS_OF, FROM, TO, _r, g60_daily_velocity


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("module"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("complexity"))


def _teams(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("author"), F.col("c_mktsegment").alias("team"))


def _both(spark, d):
    return commits(spark, d), changes(spark, d)


def _owned(spark, d):
    return R.ownership(*_both(spark, d), AS_OF)


def _hotspots(spark, d):
    return R.ranked_hotspots(H.file_hotspots(*_both(spark, d), AS_OF))


def _individual(spark, d):
    return R.individual_velocity(*_both(spark, d), FROM, TO)


def _shared(spark, d):
    c = commits(spark, d).where(F.to_date("ts").between(F.lit(FROM).cast("date"), F.lit(TO).cast("date")))
    return R.shared_files(c, changes(spark, d))


def _documents(spark, d):
    """Files with line counts; lines that begin with a mark of comments count as such, the number of lines as complexity."""
    lines = F.split("content", "\n")
    comments = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^(#|//)")))
    rows = files(spark, d).select("doc_id", "path", "language", F.size(lines).cast("long").alias("lines"), comments.cast("long").alias("comments"))
    return rows.withColumn("complexity", F.col("lines"))


def g7_contributor_stats(spark, d):
    return R.contributor_stats(*_both(spark, d))


def g13_trends(spark, d):
    return _r(R.trends(commits(spark, d), AS_OF), "recent", "older", "fixes", "features")


def g14_activity_level(spark, d):
    return R.activity_level(commits(spark, d))


def g16_months(spark, d):
    return R.distribution(commits(spark, d), F.month("ts"), 1, 12)


def g16_hours(spark, d):
    return R.distribution(commits(spark, d), F.hour("ts"), 0, 24)


def g17_commit_ratios(spark, d):
    return _r(R.commit_ratios(commits(spark, d)), "merge_ratio", "fix_ratio")


def g20_retention(spark, d):
    return _r(R.retention(commits(spark, d), AS_OF), "retention", "churn")


def g22_file_bus_factor(spark, d):
    return _owned(spark, d).select("file", "contributors", "bus_factor", "risk")


def g24_collaboration_score(spark, d):
    return _r(R.collaboration_score(*_both(spark, d)), "score")


def g27_growth(spark, d):
    return _r(R.growth(commits(spark, d)), "rate")


def g36_ranked_hotspots(spark, d):
    return _r(_hotspots(spark, d).select("file", "commits", "score", "risk"), "score")


def g37_module_hotspots(spark, d):
    return _r(R.module_hotspots(_hotspots(spark, d), _parts(spark, d)), "complexity")


def g39_activity_trends(spark, d):
    return R.activity_trends(*_both(spark, d))


def g41_contributor_profile(spark, d):
    return _r(R.contributor_profile(*_both(spark, d), AS_OF), "frequency", "productivity")


def g42_filters(spark, d):
    who = table(spark, d, "customer").select("c_name").unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("c_name")))
    bots = who.groupBy(F.lit("bot").alias("filter"), R.is_bot(F.lit(None), F.col("c_name")).alias("caught")).agg(F.count("*").alias("n"))
    return bots.unionByName(files(spark, d).groupBy(F.lit("test").alias("filter"), R.is_test_file(F.concat("path", F.lit("/"), F.coalesce("content", F.lit("")))).alias("caught")).agg(F.count("*").alias("n")))


def g43_ownership_details(spark, d):
    cols = ("file", "owner", "percent", "gini", "created_by", "modified_by", "change_rate", "orphaned")
    return _r(_owned(spark, d).select(*cols), "percent", "gini", "change_rate")


def g44_ownership_lists(spark, d):
    return R.ownership_lists(_owned(spark, d))


def g45_team_territories(spark, d):
    return R.team_territories(_owned(spark, d), _teams(spark, d))


def g45_team_pairs(spark, d):
    return R.team_pairs(*_both(spark, d), _teams(spark, d))


def g45_team_bus_factor(spark, d):
    return R.team_bus_factor(commits(spark, d), _teams(spark, d), AS_OF)


def g46_expertise_areas(spark, d):
    return R.expertise_areas(*_both(spark, d), _parts(spark, d))


def g47_ownership_risk(spark, d):
    return _r(R.ownership_risk(_owned(spark, d), commits(spark, d), AS_OF), "orphans", "silos", "active_share", "risk")


def g48_complexity_summary(spark, d):
    return _r(R.complexity_summary(_parts(spark, d)), "mean", "median", "std")


def g50_top_complex_files(spark, d):
    return R.top(_parts(spark, d).select("file", "module", "complexity"), "complexity", "file", 10)


def g51_codebase_metrics(spark, d):
    f = _documents(spark, d)
    return _r(f.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("comments").alias("comments"), F.avg("lines").alias("mean"), F.stddev_pop("lines").alias("std"), F.min("lines").alias("smallest"), F.max("lines").alias("largest")), "mean", "std")


def g53_largest_files(spark, d):
    return R.top(_documents(spark, d).select("doc_id", "path", "lines", "language"), "lines", "doc_id", 10)


def g54_derived_metrics(spark, d):
    return _r(R.derived_metrics(_documents(spark, d)), "documentation", "coverage", "duplication", "debt", "maintainability", "quality")


def g58_language_shares(spark, d):
    per = files(spark, d).groupBy("language").agg(F.count("*").alias("files"))
    total = per.agg(F.sum("files").alias("total"))
    return _r(per.join(F.broadcast(total)).select("language", "files", (F.col("files") / F.col("total") * 100).alias("percent")), "percent")


def g59_commit_filter(spark, d):
    """Commits up to the end date whose message is no merge, by day."""
    c = commits(spark, d).where((F.to_date("ts") <= F.lit(TO).cast("date")) & (H.commit_type(F.col("message")) != "merge"))
    return c.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("commits"))


def g62_individual_velocity(spark, d):
    return _r(_individual(spark, d), "productivity", "consistency", "impact")


def g65_team_metrics(spark, d):
    return _r(R.team_metrics(_individual(spark, d), _shared(spark, d)), "collaboration", "efficiency")


def g65_team_velocity(spark, d):
    return _r(R.team_velocity(_individual(spark, d), _teams(spark, d)), "productivity")


def g66_top_performers(spark, d):
    return R.top(_r(_individual(spark, d).select("author", "productivity", "commits"), "productivity"), "productivity", "author", 5)


def g67_momentum_score(spark, d):
    out = R.momentum_score(g60_daily_velocity(spark, d), _individual(spark, d), _shared(spark, d))
    return _r(out, "velocity", "productivity", "collaboration", "momentum", "sustainability")


def g68_sprint_velocity(spark, d):
    return _r(R.sprint_velocity(*_both(spark, d), "1995-01-01"), "velocity")


def g71_completion(spark, d):
    return _r(R.completion(H.velocity_trend(g60_daily_velocity(spark, d)), 1000), "velocity")


def _yearly(spark, d):
    """(metric, at, value): stand-ins of the four metrics, by year."""
    rows = H.commit_lines(*_both(spark, d)).withColumn("kind", H.commit_type(F.col("message")))
    share = lambda k: F.avg((F.col("kind") == k).cast("double")) * 100
    per = rows.groupBy(F.year("ts").cast("long").alias("at")).agg(F.countDistinct("author").cast("double").alias("health_score"), F.avg(F.col("added") + F.col("removed")).alias("complexity"), share("merge").alias("duplication"), share("feat").alias("coverage"))
    return per.unpivot(["at"], ["health_score", "complexity", "duplication", "coverage"], "metric", "value").withColumn("value", F.round("value", 6))


def g73_metric_changes(spark, d):
    y = _yearly(spark, d)
    return _r(R.metric_changes(y.where("at = 1999"), y.where("at = 2000")), "change", "percent")


def g74_metric_trends(spark, d):
    return _r(R.metric_trends(_yearly(spark, d)), "forecast")


def x1_complexity_distribution(spark, d):
    name = R.bucket(F.col("complexity"), [5, 10, 20], ["Low (1-5)", "Medium (6-10)", "High (11-20)", "Very High (>20)"])
    return _parts(spark, d).groupBy(name.alias("bucket")).agg(F.count("*").alias("files"))


def x2_top_complex(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("complexity"))
    label = F.when(F.length("p_name") > 30, F.concat(F.substring("p_name", 1, 27), F.lit("..."))).otherwise(F.col("p_name"))
    return R.top(p, "complexity", "p_partkey", 10).select("p_partkey", label.alias("label"), "complexity", R.severity(F.col("complexity")).alias("severity"))


def x3_complexity_heatmap(spark, d):
    return R.function_matrix(_parts(spark, d))


def x5_contribution_bars(spark, d):
    p = R.profiles(*_both(spark, d)).withColumn("lines", F.col("added") + F.col("removed"))
    per = p.unpivot(["author"], ["commits", "lines", "files"], "metric", "value")
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("value").desc(), "author"))
    return per.withColumn("place", place.cast("long")).where("place <= 10")


def x5_activity_timeline(spark, d):
    return commits(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("commits"), F.countDistinct("author").alias("contributors"))


def x6_collaboration_network(spark, d):
    return R.network_nodes(R.shared_files_of(*_both(spark, d)))


def x8_bus_factor_gauge(spark, d):
    bus, n = H.bus_factor(commits(spark, d)), commits(spark, d).agg(F.countDistinct("author").alias("n"))
    b = F.col("bus_factor")
    return _r(bus.crossJoin(n).select("bus_factor", (b / F.greatest(F.lit(1), F.col("n")) * 100).alias("percent"), F.when(b <= 1, "critical").when(b <= 2, "high").when(b <= 3, "medium").otherwise("excellent").alias("level")), "percent")


def x9_instability(spark, d):
    """Modules as ends of the coupling graph, directed from the smaller file to the larger one."""
    module = _parts(spark, d).select("file", "module")
    e = H.pairs(changes(spark, d), "commit_id", "file", 3)
    e = e.join(module.select(F.col("file").alias("a"), F.col("module").alias("ma")), "a").join(module.select(F.col("file").alias("b"), F.col("module").alias("mb")), "b")
    return _r(R.instability(e.select(F.col("ma").alias("a"), F.col("mb").alias("b"))), "instability")


def x11_hotspot_heatmap(spark, d):
    return R.heatmap(H.file_hotspots(*_both(spark, d), AS_OF).select(F.round("frequency", 6).alias("frequency"), "commits"), "frequency", "commits")


def x11_risk_matrix(spark, d):
    return H.file_hotspots(*_both(spark, d), AS_OF).groupBy("risk").agg(F.count("*").alias("files"), F.round(F.avg("score"), 6).alias("score"))


def x11_file_activity(spark, d):
    per = changes(spark, d).groupBy("file").agg(F.sum("insertions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("changes"))
    return R.top(per, "changes", "file", 20)


def v5_coupling_network(spark, d):
    return R.top(R.network_nodes(H.pairs(changes(spark, d), "commit_id", "file"), 2), "degree", "node", 50)


_QUERIES = [f for k, f in sorted(globals().items()) if k[0] in "gvx" and k[1].isdigit() and f.__module__ == __name__]
QUERIES = {f.__name__: f for f in _QUERIES}

# --- oracles -------------------------------------------------------------------------------------

_DAYS = f"date_diff('day', CAST({{}} AS DATE), DATE '{AS_OF}')"
_PROFILE = _S + """, prof AS (SELECT x.*, coalesce(files, 0) AS files FROM (SELECT author, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, count(DISTINCT CAST(ts AS DATE)) AS active_days, min(ts) AS first_ts, max(ts) AS last_ts FROM sized GROUP BY 1) x
 LEFT JOIN (SELECT author, count(DISTINCT file) AS files FROM authored GROUP BY 1) y USING (author))"""
_OWNED = _S + f""", oa AS (SELECT file, author, count(*) AS c, min(ts) AS a, max(ts) AS z FROM authored JOIN commits USING (commit_id, author) GROUP BY 1, 2),
 ob AS (SELECT *, CAST(sum(c) OVER w AS BIGINT) AS total, row_number() OVER (PARTITION BY file ORDER BY c, author) - 1 AS i, count(*) OVER w AS n, row_number() OVER (PARTITION BY file ORDER BY c DESC, author) AS r, row_number() OVER (PARTITION BY file ORDER BY a, author) AS ra, row_number() OVER (PARTITION BY file ORDER BY z DESC, author) AS rz FROM oa WINDOW w AS (PARTITION BY file)),
 lastc AS (SELECT author, max(ts) AS last_ts FROM commits GROUP BY 1),
 oc AS (SELECT file, total AS commits, n AS contributors, max(author) FILTER (r = 1) AS owner, max(c) / total * 100 AS percent, (n + 1 - 2 * sum((n - i) * c) / total) / n AS gini, max(author) FILTER (ra = 1) AS created_by, max(author) FILTER (rz = 1) AS modified_by, total / (date_diff('day', CAST(min(a) AS DATE), CAST(max(z) AS DATE)) + 1) AS change_rate, greatest(1, count(*) FILTER (c / total > 0.2)) AS bus_factor FROM ob GROUP BY file, total, n),
 owned AS (SELECT oc.*, {_DAYS.format('last_ts')} > 30 AS orphaned, CASE WHEN {_DAYS.format('last_ts')} > 30 THEN 'critical' WHEN bus_factor = 1 THEN 'high' WHEN bus_factor = 2 THEN 'medium' ELSE 'low' END AS risk FROM oc JOIN lastc ON owner = author)"""
_HOT = _S + """, p AS (SELECT file, count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, count(*) FILTER (kind = 'fix') AS fixes, min(ts) AS first_ts, max(ts) AS last_ts FROM typed JOIN changes USING (commit_id) GROUP BY 1), q AS (SELECT *, commits / greatest(1, date_diff('day', CAST(first_ts AS DATE), CAST(last_ts AS DATE))) * 30 AS frequency FROM p),
 hot AS (SELECT *, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 50 OR (commits >= 50 AND fixes >= 15) THEN 'high' WHEN frequency >= 0.3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT *, least(100.0, least(25.0, frequency * 10) + least(20.0, fixes / commits * 40) + CASE WHEN authors > 5 THEN least(15, (authors - 5) * 3) ELSE 0 END) AS score FROM q))"""
_IN = f"CAST(ts AS DATE) BETWEEN DATE '{FROM}' AND DATE '{TO}'"
_PERIOD = f"date_diff('day', DATE '{FROM}', DATE '{TO}')"
_IND = _S + f""", ia AS (SELECT author, count(*) AS commits, sum(added) - sum(removed) AS net, count(DISTINCT CAST(ts AS DATE)) AS active_days, min(ts) AS first_ts, max(ts) AS last_ts FROM sized WHERE {_IN} GROUP BY 1),
 ib AS (SELECT author, count(DISTINCT file) AS files FROM authored JOIN commits USING (commit_id, author) WHERE {_IN} GROUP BY 1),
 ind AS (SELECT author, commits, least(100.0, least(30.0, commits / {_PERIOD} * 30) + CASE WHEN net > 0 THEN least(30.0, ln(1 + net) * 2) ELSE 0.0 END + active_days / {_PERIOD} * 20 + least(20.0, coalesce(files, 0) / 5)) AS productivity,
  least(100.0, active_days / (date_diff('day', CAST(first_ts AS DATE), CAST(last_ts AS DATE)) + 1) * 100) AS consistency, least(100.0, least(40.0, commits) + least(30.0, coalesce(files, 0) / 2) + CASE WHEN net > 0 THEN least(30.0, ln(1 + net)) ELSE 0.0 END) AS impact,
  CASE WHEN date_diff('day', CAST(last_ts AS DATE), DATE '{TO}') > 30 THEN 'inactive' WHEN date_diff('day', CAST(last_ts AS DATE), DATE '{TO}') > 14 THEN 'decreasing' WHEN commits / {_PERIOD} > 1 THEN 'increasing' ELSE 'stable' END AS trend FROM ia LEFT JOIN ib USING (author)),
 sh AS (SELECT avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) * 100 AS shared FROM (SELECT file, count(DISTINCT author) AS n FROM authored JOIN commits USING (commit_id, author) WHERE {_IN} GROUP BY 1))"""
_TEAM = ", teams AS (SELECT c_custkey AS author, c_mktsegment AS team FROM customer)"
_DOCS = _S + ", dl AS (SELECT doc_id, path, language, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines, CAST(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(x, ' '), '^(#|//)'))) AS BIGINT) AS comments FROM files)"
_PARTS = ", parts AS (SELECT p_partkey AS file, p_brand AS module, p_type AS kind, CAST(p_size AS BIGINT) AS complexity FROM part)"
_YEAR = _S + """, yr AS (SELECT CAST(year(ts) AS BIGINT) AS "at", CAST(count(DISTINCT author) AS DOUBLE) AS health_score, avg(added + removed) AS complexity, avg(CASE WHEN kind = 'merge' THEN 1.0 ELSE 0.0 END) * 100 AS duplication, avg(CASE WHEN kind = 'feat' THEN 1.0 ELSE 0.0 END) * 100 AS coverage FROM sized GROUP BY 1),
 yearly AS (SELECT 'health_score' AS metric, "at", round(health_score, 6) AS value FROM yr UNION ALL SELECT 'complexity', "at", round(complexity, 6) FROM yr UNION ALL SELECT 'duplication', "at", round(duplication, 6) FROM yr UNION ALL SELECT 'coverage', "at", round(coverage, 6) FROM yr)"""
_PLACES = "SELECT place, coalesce(c, 0) AS commits, row_number() OVER (ORDER BY coalesce(c, 0) DESC, place) = 1 AS peak FROM (SELECT unnest(range({a}, {b})) AS place) LEFT JOIN (SELECT {f}(ts) AS place, count(*) AS c FROM commits GROUP BY 1) USING (place)"

ORACLES = {
    "g7_contributor_stats": _PROFILE + ", ty AS (SELECT author, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS types FROM (SELECT author, kind, count(*) AS n FROM typed GROUP BY 1, 2) GROUP BY 1) SELECT author, commits, added, removed, active_days, first_ts, last_ts, added - removed AS net, types FROM prof JOIN ty USING (author)",
    "g13_trends": _S + f", r AS (SELECT commits AS c, row_number() OVER (ORDER BY day DESC) AS r FROM daily), a AS (SELECT avg(c) FILTER (r <= 7) AS recent, avg(c) FILTER (r > 7) AS older FROM r), b AS (SELECT count(*) AS people, count(*) FILTER ({_DAYS.format('z')} < 7) AS active FROM (SELECT author, max(ts) AS z FROM commits GROUP BY 1)), c AS (SELECT avg(CASE WHEN kind = 'fix' THEN 1.0 ELSE 0.0 END) AS fixes, avg(CASE WHEN kind = 'feat' THEN 1.0 ELSE 0.0 END) AS features FROM typed) SELECT round(recent, 6) AS recent, round(older, 6) AS older, CASE WHEN recent > older * 1.5 THEN 'increasing' WHEN recent < older * 0.5 THEN 'decreasing' ELSE 'steady' END AS activity, CASE WHEN active < people * 0.5 THEN 'many inactive' WHEN active = people THEN 'all active' ELSE 'mixed' END AS contributors, round(fixes, 6) AS fixes, round(features, 6) AS features FROM a, b, c",
    "g14_activity_level": _S + "SELECT CASE WHEN m > 10 THEN 'high' WHEN m > 3 THEN 'moderate' ELSE 'low' END AS level, busiest, top_author, top_type FROM (SELECT avg(commits) AS m FROM daily), (SELECT day AS busiest FROM daily ORDER BY commits DESC, day LIMIT 1), (SELECT author AS top_author FROM commits GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT kind AS top_type FROM typed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "g16_months": _S + _PLACES.format(a=1, b=13, f="month"),
    "g16_hours": _S + _PLACES.format(a=0, b=24, f="hour"),
    "g17_commit_ratios": _S + ", x AS (SELECT count(*) AS commits, count(*) FILTER (starts_with(lower(message), 'merge ')) AS merges, count(*) FILTER (contains(lower(message), 'revert')) AS reverts, count(*) FILTER (regexp_matches(lower(message), 'fix|bug|patch|repair')) AS fixes, count(*) FILTER (regexp_matches(lower(message), 'feat|feature|add|new')) AS features FROM commits) SELECT *, round(merges / commits, 6) AS merge_ratio, round(fixes / commits, 6) AS fix_ratio FROM x",
    "g20_retention": _S + f", x AS (SELECT author, CASE WHEN {_DAYS.format('max(ts)')} <= 30 THEN 1.0 ELSE 0.0 END AS active FROM commits GROUP BY 1) SELECT count(*) AS contributors, round(avg(active) * 100, 6) AS retention, round((1 - avg(active)) * 100, 6) AS churn FROM x",
    "g22_file_bus_factor": _OWNED + " SELECT file, contributors, bus_factor, risk FROM owned",
    "g24_collaboration_score": _S + ", own AS (SELECT DISTINCT file, author FROM authored), e AS (SELECT count(*) AS edges FROM (SELECT DISTINCT x.author, y.author FROM own x JOIN own y USING (file) WHERE x.author < y.author)), n AS (SELECT count(DISTINCT author) AS n FROM commits) SELECT n, edges, round(least(100.0, edges / (n * (n - 1) / 2) * 100), 6) AS score FROM n, e",
    "g27_growth": _S + ", r AS (SELECT CAST(ts AS DATE) AS day, row_number() OVER (ORDER BY ts DESC) AS r, count(*) OVER () AS n FROM commits), h AS (SELECT *, r <= n // 2 AS newer FROM r), f AS (SELECT max(n) AS n, greatest(1, date_diff('day', min(day), max(day))) AS d, greatest(1, date_diff('day', min(day) FILTER (newer), max(day) FILTER (newer))) AS d1, greatest(1, date_diff('day', min(day) FILTER (NOT newer), max(day) FILTER (NOT newer))) AS d2 FROM h) SELECT n AS commits, round(n / d, 6) AS rate, CASE WHEN n < 10 THEN 'insufficient_data' WHEN (n - n // 2) / d2 > (n // 2) / d1 * 1.2 THEN 'increasing' WHEN (n - n // 2) / d2 < (n // 2) / d1 * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM f",
    "g36_ranked_hotspots": _HOT + " SELECT file, commits, round(score, 6) AS score, risk FROM hot WHERE commits >= 2 AND score >= 10",
    "g37_module_hotspots": _HOT + _PARTS + " SELECT module, count(*) AS files, CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(fixes) AS BIGINT) AS fixes, round(coalesce(avg(complexity) FILTER (complexity > 0), 0.0), 6) AS complexity FROM hot JOIN parts USING (file) WHERE commits >= 2 AND score >= 10 GROUP BY 1",
    "g39_activity_trends": _S + ", r AS (SELECT file, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY file ORDER BY ts, commit_id) AS r, count(*) OVER (PARTITION BY file) AS n FROM (SELECT DISTINCT file, commit_id, ts FROM commits JOIN changes USING (commit_id))), f AS (SELECT file, n, greatest(1, date_diff('day', min(day) FILTER (r <= n // 2), max(day) FILTER (r <= n // 2))) AS d1, greatest(1, date_diff('day', min(day) FILTER (r > n // 2), max(day) FILTER (r > n // 2))) AS d2 FROM r WHERE n >= 10 GROUP BY 1, 2) SELECT file, n AS commits, CASE WHEN (n - n // 2) / d2 > (n // 2) / d1 * 1.5 THEN 'increasing' WHEN (n - n // 2) / d2 < (n // 2) / d1 * 0.5 THEN 'declining' ELSE 'steady' END AS trend FROM f",
    "g41_contributor_profile": _PROFILE + f" SELECT author, round(commits / active_days, 6) AS frequency, round(least(100.0, least(35.0, commits / active_days * 12) + CASE WHEN added > removed THEN least(30.0, (added - removed) / 400) ELSE 0.0 END + least(20.0, files / 10) + active_days / (date_diff('day', CAST(first_ts AS DATE), CAST(last_ts AS DATE)) + 1) * 15), 6) AS productivity, CASE WHEN commits > 500 AND files > 100 THEN 'expert' WHEN commits > 100 AND files > 50 THEN 'senior' WHEN commits > 20 THEN 'intermediate' ELSE 'junior' END AS expertise, {_DAYS.format('last_ts')} <= 30 AS active FROM prof",
    "g42_filters": _S + r", who AS (SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier) SELECT 'bot' AS filter, regexp_matches(lower(' ' || coalesce(n, '')), 'bot\b|\[bot\]|dependabot|renovate|github-actions|automation|ci-|jenkins') AS caught, count(*) AS n FROM who GROUP BY 2 UNION ALL SELECT 'test', regexp_matches(lower(path || '/' || coalesce(content, '')), 'test_|_test\.|/tests?/|/spec/|\.spec\.|\.test\.'), count(*) FROM files GROUP BY 2",
    "g43_ownership_details": _OWNED + " SELECT file, owner, round(percent, 6) AS percent, round(gini, 6) AS gini, created_by, modified_by, round(change_rate, 6) AS change_rate, orphaned FROM owned",
    "g44_ownership_lists": _OWNED + " SELECT 'orphan' AS list, file FROM owned WHERE orphaned UNION ALL SELECT 'high_risk', file FROM owned WHERE NOT orphaned AND bus_factor = 1 UNION ALL SELECT 'silo', file FROM owned WHERE contributors = 1",
    "g45_team_territories": _OWNED + _TEAM + " SELECT team, count(*) AS files FROM owned JOIN teams ON owner = author GROUP BY 1",
    "g45_team_pairs": _S + _TEAM + ", t AS (SELECT DISTINCT file, team FROM authored JOIN teams USING (author)) SELECT x.team AS a, y.team AS b, count(*) AS weight FROM t x JOIN t y USING (file) WHERE x.team < y.team GROUP BY 1, 2",
    "g45_team_bus_factor": _S + _TEAM + f" SELECT team, count(*) FILTER ({_DAYS.format('last_ts')} <= 30) AS active FROM teams LEFT JOIN (SELECT author, max(ts) AS last_ts FROM commits GROUP BY 1) USING (author) GROUP BY 1",
    "g46_expertise_areas": _S + _PARTS + ", t AS (SELECT DISTINCT author, file FROM authored), m AS (SELECT author, module AS area, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, module) AS place FROM t JOIN parts USING (file) GROUP BY 1, 2), k AS (SELECT author, kind AS area, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, kind) AS place FROM t JOIN parts USING (file) GROUP BY 1, 2) SELECT author, area, place FROM m WHERE place <= 5 UNION ALL SELECT author, area, place + 5 FROM k WHERE place <= 3",
    "g47_ownership_risk": _OWNED + f", f AS (SELECT count(*) AS files, avg(CASE WHEN orphaned THEN 1.0 ELSE 0.0 END) AS orphans, avg(CASE WHEN contributors = 1 THEN 1.0 ELSE 0.0 END) AS silos FROM owned), b AS (SELECT count(*) FILTER (k / files > 0.1) AS bus_factor FROM (SELECT owner, count(*) AS k FROM owned WHERE NOT orphaned GROUP BY 1), f), s AS (SELECT avg(CASE WHEN {_DAYS.format('last_ts')} <= 30 THEN 1.0 ELSE 0.0 END) AS active_share FROM lastc) SELECT files, bus_factor, round(orphans, 6) AS orphans, round(silos, 6) AS silos, round(active_share, 6) AS active_share, round(least(100.0, CASE WHEN bus_factor <= 1 THEN 30 WHEN bus_factor <= 2 THEN 20 WHEN bus_factor <= 3 THEN 10 ELSE 0 END + orphans * 30 + silos * 20 + CASE WHEN active_share < 0.5 THEN 20 ELSE 0 END), 6) AS risk FROM f, b, s",
    "g48_complexity_summary": _S + _PARTS + " SELECT count(*) AS n, round(avg(complexity), 6) AS mean, round(quantile_cont(complexity, 0.5), 6) AS median, round(stddev_pop(complexity), 6) AS std, max(complexity) AS largest, count(*) FILTER (complexity > 10) AS above, count(*) FILTER (complexity > 20) AS far_above FROM parts",
    "g50_top_complex_files": _S + _PARTS + " SELECT file, module, complexity FROM parts ORDER BY complexity DESC, file LIMIT 10",
    "g51_codebase_metrics": _DOCS + " SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(comments) AS BIGINT) AS comments, round(avg(lines), 6) AS mean, round(stddev_pop(lines), 6) AS std, min(lines) AS smallest, max(lines) AS largest FROM dl",
    "g53_largest_files": _DOCS + " SELECT doc_id, path, lines, language FROM dl ORDER BY lines DESC, doc_id LIMIT 10",
    "g54_derived_metrics": _DOCS + ", f AS (SELECT coalesce(sum(comments) / nullif(sum(lines) - sum(comments), 0), 0.0) AS documentation, least(0.95, avg(CASE WHEN regexp_matches(lower(path), 'test|spec') THEN 1.0 ELSE 0.0 END) * 3.5) AS coverage, CASE WHEN var_pop(lines) > 0 THEN least(0.5, 1000 / (var_pop(lines) + 1000)) ELSE 0.0 END AS duplication, avg(lines) AS c FROM dl) SELECT round(documentation, 6) AS documentation, round(coverage, 6) AS coverage, round(duplication, 6) AS duplication, round(least(100.0, CASE WHEN c > 10 THEN least(30.0, (c - 10) * 3) ELSE 0.0 END + CASE WHEN c > 300 THEN least(20.0, (c - 300) / 20) ELSE 0.0 END + CASE WHEN documentation < 0.15 THEN 20 * (0.15 - documentation) / 0.15 ELSE 0.0 END + CASE WHEN coverage < 0.5 THEN 20 * (0.5 - coverage) / 0.5 ELSE 0.0 END), 6) AS debt, round(greatest(0.0, least(100.0, (171 - 5.2 * least(10.0, c) - CASE WHEN c > 0 THEN 0.23 * ln(c + 1) ELSE 0.0 END) * 100 / 171)), 6) AS maintainability, round(greatest(0.0, least(100.0, 100 - CASE WHEN c > 10 THEN least(20.0, (c - 10) * 2) ELSE 0.0 END - CASE WHEN documentation < 0.1 THEN 15 ELSE 0 END - CASE WHEN c > 500 THEN 10 ELSE 0 END - CASE WHEN duplication > 0.1 THEN least(15.0, duplication * 150) ELSE 0.0 END + CASE WHEN coverage > 0.8 THEN 10 ELSE 0 END)), 6) AS quality FROM f",
    "g58_language_shares": _S + " SELECT language, count(*) AS files, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM files GROUP BY 1",
    "g59_commit_filter": _S + f" SELECT CAST(ts AS DATE) AS day, count(*) AS commits FROM typed WHERE CAST(ts AS DATE) <= DATE '{TO}' AND kind <> 'merge' GROUP BY 1",
    "g62_individual_velocity": _IND + " SELECT author, commits, round(productivity, 6) AS productivity, round(consistency, 6) AS consistency, round(impact, 6) AS impact, trend FROM ind",
    "g65_team_metrics": _IND + ", f AS (SELECT count(*) AS members, count(*) FILTER (trend <> 'inactive') AS active, CAST(sum(commits) AS BIGINT) AS velocity, avg(productivity) AS p, count(*) FILTER (trend <> 'inactive') / count(*) * 100 AS e FROM ind), l AS (SELECT count(*) FILTER (commits / velocity >= 0.1) AS large FROM ind, f) SELECT members, active, velocity, round(shared, 6) AS collaboration, round(e, 6) AS efficiency, CASE WHEN p > 70 AND e > 70 THEN 'excellent' WHEN p > 50 AND e > 50 THEN 'good' WHEN p > 30 AND e > 30 THEN 'fair' ELSE 'needs improvement' END AS health, CAST(CASE WHEN active <= 1 THEN 1 ELSE greatest(1, large) END AS BIGINT) AS bus_factor FROM f, l, sh",
    "g65_team_velocity": _IND + _TEAM + " SELECT team, count(*) AS members, CAST(sum(commits) AS BIGINT) AS commits, round(avg(productivity), 6) AS productivity FROM ind JOIN teams USING (author) GROUP BY 1",
    "g66_top_performers": _IND + " SELECT author, round(productivity, 6) AS productivity, commits FROM ind ORDER BY 2 DESC, 1 LIMIT 5",
    "g67_momentum_score": _IND + ", d AS (SELECT commits AS v, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM vel), f AS (SELECT max(n) AS n, avg(v) FILTER (v > 0) AS m, stddev_pop(v) FILTER (v > 0) AS s, sum(v) FILTER (r > n // 2) / (max(n) - max(n) // 2) AS recent, sum(v) FILTER (r <= n // 2) / (max(n) // 2) AS older FROM d), p AS (SELECT avg(productivity) AS productivity, count(*) AS people FROM ind), g AS (SELECT *, least(100.0, (m * 2 + greatest(0.0, 100 * (1 - s / m))) / 3) AS velocity, 70.0 + CASE WHEN productivity > 80 THEN 10.0 WHEN productivity < 40 THEN -10.0 ELSE 0.0 END AS q FROM f, p, sh) SELECT round(velocity, 6) AS velocity, round(productivity, 6) AS productivity, CAST(q AS DOUBLE) AS quality, round(shared, 6) AS collaboration, round(0.3 * velocity + 0.3 * productivity + 0.2 * q + 0.2 * shared, 6) AS momentum, CASE WHEN recent > older * 1.1 THEN 'increasing' WHEN recent < older * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend, round((velocity / 100 * 0.6 + least(1.0, people / 5) * 0.4) * 100, 6) AS sustainability FROM g",
    "g68_sprint_velocity": _S + " SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) // 14 AS BIGINT) AS sprint, count(*) AS commits, round(count(*) + CASE WHEN sum(added + removed) > 0 THEN ln(1 + sum(added + removed)) * 0.5 ELSE 0.0 END, 6) AS velocity FROM sized WHERE CAST(ts AS DATE) >= DATE '1995-01-01' GROUP BY 1",
    "g71_completion": _S + ", f AS (SELECT avg(commits) AS m, greatest(0.0, 100 * (1 - stddev_pop(commits) / avg(commits))) AS s FROM vel WHERE commits > 0) SELECT CAST(floor(1000 / m * 1.2) AS BIGINT) AS days, CAST(floor(1000 / m * 1.2 - 1000 / m) AS BIGINT) AS buffer, round(CASE WHEN s > 0 THEN least(0.8, s / 100) ELSE 0.56 END * 100, 1) AS confidence, round(m, 6) AS velocity FROM f",
    "g73_metric_changes": _YEAR + ", x AS (SELECT a.metric, a.value AS baseline, b.value AS current, b.value - a.value AS change FROM yearly a JOIN yearly b USING (metric) WHERE a.\"at\" = 1999 AND b.\"at\" = 2000) SELECT metric, baseline, current, round(change, 6) AS change, round(CASE WHEN baseline <> 0 THEN change / baseline * 100 ELSE 0.0 END, 6) AS percent, CASE WHEN change = 0 THEN 'none' WHEN (change > 0) = (metric IN ('health_score', 'coverage')) THEN 'improved' ELSE 'regressed' END AS verdict FROM x",
    "g74_metric_trends": _YEAR + ", x AS (SELECT *, value - lag(value) OVER (PARTITION BY metric ORDER BY \"at\") AS d, row_number() OVER (PARTITION BY metric ORDER BY \"at\" DESC) AS r FROM yearly), y AS (SELECT metric, count(*) AS n, max(value) FILTER (r = 1) AS v, max(d) FILTER (r = 1) AS d, min(d) AS low, max(d) AS high, avg(abs(d)) AS move FROM x GROUP BY 1 HAVING count(*) >= 3) SELECT metric, n, round(v + d, 6) AS forecast, CASE WHEN low >= 0 THEN CASE WHEN metric IN ('health_score', 'coverage') THEN 'improvement' ELSE 'none' END WHEN high <= 0 THEN CASE WHEN metric IN ('health_score', 'coverage') THEN 'degradation' ELSE 'none' END WHEN n >= 4 AND move > abs(v * 0.1) THEN 'volatile' ELSE 'none' END AS pattern FROM y",
    "x1_complexity_distribution": _S + _PARTS + " SELECT CASE WHEN complexity <= 5 THEN 'Low (1-5)' WHEN complexity <= 10 THEN 'Medium (6-10)' WHEN complexity <= 20 THEN 'High (11-20)' ELSE 'Very High (>20)' END AS bucket, count(*) AS files FROM parts GROUP BY 1",
    "x2_top_complex": "SELECT p_partkey, CASE WHEN length(p_name) > 30 THEN substr(p_name, 1, 27) || '...' ELSE p_name END AS label, CAST(p_size AS BIGINT) AS complexity, CASE WHEN p_size > 20 THEN 'critical' WHEN p_size > 10 THEN 'high' WHEN p_size > 5 THEN 'medium' ELSE 'low' END AS severity FROM part ORDER BY p_size DESC, p_partkey LIMIT 10",
    "x3_complexity_heatmap": _S + _PARTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY file) AS r FROM parts) SELECT module, string_agg(complexity, ',' ORDER BY r) || repeat(',0', 50 - CAST(count(*) AS INT)) AS \"row\" FROM r WHERE r <= 50 GROUP BY 1",
    "x5_contribution_bars": _PROFILE + ", u AS (SELECT author, 'commits' AS metric, commits AS value FROM prof UNION ALL SELECT author, 'lines', added + removed FROM prof UNION ALL SELECT author, 'files', files FROM prof) SELECT * FROM (SELECT author, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, author) AS place FROM u) WHERE place <= 10",
    "x5_activity_timeline": _S + " SELECT CAST(ts AS DATE) AS day, count(*) AS commits, count(DISTINCT author) AS contributors FROM commits GROUP BY 1",
    "x6_collaboration_network": _S + ", own AS (SELECT DISTINCT file, author FROM authored), e AS (SELECT x.author AS a, y.author AS b, count(*) AS w FROM own x JOIN own y USING (file) WHERE x.author < y.author GROUP BY 1, 2 HAVING count(*) >= 2), n AS (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) SELECT node, CAST(sum(w) AS BIGINT) AS degree, CAST(least(50, 10 + sum(w) * 2) AS BIGINT) AS size FROM n GROUP BY 1",
    "x8_bus_factor_gauge": _S + ", c AS (SELECT author, count(*) AS c FROM commits GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY c DESC, author) AS r, sum(c) OVER (ORDER BY c DESC, author) AS s, sum(c) OVER () AS n, count(*) OVER () AS k FROM c), b AS (SELECT min(r) AS b, max(k) AS k FROM r WHERE s >= n * 0.5) SELECT CAST(b AS BIGINT) AS bus_factor, round(b / k * 100, 6) AS percent, CASE WHEN b <= 1 THEN 'critical' WHEN b <= 2 THEN 'high' WHEN b <= 3 THEN 'medium' ELSE 'excellent' END AS level FROM b",
    "x9_instability": _PAIRS + _PARTS + ", e AS (SELECT DISTINCT x.module AS a, y.module AS b FROM pairs JOIN parts x ON a = x.file JOIN parts y ON b = y.file WHERE weight >= 3 AND x.module <> y.module), o AS (SELECT a AS module, count(*) AS efferent FROM e GROUP BY 1), i AS (SELECT b AS module, count(*) AS afferent FROM e GROUP BY 1), z AS (SELECT module, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent, coalesce(efferent, 0) / (coalesce(efferent, 0) + coalesce(afferent, 0)) AS s FROM o FULL JOIN i USING (module)) SELECT module, afferent, efferent, round(s, 6) AS instability, CASE WHEN s > 0.8 THEN 'Critical' WHEN s > 0.6 THEN 'High' WHEN s > 0.4 THEN 'Medium' ELSE 'Low' END AS risk FROM z",
    "x11_hotspot_heatmap": _HOT + ", v AS (SELECT round(frequency, 6) AS f, commits AS c FROM hot), m AS (SELECT min(f) AS f0, max(f) AS f1, min(c) AS c0, max(c) AS c1 FROM v) SELECT CAST(least(floor((f - f0) / CASE WHEN f1 > f0 THEN (f1 - f0) / 10 ELSE 1.0 END), 9) AS BIGINT) AS x, CAST(least(floor((c - c0) / CASE WHEN c1 > c0 THEN (c1 - c0) / 10 ELSE 1.0 END), 9) AS BIGINT) AS y, count(*) AS n FROM v, m GROUP BY 1, 2",
    "x11_risk_matrix": _HOT + " SELECT risk, count(*) AS files, round(avg(score), 6) AS score FROM hot GROUP BY 1",
    "x11_file_activity": _S + " SELECT file, CAST(sum(insertions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS changes FROM changes GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 20",
    "v5_coupling_network": _PAIRS + ", e AS (SELECT * FROM pairs WHERE weight >= 2), n AS (SELECT a AS node, weight AS w FROM e UNION ALL SELECT b, weight FROM e) SELECT node, CAST(sum(w) AS BIGINT) AS degree, CAST(least(50, 10 + sum(w) * 2) AS BIGINT) AS size FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
}
