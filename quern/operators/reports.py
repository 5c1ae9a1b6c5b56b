"""Report operators over the change log: contributors, ownership, teams, momentum, complexity and chart series.

commits (commit_id, author, ts, message) and changes (commit_id, file, insertions, deletions) as in `history`; files have
a `module` (directory), a `kind` (language) and a `complexity`. Times are compared with an explicit `as_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import history as H


def _capped(limit: float, c: Column) -> Column:
    return F.least(F.lit(float(limit)), c)


def _days(as_of: str, ts: str | Column) -> Column:
    return F.datediff(F.lit(as_of).cast("timestamp"), ts)


def _has(message: Column, *words: str) -> Column:
    return message.rlike("|".join(words))


# --- contributors --------------------------------------------------------------------------------


def profiles(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(author, commits, added, removed, active_days, first_ts, last_ts, files)."""
    rows = H.commit_lines(commits, changes)
    own = rows.groupBy("author").agg(
        F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    files = touched(commits, changes).groupBy("author").agg(F.count("*").alias("files"))
    return own.join(files, "author", "left").fillna(0, ["files"])


def touched(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Distinct (author, file)."""
    return _touches(commits, changes).distinct()


def _touches(commits: DataFrame, changes: DataFrame) -> DataFrame:
    return H.joined(commits.select("commit_id", "author"), changes.select("commit_id", "file")).select("author", "file")


def shared_files_of(commits: DataFrame, changes: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, weight): the number of files that authors a and b have both changed."""
    return H.pairs(_touches(commits, changes), "file", "author", least, size=changes.count())


def contributor_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Profiles with net lines and the commit types as `type=count`, by type."""
    kinds = commits.groupBy("author", H.commit_type(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("author").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("types"))
    return profiles(commits, changes).drop("files").withColumn("net", F.col("added") - F.col("removed")).join(kinds, "author")


def contributor_profile(commits: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    p = profiles(commits, changes)
    rate, net = F.col("commits") / F.col("active_days"), F.col("added") - F.col("removed")
    span = F.datediff("last_ts", "first_ts") + 1
    score = _capped(35, rate * 12) + F.when(net > 0, _capped(30, net / 400)).otherwise(0.0) + _capped(20, F.col("files") / 10) + F.col("active_days") / span * 15
    level = F.when((F.col("commits") > 500) & (F.col("files") > 100), "expert").when((F.col("commits") > 100) & (F.col("files") > 50), "senior").when(F.col("commits") > 20, "intermediate").otherwise("junior")
    return p.select("author", rate.alias("frequency"), _capped(100, score).alias("productivity"), level.alias("expertise"), (_days(as_of, "last_ts") <= 30).alias("active"))


def individual_velocity(commits: DataFrame, changes: DataFrame, start: str, end: str) -> DataFrame:
    """Productivity, consistency, impact and trend of each author within the days start .. end."""
    day = F.to_date("ts")
    p = profiles(commits.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))), changes)
    period, net = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")), F.col("added") - F.col("removed")
    rate = F.col("commits") / period
    productivity = _capped(30, rate * 30) + F.when(net > 0, _capped(30, F.log1p(net) * 2)).otherwise(0.0) + F.col("active_days") / period * 20 + _capped(20, F.col("files") / 5)
    impact = _capped(40, F.col("commits").cast("double")) + _capped(30, F.col("files") / 2) + F.when(net > 0, _capped(30, F.log1p(net))).otherwise(0.0)
    idle = F.datediff(F.lit(end).cast("date"), "last_ts")
    trend = F.when(idle > 30, "inactive").when(idle > 14, "decreasing").when(rate > 1, "increasing").otherwise("stable")
    consistency = _capped(100, F.col("active_days") / (F.datediff("last_ts", "first_ts") + 1) * 100)
    return p.select("author", "commits", _capped(100, productivity).alias("productivity"), consistency.alias("consistency"), _capped(100, impact).alias("impact"), trend.alias("trend"))


def expertise_areas(commits: DataFrame, changes: DataFrame, files: DataFrame, modules: int = 5, kinds: int = 3) -> DataFrame:
    """(author, area, place): the modules, then the kinds, in which an author has touched most files."""
    rows = touched(commits, changes).join(files, "file")

    def top(column: str, n: int, shift: int) -> DataFrame:
        w = Window.partitionBy("author").orderBy(F.col("n").desc(), "area")
        per = rows.groupBy("author", F.col(column).alias("area")).agg(F.count("*").alias("n"))
        return per.withColumn("place", F.row_number().over(w) + shift).where(F.col("place") <= n + shift).select("author", "area", F.col("place").cast("long").alias("place"))

    return top("module", modules, 0).unionByName(top("kind", kinds, modules))


# --- ownership -----------------------------------------------------------------------------------


def ownership(commits: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Per file: owner, shares, concentration, first and last author, change rate, bus factor (authors of more than a
    fifth of the commits), whether the owner has left (no commit in 30 days), and the risk."""
    rows = commits.select("commit_id", "author", "ts").join(changes.select("commit_id", "file").distinct(), "commit_id")
    per = rows.groupBy("file", "author").agg(F.count("*").alias("c"), F.min(F.struct("ts", "author")).alias("a"), F.max(F.struct("ts", -F.col("author"))).alias("z"))
    w = Window.partitionBy("file")
    rank = F.row_number().over(w.orderBy("c", "author")) - 1
    per = per.withColumns({"total": F.sum("c").over(w), "i": rank, "n": F.count("*").over(w)})
    facts = per.groupBy("file", "total", "n").agg(
        F.max_by("author", F.struct("c", -F.col("author"))).alias("owner"), F.max("c").alias("owner_commits"), F.sum((F.col("n") - F.col("i")) * F.col("c")).alias("w"),
        F.count_if(F.col("c") / F.col("total") > 0.2).alias("large"), F.min("a").alias("a"), F.max("z").alias("z"),
    )
    last = commits.groupBy(F.col("author").alias("owner")).agg((_days(as_of, F.max("ts")) > 30).alias("orphaned"))
    bus = F.greatest(F.lit(1), F.col("large"))
    risk = F.when(F.col("orphaned"), "critical").when(bus == 1, "high").when(bus == 2, "medium").otherwise("low")
    return facts.join(last, "owner").select(
        "file", "owner", F.col("total").alias("commits"), F.col("n").alias("contributors"), (F.col("owner_commits") / F.col("total") * 100).alias("percent"),
        ((F.col("n") + 1 - 2 * F.col("w") / F.col("total")) / F.col("n")).alias("gini"), F.col("a.author").alias("created_by"), (-F.col("z")["col2"]).alias("modified_by"),
        (F.col("total") / (F.datediff("z.ts", "a.ts") + 1)).alias("change_rate"), bus.cast("long").alias("bus_factor"), "orphaned", risk.alias("risk"),
    )


def ownership_lists(owned: DataFrame) -> DataFrame:
    """(list, file): orphans, files of bus factor one that are no orphans, and files of a single author."""
    pick = lambda name, test: owned.where(test).select(F.lit(name).alias("list"), "file")
    return pick("orphan", F.col("orphaned")).unionByName(pick("high_risk", ~F.col("orphaned") & (F.col("bus_factor") == 1))).unionByName(pick("silo", F.col("contributors") == 1))


def ownership_risk(owned: DataFrame, commits: DataFrame, as_of: str) -> DataFrame:
    last = commits.groupBy("author").agg((_days(as_of, F.max("ts")) <= 30).alias("active"))
    people = last.agg(F.avg(F.col("active").cast("double")).alias("active_share"))
    facts = owned.agg(F.count("*").alias("files"), F.avg(F.col("orphaned").cast("double")).alias("orphans"), F.avg((F.col("contributors") == 1).cast("double")).alias("silos"))
    held = owned.groupBy(F.col("owner").alias("author")).agg(F.count("*").alias("k")).join(last.where("active"), "author").join(F.broadcast(facts))
    bus = held.agg(F.count_if(F.col("k") / F.col("files") > 0.1).alias("bus_factor"))
    score = F.when(F.col("bus_factor") <= 1, 30).when(F.col("bus_factor") <= 2, 20).when(F.col("bus_factor") <= 3, 10).otherwise(0) + F.col("orphans") * 30 + F.col("silos") * 20 + F.when(F.col("active_share") < 0.5, 20).otherwise(0)
    return facts.crossJoin(bus).crossJoin(people).select("files", "bus_factor", "orphans", "silos", "active_share", _capped(100, score).alias("risk"))  # one row each


def team_territories(owned: DataFrame, teams: DataFrame) -> DataFrame:
    return owned.join(teams, F.col("owner") == F.col("author")).groupBy("team").agg(F.count("*").alias("files"))


def team_pairs(commits: DataFrame, changes: DataFrame, teams: DataFrame) -> DataFrame:
    """(a, b, weight): files that two teams have both changed. A file has at most as many rows as there are teams."""
    return H.pairs(touched(commits, changes).join(teams, "author").select("file", "team").distinct(), "file", "team")


def team_bus_factor(commits: DataFrame, teams: DataFrame, as_of: str) -> DataFrame:
    last = commits.groupBy("author").agg(F.max("ts").alias("last_ts"))
    return teams.join(last, "author", "left").groupBy("team").agg(F.count_if(_days(as_of, "last_ts") <= 30).alias("active"))


# --- history -------------------------------------------------------------------------------------


def trends(commits: DataFrame, as_of: str, recent: int = 7) -> DataFrame:
    """One row: the last active days against the older ones, who is still active, and shares of commit types."""
    daily = commits.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    rank = daily.withColumn("r", F.row_number().over(Window.orderBy(F.col("day").desc())))  # one row a day
    new, old = F.avg(F.when(F.col("r") <= recent, F.col("c"))), F.avg(F.when(F.col("r") > recent, F.col("c")))
    a = rank.agg(new.alias("recent"), old.alias("older"))
    b = commits.groupBy("author").agg(F.max("ts").alias("z")).agg(F.count("*").alias("people"), F.count_if(_days(as_of, "z") < 7).alias("active"))
    kind = H.commit_type(F.col("message"))
    c = commits.agg(F.avg((kind == "fix").cast("double")).alias("fixes"), F.avg((kind == "feat").cast("double")).alias("features"))
    activity = F.when(F.col("recent") > F.col("older") * 1.5, "increasing").when(F.col("recent") < F.col("older") * 0.5, "decreasing").otherwise("steady")
    people = F.when(F.col("active") < F.col("people") * 0.5, "many inactive").when(F.col("active") == F.col("people"), "all active").otherwise("mixed")
    return a.crossJoin(b).crossJoin(c).select("recent", "older", activity.alias("activity"), people.alias("contributors"), "fixes", "features")


def activity_level(commits: DataFrame) -> DataFrame:
    """One row: level by commits an active day, the busiest day, the author with most commits and the commonest type."""
    daily = commits.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    a = daily.agg(F.avg("c").alias("mean"), F.max_by("day", F.struct("c", -F.unix_date("day"))).alias("busiest"))
    b = commits.groupBy("author").agg(F.count("*").alias("c")).agg(F.max_by("author", F.struct("c", -F.col("author"))).alias("top_author"))
    kinds = commits.groupBy(H.commit_type(F.col("message")).alias("kind")).agg(F.count("*").alias("c"))
    c = kinds.orderBy(F.col("c").desc(), "kind").limit(1).select(F.col("kind").alias("top_type"))
    level = F.when(F.col("mean") > 10, "high").when(F.col("mean") > 3, "moderate").otherwise("low")
    return a.crossJoin(b).crossJoin(c).select(level.alias("level"), "busiest", "top_author", "top_type")


def commit_ratios(commits: DataFrame) -> DataFrame:
    m = F.lower("message")
    out = commits.agg(
        F.count("*").alias("commits"), F.count_if(m.startswith("merge ")).alias("merges"), F.count_if(m.contains("revert")).alias("reverts"),
        F.count_if(_has(m, "fix", "bug", "patch", "repair")).alias("fixes"), F.count_if(_has(m, "feat", "feature", "add", "new")).alias("features"),
    )
    return out.withColumns({"merge_ratio": F.try_divide("merges", "commits"), "fix_ratio": F.try_divide("fixes", "commits")})


def distribution(commits: DataFrame, part: Column, first: int, n: int) -> DataFrame:
    """(place, commits, peak) for each of n places from `first`, zero where there is none; the first maximum is the peak."""
    spine = commits.sparkSession.range(first, first + n).withColumnRenamed("id", "place")
    per = commits.groupBy(part.cast("long").alias("place")).agg(F.count("*").alias("commits"))
    rows = spine.join(per, "place", "left").fillna(0, ["commits"])
    peak = rows.agg(F.max_by("place", F.struct("commits", -F.col("place"))).alias("p"))
    return rows.join(F.broadcast(peak)).select("place", "commits", (F.col("place") == F.col("p")).alias("peak"))


def retention(commits: DataFrame, as_of: str) -> DataFrame:
    per = commits.groupBy("author").agg((_days(as_of, F.max("ts")) <= 30).cast("double").alias("active"))
    return per.agg(F.count("*").alias("contributors"), (F.avg("active") * 100).alias("retention"), ((1 - F.avg("active")) * 100).alias("churn"))


def collaboration_score(commits: DataFrame, changes: DataFrame) -> DataFrame:
    people = commits.agg(F.countDistinct("author").alias("n"))
    edges = shared_files_of(commits, changes).agg(F.count("*").alias("edges"))
    most = F.col("n") * (F.col("n") - 1) / 2
    return people.crossJoin(edges).select("n", "edges", F.when(F.col("n") <= 1, 0.0).otherwise(_capped(100, F.try_divide(F.col("edges"), most) * 100)).alias("score"))


def growth(commits: DataFrame) -> DataFrame:
    """One row: commits a day, and the rate of the older half of the commits, newest first, against the newer half's."""
    # places by day: a count for each day, not a window over all commits
    daily = commits.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    rows = daily.withColumns({"upto": F.sum("c").over(Window.orderBy(F.col("day").desc()))})
    facts = daily.agg(F.sum("c").alias("n"), F.min("day").alias("a"), F.max("day").alias("z"))
    rows = rows.crossJoin(F.broadcast(facts)).withColumn("half", F.floor(F.col("n") / 2))
    in_first, in_second = F.col("upto") - F.col("c") < F.col("half"), F.col("upto") > F.col("half")
    span = lambda test: F.greatest(F.lit(1), F.datediff(F.max(F.when(test, F.col("day"))), F.min(F.when(test, F.col("day")))))
    got = rows.groupBy("n", "half", "a", "z").agg(span(in_first).alias("d1"), span(in_second).alias("d2"))
    r1, r2 = F.col("half") / F.col("d1"), (F.col("n") - F.col("half")) / F.col("d2")
    trend = F.when(F.col("n") < 10, "insufficient_data").when(r2 > r1 * 1.2, "increasing").when(r2 < r1 * 0.8, "decreasing").otherwise("stable")
    return got.select(F.col("n").alias("commits"), (F.col("n") / F.greatest(F.lit(1), F.datediff("z", "a"))).alias("rate"), trend.alias("trend"))


def activity_trends(commits: DataFrame, changes: DataFrame, least: int = 10) -> DataFrame:
    """(file, trend) of files with `least` commits or more, by the rates of the halves of their commits."""
    rows = commits.select("commit_id", "ts").join(changes.select("commit_id", "file").distinct(), "commit_id")
    w = Window.partitionBy("file")
    rows = rows.withColumns({"r": F.row_number().over(w.orderBy("ts", "commit_id")), "n": F.count("*").over(w)}).where(F.col("n") >= least)
    half = F.floor(F.col("n") / 2)
    first = F.col("r") <= half
    span = lambda test: F.greatest(F.lit(1), F.datediff(F.max(F.when(test, F.col("ts"))), F.min(F.when(test, F.col("ts")))))
    got = rows.groupBy("file", "n").agg(span(first).alias("d1"), span(~first).alias("d2"))
    r1, r2 = half / F.col("d1"), (F.col("n") - half) / F.col("d2")
    return got.select("file", F.col("n").alias("commits"), F.when(r2 > r1 * 1.5, "increasing").when(r2 < r1 * 0.5, "declining").otherwise("steady").alias("trend"))


def ranked_hotspots(hotspots: DataFrame, threshold: float = 10.0, least: int = 2) -> DataFrame:
    return hotspots.where((F.col("commits") >= least) & (F.col("score") >= threshold))


def module_hotspots(hotspots: DataFrame, files: DataFrame) -> DataFrame:
    """Hot files, commits, fixes and the mean complexity above zero of each module."""
    mean = F.avg(F.when(F.col("complexity") > 0, F.col("complexity")))
    return hotspots.join(files, "file").groupBy("module").agg(F.count("*").alias("files"), F.sum("commits").alias("commits"), F.sum("fixes").alias("fixes"), F.coalesce(mean, F.lit(0.0)).alias("complexity"))


# --- momentum ------------------------------------------------------------------------------------


def team_metrics(velocity: DataFrame, shared_share: DataFrame) -> DataFrame:
    """One row of individual velocities and the share of files with several authors (shared)."""
    facts = velocity.agg(F.count("*").alias("members"), F.count_if(F.col("trend") != "inactive").alias("active"), F.coalesce(F.sum("commits"), F.lit(0)).alias("velocity"), F.avg("productivity").alias("p"))
    large = velocity.crossJoin(F.broadcast(facts.select(F.col("velocity").alias("all")))).agg(F.count_if(F.col("commits") / F.col("all") >= 0.1).alias("large"))
    rows = facts.crossJoin(large).crossJoin(shared_share).withColumn("efficiency", F.col("active") / F.col("members") * 100)
    better = lambda x: (F.col("p") > x) & (F.col("efficiency") > x)
    health = F.when(better(70), "excellent").when(better(50), "good").when(better(30), "fair").otherwise("needs improvement")
    bus = F.when(F.col("active") <= 1, 1).otherwise(F.greatest(F.lit(1), F.col("large")))
    return rows.select("members", "active", "velocity", F.col("shared").alias("collaboration"), "efficiency", health.alias("health"), bus.cast("long").alias("bus_factor"))


def shared_files(commits: DataFrame, changes: DataFrame) -> DataFrame:
    per = touched(commits, changes).groupBy("file").agg(F.count("*").alias("n"))
    return per.agg((F.avg((F.col("n") > 1).cast("double")) * 100).alias("shared"))


def team_velocity(velocity: DataFrame, teams: DataFrame) -> DataFrame:
    return velocity.join(teams, "author").groupBy("team").agg(F.count("*").alias("members"), F.sum("commits").alias("commits"), F.avg("productivity").alias("productivity"))


def momentum_score(daily: DataFrame, velocity: DataFrame, shared_share: DataFrame, points: str = "commits") -> DataFrame:
    """One row: velocity, productivity, quality, collaboration, their weighted sum, trend of the halves, sustainability."""
    v = F.col("v")
    rows = daily.select("day", F.col(points).alias("v"), F.row_number().over(Window.orderBy("day")).alias("r"))  # one row a day
    n = daily.agg(F.count("*").alias("n"))
    new = F.col("r") > F.floor(F.col("n") / 2)
    facts = rows.crossJoin(F.broadcast(n)).groupBy("n").agg(
        F.avg(F.when(v > 0, v)).alias("mean"), F.stddev_pop(F.when(v > 0, v)).alias("std"), F.count_if(v > 0).alias("k"), F.sum(F.when(new, v).otherwise(0)).alias("recent"), F.sum(F.when(new, 0).otherwise(v)).alias("older")
    )
    even = F.greatest(F.lit(0.0), 100 * (1 - F.col("std") / F.col("mean")))
    score = F.coalesce(_capped(100, F.when(F.col("k") > 1, (F.col("mean") * 2 + even) / 3).otherwise(F.col("mean") * 2)), F.lit(0.0))
    people = velocity.agg(F.coalesce(F.avg("productivity"), F.lit(0.0)).alias("productivity"), F.count("*").alias("people"))
    half = F.floor(F.col("n") / 2)
    recent, older = F.col("recent") / (F.col("n") - half), F.col("older") / half
    out = facts.crossJoin(people).crossJoin(shared_share).withColumns({"velocity": score, "quality": 70.0 + F.when(F.col("productivity") > 80, 10.0).when(F.col("productivity") < 40, -10.0).otherwise(0.0)})
    total = 0.3 * F.col("velocity") + 0.3 * F.col("productivity") + 0.2 * F.col("quality") + 0.2 * F.col("shared")
    trend = F.when(F.col("n") <= 7, "stable").when(recent > older * 1.1, "increasing").when(recent < older * 0.9, "decreasing").otherwise("stable")
    lasting = (F.col("velocity") / 100 * 0.6 + F.least(F.lit(1.0), F.col("people") / 5) * 0.4) * 100
    return out.select("velocity", "productivity", "quality", F.col("shared").alias("collaboration"), total.alias("momentum"), trend.alias("trend"), lasting.alias("sustainability"))


def sprint_velocity(commits: DataFrame, changes: DataFrame, start: str, length: int = 14) -> DataFrame:
    """(sprint, commits, velocity): commits and half the log of the lines, as of 14 days; sprints count from `start`."""
    rows = H.commit_lines(commits, changes).where(F.to_date("ts") >= F.lit(start).cast("date"))
    per = rows.groupBy(F.floor(F.datediff(F.to_date("ts"), F.lit(start).cast("date")) / length).alias("sprint")).agg(F.count("*").alias("commits"), F.sum(F.col("added") + F.col("removed")).alias("lines"))
    return per.select("sprint", "commits", ((F.col("commits") + F.when(F.col("lines") > 0, F.log1p("lines") * 0.5).otherwise(0.0)) * (14 / length)).alias("velocity"))


def completion(trend: DataFrame, remaining: float, confidence: float = 0.8) -> DataFrame:
    """Days to complete the remaining work at the mean velocity, with a buffer for what is missing to certainty."""
    days = F.lit(float(remaining)) / F.col("mean")
    sure = F.when(F.col("stability") > 0, F.least(F.lit(confidence), F.col("stability") / 100)).otherwise(confidence * 0.7)
    ok = trend.where(F.col("mean") > 0)
    return ok.select(F.floor(days * (2 - confidence)).alias("days"), F.floor(days * (2 - confidence) - days).alias("buffer"), F.round(sure * 100, 1).alias("confidence"), F.col("mean").alias("velocity"))


#: Metrics of which more is better, and of which less is.
BETTER_HIGH, BETTER_LOW = ("health_score", "coverage"), ("complexity", "duplication")


def metric_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, baseline, current, change, percent, verdict) of (metric, value) tables; metrics of one side only go."""
    rows = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric")
    change = F.col("current") - F.col("baseline")
    good = (F.col("metric").isin(*BETTER_HIGH) & (change > 0)) | (F.col("metric").isin(*BETTER_LOW) & (change < 0))
    bad = (F.col("metric").isin(*BETTER_HIGH) & (change < 0)) | (F.col("metric").isin(*BETTER_LOW) & (change > 0))
    percent = F.when(F.col("baseline") != 0, change / F.col("baseline") * 100).otherwise(0.0)
    return rows.select("metric", "baseline", "current", change.alias("change"), percent.alias("percent"), F.when(good, "improved").when(bad, "regressed").otherwise("none").alias("verdict"))


def metric_trends(series: DataFrame) -> DataFrame:
    """(metric, n, forecast, pattern) of (metric, at, value): the last value and its last change, and monotone or volatile
    series, of metrics with three values or more."""
    w = Window.partitionBy("metric").orderBy("at")
    rows = series.withColumn("d", F.col("value") - F.lag("value").over(w))
    last = F.max_by(F.struct("value", "d"), "at")
    per = rows.groupBy("metric").agg(F.count("*").alias("n"), last.alias("z"), F.min("d").alias("low"), F.max("d").alias("high"), F.avg(F.abs("d")).alias("move")).where("n >= 3")
    of_high = F.col("metric").isin(*BETTER_HIGH)
    pattern = (
        F.when(F.col("low") >= 0, F.when(of_high, "improvement").otherwise("none"))
        .when(F.col("high") <= 0, F.when(of_high, "degradation").otherwise("none"))
        .when((F.col("n") >= 4) & (F.col("move") > F.abs(F.col("z.value") * 0.1)), "volatile")
        .otherwise("none")
    )
    return per.select("metric", "n", (F.col("z.value") + F.col("z.d")).alias("forecast"), pattern.alias("pattern"))


# --- complexity, metrics and charts --------------------------------------------------------------


def bucket(value: Column, edges: list[int], names: list[str]) -> Column:
    """The name of the first edge that the value does not exceed, else the last name."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(value <= edge, name).otherwise(out)
    return out


def complexity_summary(files: DataFrame, threshold: int = 10) -> DataFrame:
    c = F.col("complexity")
    return files.agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.stddev_pop(c).alias("std"), F.max(c).alias("largest"), F.count_if(c > threshold).alias("above"), F.count_if(c > 2 * threshold).alias("far_above"))


def derived_metrics(files: DataFrame) -> DataFrame:
    """One row of files (path, lines, comments, complexity): ratios, estimates, debt, maintainability, quality."""
    is_test = F.lower("path").rlike("test|spec")
    f = files.agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("comments").alias("comments"), F.avg("lines").alias("size"), F.var_pop("lines").alias("spread"), F.avg("complexity").alias("c"), F.avg(is_test.cast("double")).alias("tests")
    )
    f = f.withColumns({"documentation": F.coalesce(F.try_divide(F.col("comments"), F.col("lines") - F.col("comments")), F.lit(0.0)), "coverage": F.least(F.lit(0.95), F.col("tests") * 3.5), "duplication": F.when(F.col("spread") > 0, F.least(F.lit(0.5), 1000 / (F.col("spread") + 1000))).otherwise(0.0)})
    over = lambda c, x, k, most: F.when(F.col(c) > x, F.least(F.lit(float(most)), (F.col(c) - x) * k)).otherwise(0.0)
    under = lambda c, x: F.when(F.col(c) < x, 20 * (x - F.col(c)) / x).otherwise(0.0)
    debt = over("c", 10, 3, 30) + over("size", 300, 1 / 20, 20) + under("documentation", 0.15) + under("coverage", 0.5)
    index = 171 - 5.2 * F.least(F.lit(10.0), F.col("c")) - F.when(F.col("size") > 0, 0.23 * F.log1p("size")).otherwise(0.0)
    quality = 100 - over("c", 10, 2, 20) - F.when(F.col("documentation") < 0.1, 15).otherwise(0) - F.when(F.col("size") > 500, 10).otherwise(0) - F.when(F.col("duplication") > 0.1, F.least(F.lit(15.0), F.col("duplication") * 150)).otherwise(0.0) + F.when(F.col("coverage") > 0.8, 10).otherwise(0)
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    return f.select("documentation", "coverage", "duplication", _capped(100, debt).alias("debt"), within(index * 100 / 171).alias("maintainability"), within(quality).alias("quality"))


def severity(complexity: Column) -> Column:
    return F.when(complexity > 20, "critical").when(complexity > 10, "high").when(complexity > 5, "medium").otherwise("low")


def top(rows: DataFrame, metric: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(metric).desc(), key).limit(n)


def function_matrix(files: DataFrame, width: int = 50) -> DataFrame:
    """(module, row): the complexities of a module's first `width` files by key, zeros behind, as text."""
    w = Window.partitionBy("module").orderBy("file")
    few = files.withColumn("r", F.row_number().over(w)).where(F.col("r") <= width)
    got = few.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "complexity"))), lambda x: x["complexity"].cast("string")).alias("row"))
    return got.select("module", F.array_join(F.concat("row", F.array_repeat(F.lit("0"), F.lit(width) - F.size("row"))), ",").alias("row"))


def network_nodes(edges: DataFrame, least: int = 2) -> DataFrame:
    """(node, degree, size) of the nodes of edges (a, b, weight) of enough weight."""
    e = edges.where(F.col("weight") >= least)
    ends = e.select(F.explode(F.array("a", "b")).alias("node"), "weight")  # a union of both ends would compute the edges twice
    return ends.groupBy("node").agg(F.sum("weight").alias("degree")).withColumn("size", F.least(F.lit(50).cast("long"), 10 + F.col("degree") * 2))


def instability(edges: DataFrame) -> DataFrame:
    """(module, afferent, efferent, instability, risk) of directed edges (a, b) between modules."""
    e = edges.where("a <> b").select("a", "b").distinct()
    out, into = e.groupBy(F.col("a").alias("module")).agg(F.count("*").alias("efferent")), e.groupBy(F.col("b").alias("module")).agg(F.count("*").alias("afferent"))
    rows = out.join(into, "module", "full_outer").fillna(0, ["efferent", "afferent"])
    i = F.col("efferent") / (F.col("efferent") + F.col("afferent"))
    risk = F.when(i > 0.8, "Critical").when(i > 0.6, "High").when(i > 0.4, "Medium").otherwise("Low")
    return rows.select("module", "afferent", "efferent", i.alias("instability"), risk.alias("risk"))


def heatmap(rows: DataFrame, x: str, y: str, size: int = 10) -> DataFrame:
    """(x, y, n): how many rows fall into each cell of an even grid between the extremes, empty cells left out."""
    ends = rows.agg(*(f(c).alias(f"{n}{k}") for k, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))))

    def cell(c: str, k: str) -> Column:
        step = F.when(F.col(f"hi{k}") > F.col(f"lo{k}"), (F.col(f"hi{k}") - F.col(f"lo{k}")) / size).otherwise(1.0)
        return F.least(F.floor((F.col(c) - F.col(f"lo{k}")) / step), F.lit(size - 1)).cast("long")

    return rows.join(F.broadcast(ends)).groupBy(cell(x, "x").alias("x"), cell(y, "y").alias("y")).agg(F.count("*").alias("n"))


# --- accounts and paths --------------------------------------------------------------------------

#: Patterns of automatic accounts and of test files.
BOT_PATTERNS = [r"bot\b", r"\[bot\]", "dependabot", "renovate", "github-actions", "automation", "ci-", "jenkins"]
TEST_PATTERNS = ["test_", r"_test\.", "/tests?/", "/spec/", r"\.spec\.", r"\.test\."]


def is_bot(email: Column, name: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(email, F.lit("")), F.coalesce(name, F.lit("")))).rlike("|".join(BOT_PATTERNS))


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike("|".join(TEST_PATTERNS))
