"""Change-log analytics over commits (commit_id, author, ts, message) and changes (commit_id, file, insertions, deletions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import dealt, written

#: Pairs that a task makes or counts at once.
PAIRS = 1_000_000
#: Tasks that share the changes of one file, at most.
SPREAD = 8


def commit_type(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: F.greatest(*(m.contains(w) for w in words), F.lit(False))
    prefix = F.regexp_extract(message, r"^(\w+)(?:\(.+?\))?:", 1)
    return (
        F.when(m.startswith("merge "), "merge")
        .when(m.startswith("revert "), "revert")
        .when(prefix != "", prefix)
        .when(has("fix", "bug", "patch"), "fix")
        .when(has("test", "spec"), "test")
        .when(has("feat", "add", "new"), "feat")
        .when(has("doc", "readme"), "docs")
        .when(has("refactor", "clean"), "refactor")
        .otherwise("other")
    )


def commit_lines(commits: DataFrame, changes: DataFrame) -> DataFrame:
    lines = changes.groupBy("commit_id").agg(F.sum("insertions").alias("added"), F.sum("deletions").alias("removed"), F.countDistinct("file").alias("files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return commits.join(lines, "commit_id", "left").select(*commits.columns, zero("added"), zero("removed"), zero("files"))


def contributors(commits: DataFrame, n: int = 20) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("commits")).orderBy(F.col("commits").desc(), "author").limit(n)


def author_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    own = commits.groupBy("author").agg(F.count("*").alias("commits"), F.countDistinct(F.to_date("ts")).alias("active_days"))
    lines = commits.select("commit_id", "author").join(changes, "commit_id").groupBy("author").agg(F.sum("insertions").alias("added"), F.sum("deletions").alias("removed"), F.countDistinct("file").alias("files"))
    return own.join(lines, "author", "left").fillna(0, ["added", "removed", "files"])


def daily_activity(commits: DataFrame, changes: DataFrame) -> DataFrame:
    rows = commit_lines(commits, changes).withColumn("kind", commit_type(F.col("message")))
    good = F.count_if(F.col("kind").isin("feat", "fix"))
    day = rows.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), good.alias("good"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    lines = F.col("added") + F.col("removed")
    score = F.least(F.lit(30), F.col("commits") * 3) + F.least(F.lit(20), F.col("authors") * 5) + F.when(lines > 0, F.least(F.lit(30.0), F.log1p(lines) * 3)).otherwise(0.0) + F.col("good") / F.col("commits") * 20
    return day.withColumn("productivity", F.least(F.lit(100.0), score))


def hot_periods(daily: DataFrame, factor: float = 2.0) -> DataFrame:
    """Runs of neighbouring active days with at least `factor` times the mean; the window is over days, not commits."""
    order = Window.orderBy("day")
    mean = daily.agg(F.avg("commits").alias("mean"))
    rows = daily.select("day", "commits", F.row_number().over(order).alias("n")).join(F.broadcast(mean)).where(F.col("commits") >= F.col("mean") * factor)
    rows = rows.withColumn("run", F.col("n") - F.row_number().over(order))
    return rows.groupBy("run").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("days"), F.sum("commits").alias("commits")).drop("run")


def quiet_periods(daily: DataFrame, least: int = 3) -> DataFrame:
    rows = daily.select("day", F.lead("day").over(Window.orderBy("day")).alias("next"))
    gap = F.datediff("next", "day") - 1
    return rows.where(gap >= least).select(F.date_add("day", 1).alias("start"), F.date_sub("next", 1).alias("end"), gap.cast("long").alias("days"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """(n + 1 - 2 * sum((n - i) * v) / sum(v)) / n over ascending values, i from 0; equal values may swap places."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("s"))
    rows = counts.withColumn("below", below).join(F.broadcast(total))
    # c equal values at places below .. below + c - 1
    part = F.col("v") * (F.col("c") * (F.col("n") - F.col("below")) - F.col("c") * (F.col("c") - 1) / 2)
    return rows.groupBy("n", "s").agg(F.sum(part).alias("w")).select(F.when(F.col("s") == 0, 0.0).otherwise((F.col("n") + 1 - 2 * F.col("w") / F.col("s")) / F.col("n")).alias("gini"))


def bus_factor(commits: DataFrame, share: float = 0.5) -> DataFrame:
    """The fewest authors that made `share` of the commits; the running sum is over distinct commit counts."""
    per = commits.groupBy("author").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.col("c").desc())
    total = per.agg(F.sum(F.col("c") * F.col("k")).alias("n"))
    rows = per.withColumn("upto", F.sum(F.col("c") * F.col("k")).over(w)).withColumn("authors", F.sum("k").over(w)).join(F.broadcast(total))
    before = F.col("upto") - F.col("c") * F.col("k")
    need = F.ceil((F.col("n") * share - before) / F.col("c"))
    return rows.where((F.col("upto") >= F.col("n") * share) & (before < F.col("n") * share)).select((F.col("authors") - F.col("k") + need).cast("long").alias("bus_factor"))


def joined(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with their commits, in tasks of a bounded number of changes."""
    n = changes.count()
    return dealt(commits, n, "commit_id").join(dealt(changes, n, "commit_id"), "commit_id")


def first_of_id(commits: DataFrame, name: str) -> DataFrame:
    """commits with 1 at one row of each commit_id and 0 at its others: the sum over a file's changes counts distinct ids."""
    return commits.withColumn(name, (F.row_number().over(Window.partitionBy("commit_id").orderBy(*(c for c in commits.columns if c != "commit_id"))) == 1).cast("long"))


def file_commits(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, ts, one): each file's commits, where the sum of `one` counts distinct ids."""
    n = changes.count()
    own = first_of_id(dealt(commits.select("commit_id", "ts"), n, "commit_id"), "one")
    return own.join(dealt(changes.select("commit_id", "file"), n, "commit_id").distinct(), "commit_id").select("file", "ts", "one")


def pairs(rows: DataFrame, key: str, item: str, least: int = 1, largest: int | None = None, size: int | None = None) -> DataFrame:
    """(a, b, weight): items that share keys, a < b. Pairs of one key grow with the square of its items: `largest`, if
    given, leaves out keys with more, and is off by default because it changes the result. `size`: the number of rows, if known.

    The items of each key are written as one sorted array, whose sizes tell the number of pairs. Each item then goes, with
    those behind it, to one of so many tasks that none counts more than PAIRS or two of them; an item that has more is split.
    """
    n = rows.count() if size is None else size
    own = dealt(rows.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()), n, key, item).distinct()
    groups = dealt(own, n, key).groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items")).where(F.size("items") > 1)
    groups = written(groups.where(F.size("items") <= largest) if largest else groups, "groups")
    many = F.size("items")
    places = groups.select(many.alias("many"), F.posexplode("items").alias("i", "a"))
    loads = written(places.groupBy("a").agg(F.sum((F.col("many") - 1 - F.col("i")).cast("long")).alias("load")), "loads")
    items, total, most = loads.agg(F.count("*"), F.sum("load"), F.max("load")).first()
    starts = dealt(groups, total or 0, key, each=PAIRS).select("items", F.posexplode("items").alias("i", "a"))
    tails = starts.select("a", F.slice("items", F.col("i") + 2, many).alias("tail")).where(F.size("tail") > 0)
    keys = ["a"]
    if (total or 0) > items * items:  # more pairs than different ones: Spark counts them before they are dealt
        both = tails
    elif most and most > PAIRS:
        large = loads.where(F.col("load") > PAIRS).select("a", F.ceil(F.col("load") / PAIRS).cast("int").alias("parts"))
        tails = tails.join(F.broadcast(large), "a", "left")  # at most a row for each PAIRS pairs
        part = lambda j: F.struct(j.alias("part"), F.filter("tail", lambda b: F.pmod(F.xxhash64(b), F.col("parts")) == j).alias("tail"))
        whole = F.array(F.struct(F.lit(0).alias("part"), "tail"))
        split = F.when(F.col("parts").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), part))
        keys = ["a", "part"]
        both = dealt(tails.select("a", F.inline(split)).where(F.size("tail") > 0), total, *keys, each=PAIRS)
    else:
        both = dealt(tails, total or 0, *keys, each=PAIRS)
    both = both.select(*keys, F.explode("tail").alias("b")).groupBy(*keys, "b").agg(F.count("*").alias("weight"))
    return both.where(F.col("weight") >= least).select("a", "b", "weight")


def file_hotspots(commits: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    kind = commit_type(F.col("message"))
    n = changes.count()
    lines = dealt(changes, n, "commit_id").groupBy("commit_id", "file").agg(F.sum("insertions").alias("added"), F.sum("deletions").alias("removed"), F.count("*").alias("n"))
    own = first_of_id(dealt(commits.select("commit_id", "author", "ts", (kind == "fix").cast("int").alias("fix")), n, "commit_id"), "one")
    rows = own.join(lines, "commit_id").withColumn("fixes", F.col("fix") * F.col("n"))
    facts = [*(F.sum(c).alias(c) for c in ("one", "added", "removed", "fixes")), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    # one deal for both groups; a file's authors go to SPREAD tasks, so that a file of very many changes is no single task's
    rows = rows.withColumn("part", F.pmod(F.xxhash64("author"), F.lit(SPREAD)))
    people = dealt(rows, n, "file", "part").groupBy("file", "part", "author").agg(*facts)
    again = [*(F.sum(c).alias(c) for c in ("one", "added", "removed", "fixes")), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]
    per = people.groupBy("file").agg(F.count("author").alias("authors"), *again).withColumnRenamed("one", "commits")
    per = per.select("file", "commits", "authors", "added", "removed", "fixes", "first_ts", "last_ts")
    days = F.greatest(F.lit(1), F.datediff("last_ts", "first_ts"))
    rate = F.col("commits") / days * 30
    bugs = F.col("fixes") / F.col("commits")
    score = F.least(F.lit(25.0), rate * 10) + F.least(F.lit(20.0), bugs * 40) + F.when(F.col("authors") > 5, F.least(F.lit(15), (F.col("authors") - 5) * 3)).otherwise(0)
    per = per.withColumns({"frequency": rate, "score": F.least(F.lit(100.0), score), "recency_days": F.datediff(F.lit(as_of).cast("timestamp"), "last_ts").cast("long")})
    risk = F.when(F.col("score") >= 70, "critical").when((F.col("score") >= 50) | ((F.col("commits") >= 50) & (F.col("fixes") >= 15)), "high").when(F.col("frequency") >= 0.3, "medium").otherwise("low")
    return per.withColumn("risk", risk)


def bursts(commits: DataFrame, changes: DataFrame, days: int = 2, size: int = 4, least: int = 5) -> DataFrame:
    """(file, day): the first time that `size` commits to a file of `least` or more fell within `days` days."""
    rows = commits.select("commit_id", "ts").join(changes.select("commit_id", "file").distinct(), "commit_id")
    w = Window.partitionBy("file").orderBy("ts", "commit_id")
    rows = rows.withColumns({"later": F.lead("ts", size - 1).over(w), "n": F.count("*").over(Window.partitionBy("file"))})
    whole = F.floor((F.unix_seconds("later") - F.unix_seconds("ts")) / 86400)
    return rows.where((F.col("n") >= least) & (whole <= days)).groupBy("file").agg(F.min("ts").alias("start"))


def file_ownership(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, owner, owner_commits, commits, share): the author with most commits, the smallest name on a tie."""
    per = commits.select("commit_id", "author").join(changes.select("commit_id", "file").distinct(), "commit_id").groupBy("file", "author").agg(F.count("*").alias("c"))
    best = F.max_by(F.struct("author", "c"), F.struct("c", -F.col("author")))
    return per.groupBy("file").agg(best.alias("best"), F.sum("c").alias("commits")).select(
        "file", F.col("best.author").alias("owner"), F.col("best.c").alias("owner_commits"), "commits", (F.col("best.c") / F.col("commits")).alias("share")
    )


def churn(commits: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """(file, changes, age, churn, class): hot at or above the value at 80 % of the ascending list, stable at or below 20 %."""
    per = commits.select("commit_id", "ts").join(changes, "commit_id").groupBy("file").agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"))
    age = F.datediff(F.lit(as_of).cast("timestamp"), "first_ts").cast("long")
    per = per.select("file", "changes", age.alias("age")).withColumn("churn", F.col("changes") / F.greatest(F.lit(1), F.col("age")))
    # nearest rank on the counts of distinct values
    counts = per.groupBy("churn").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("churn")))
    n = per.agg(F.count("*").alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("churn")))
    cuts = counts.join(F.broadcast(n)).agg(at(0.8).alias("high"), at(0.2).alias("low"))
    kind = F.when(F.col("churn") >= F.col("high"), "hot").when(F.col("churn") <= F.col("low"), "stable").otherwise("normal")
    return per.join(F.broadcast(cuts)).select("file", "changes", "age", "churn", kind.alias("kind"))


def daily_velocity(commits: DataFrame, start: str, end: str) -> DataFrame:
    """(day, commits, authors) for every day of the calendar."""
    spine = commits.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("day"))
    per = commits.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))
    return spine.join(per, "day", "left").fillna(0)


def weekly_velocity(daily: DataFrame) -> DataFrame:
    """Keyed by calendar year and ISO week, as reported."""
    return daily.groupBy(F.year("day").cast("long").alias("year"), F.weekofyear("day").cast("long").alias("week")).agg(F.sum("commits").alias("commits"), F.avg("commits").alias("mean"), F.var_pop("commits").alias("variance"))


def velocity_trend(daily: DataFrame, column: str = "commits") -> DataFrame:
    """One row: slope around n / 2 over active days, and stability."""
    active = daily.where(F.col(column) > 0).select(F.col(column).alias("v"), (F.row_number().over(Window.orderBy("day")) - 1).alias("i"))
    facts = active.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    rows = active.join(F.broadcast(facts))
    x = F.col("i") - F.col("n") / 2
    slope = F.sum(x * (F.col("v") - F.col("mean"))) / F.sum(x * x)
    return rows.groupBy("n", "mean", "std").agg(slope.alias("slope")).select("n", "mean", "slope", F.greatest(F.lit(0.0), 100 * (1 - F.col("std") / F.col("mean"))).alias("stability"))


def sprints(daily: DataFrame, length: int = 14) -> DataFrame:
    n = F.row_number().over(Window.orderBy("day")) - 1
    return daily.withColumn("sprint", F.floor(n / length).cast("long")).groupBy("sprint").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.sum("commits").alias("commits"), F.avg("commits").alias("velocity"))


def prediction(sprint_rows: DataFrame, ahead: int = 3) -> DataFrame:
    """(k, predicted, confidence): least squares over sprints, confidence R2 * 0.9 ** (k - 1)."""
    fit = sprint_rows.agg(F.regr_slope("velocity", "sprint").alias("a"), F.regr_intercept("velocity", "sprint").alias("b"), F.regr_r2("velocity", "sprint").alias("r2"), F.max("sprint").alias("last"))
    return fit.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(ahead).cast("long"))).alias("k")).select("k", F.greatest(F.lit(0.0), F.col("a") * (F.col("last") + F.col("k")) + F.col("b")).alias("predicted"), (F.coalesce("r2", F.lit(1.0)) * F.pow(F.lit(0.9), F.col("k") - 1)).alias("confidence"))
