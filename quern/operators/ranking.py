"""Relevance factors as columns, weighted scores and the ranked list."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences
from .storage import positions, written

#: Weights of the fast profile, and directories that count as important.
FAST = {"keyword_match": 0.6, "path_relevance": 0.3, "type_relevance": 0.1}
IMPORTANT = ["src", "lib", "core", "main", "app", "api", "service", "handler"]


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c
    return total


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def keyword_score(content: Column, path: Column, keywords: list[str]) -> Column:
    words = [k.lower().strip() for k in keywords if k.strip()]
    text, name = F.lower(content), F.lower(file_name(path))
    named = [name.contains(k).cast("int") for k in words]
    hits = [occurrences(text, k) for k in words]
    matched = _sum(named) + _sum([(h > 0).cast("int") for h in hits])
    score = F.when(_sum(named) > 0, 0.6).otherwise(0.0) + 0.5 * matched / max(1, len(keywords)) + F.least(F.lit(0.2), F.log1p(_sum(hits)) / 6)
    return F.when(matched == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def path_score(path: Column, keywords: list[str], task: str = "feature") -> Column:
    p = F.lower(path)
    important = F.lit(False)
    for d in IMPORTANT:
        important = important | p.contains(d)
    score = _sum([F.when(p.contains(k.lower()), 0.3).otherwise(0.0) for k in keywords]) + F.when(important, 0.2).otherwise(0.0)
    if task != "test":
        score = score * F.when(p.contains("test") | p.contains("spec"), 0.5).otherwise(1.0)
    return F.least(F.lit(1.0), score)


def type_score(path: Column, task: str, cyclomatic: Column | None = None) -> Column:
    p = F.lower(path)
    test = p.contains("test")
    if task == "test":
        return F.when(test | p.contains("spec"), 1.0).otherwise(0.3)
    if task == "debug":
        return F.when(p.contains("error") | p.contains("exception") | p.contains("log"), 0.8).otherwise(0.5)
    if task == "feature":
        return F.when(test, 0.2).otherwise(0.6)
    if task == "refactor" and cyclomatic is not None:
        return F.when(cyclomatic > 10, 0.8).otherwise(0.5)
    return F.lit(0.5)


def weighted(factors: dict[str, float]) -> Column:
    total = sum(factors.values())
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _sum([F.col(c) * w for c, w in factors.items()]) / total))


def rank_files(scored: DataFrame, threshold: float = 0.1, fallback: int = 3) -> DataFrame:
    """(doc_id, path, score, rank) at or above the threshold, or the first three if none is."""
    scored = written(scored, "scored")
    best = scored.orderBy(F.col("score").desc(), "doc_id").limit(fallback)
    some = scored.where(F.col("score") >= threshold)
    rows = some if some.limit(1).count() else best
    return positions(rows, [F.col("score").desc(), F.col("doc_id")], "rank")


def compare_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, rank_a, rank_b, delta): a missing file has the rank after the last."""
    sizes = a.agg((F.count("*") + 1).alias("na")).join(b.agg((F.count("*") + 1).alias("nb")))
    both = a.select("doc_id", F.col("rank").alias("ra")).join(b.select("doc_id", F.col("rank").alias("rb")), "doc_id", "full_outer").join(F.broadcast(sizes))
    both = both.select("doc_id", F.coalesce("ra", "na").alias("rank_a"), F.coalesce("rb", "nb").alias("rank_b"))
    return both.withColumn("delta", F.col("rank_a") - F.col("rank_b"))


def greedy_selection(ranked: DataFrame, budget: int, tokens: str = "tokens", block: int = 10_000) -> DataFrame:
    """(doc_id, mode): whole files while they fit, else a quarter of one worth more than 100 tokens, until 95 % is used.

    A skipped file uses nothing, so this is a fold over the ranked list, not a running sum. It takes blocks of ranks, one
    at a time, each with the tokens used before; most budgets end in the first one.
    """
    full_at = budget * 0.95
    rows = F.struct("rank", "doc_id", F.col(tokens).cast("long").alias("t"))
    empty = F.array().cast("array<struct<doc_id:bigint,mode:string,tokens:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        full = acc["used"] + x["t"] <= budget
        summary = F.least(F.floor(x["t"] / 4), F.lit(budget) - acc["used"])
        take = F.when(acc["used"] >= full_at, F.lit(0).cast("long")).when(full, x["t"]).when(summary > 100, summary).otherwise(F.lit(0).cast("long"))
        row = F.struct(x["doc_id"].alias("doc_id"), F.when(full, "full").otherwise("summary").alias("mode"), take.alias("tokens"))
        taken = (acc["used"] < full_at) & (full | (summary > 100))
        return F.struct((acc["used"] + take).alias("used"), F.when(taken, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    ranked = written(ranked.select("rank", "doc_id", tokens), "ranked")
    last = ranked.agg(F.max("rank")).first()[0] or 0
    parts, used = [], 0
    for first in range(1, last + 1, block):
        zero = F.struct(F.lit(used).cast("long").alias("used"), empty.alias("out"))
        items = ranked.where(F.col("rank").between(first, first + block - 1)).agg(F.array_sort(F.collect_list(rows)).alias("items"))
        parts.append(written(items.select(F.aggregate("items", zero, step).alias("fold")).select("fold.*"), "selected"))
        used = parts[-1].first()["used"]
        if used >= full_at:
            break
    if not parts:
        return ranked.select("doc_id", F.lit("full").alias("mode"), F.col(tokens).cast("long").alias("tokens")).limit(0)
    return functools.reduce(DataFrame.unionByName, parts).select(F.inline("out"))


def recency_steps(days: Column) -> Column:
    """1, 0.7, 0.4 or 0.1 for changes of the last 7, 30, 90 days or before; 0.5 where unknown."""
    return F.when(days.isNull(), 0.5).when(days <= 7, 1.0).when(days <= 30, 0.7).when(days <= 90, 0.4).otherwise(0.1)


def recency_decay(days: Column) -> Column:
    return F.coalesce(F.exp(-days / 30), F.lit(0.5))


def change_frequency(commits: Column) -> Column:
    """Buckets up to 50 changes, then the logarithm of the excess, at most 1."""
    busy = F.least(F.lit(1.0), 0.8 + F.log(commits / 50) / 10)
    return F.when(commits == 0, 0.0).when(commits <= 5, 0.3).when(commits <= 20, 0.6).when(commits <= 50, 0.8).otherwise(busy)
