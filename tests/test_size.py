"""Tasks whose number follows the counted rows, so that none grows with the input."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest

from quern.operators import history as H
from quern.operators import storage

ROWS = [(k, i) for k in range(40) for i in {0, *((k * 7 + j * j) % 60 for j in range(12))}]
ROWS += [(None, 1), (1, None), (99, 5), (3, 0), (3, 0)]


def _pairs():
    groups, want = defaultdict(set), Counter()
    for k, i in ROWS:
        if None not in (k, i):
            groups[k].add(i)
    for items in groups.values():
        want.update(combinations(sorted(items), 2))
    return want


@pytest.mark.parametrize("each", [20, 300, 1_000_000])  # item 0 is in every key: at 20 pairs a task it is split
def test_pairs_follow_their_number(spark, monkeypatch, each):
    monkeypatch.setattr(H, "PAIRS", each)
    want = _pairs()
    got = H.pairs(spark.createDataFrame(ROWS, "k long, i long"), "k", "i")
    assert {(r["a"], r["b"]): r["weight"] for r in got.collect()} == dict(want)
    assert got.rdd.getNumPartitions() >= sum(want.values()) // each


def test_more_pairs_than_different_ones(spark, monkeypatch):
    monkeypatch.setattr(H, "PAIRS", 50)
    rows = [(k, i) for k in range(200) for i in range(k % 5)]
    want = Counter(p for k in range(200) for p in combinations(range(k % 5), 2))
    got = H.pairs(spark.createDataFrame(rows, "k long, i long"), "k", "i", least=2)
    assert {(r["a"], r["b"]): r["weight"] for r in got.collect()} == dict(want)


def _log(spark):
    """Twice the same id, an unknown author, a file of many changes, the same file twice in a commit."""
    commits = [(k, k % 7 if k % 11 else None, f"2001-01-{k % 28 + 1:02}", "fix it" if k % 3 else "docs") for k in range(100)] + [(5, 6, "2001-03-01", "fix")]
    changes = [(k, f, k, f) for k in range(100) for f in (0, k % 5, k % 13)] + [(None, 1, 1, 1), (500, 1, 1, 1)]
    c = spark.createDataFrame(commits, "commit_id long, author long, ts string, message string").selectExpr("commit_id", "author", "timestamp(ts) ts", "message")
    return c, spark.createDataFrame(changes, "commit_id long, file long, insertions long, deletions long")


def _tasks_of_joins(df):
    return {int(x.split(")")[0].split(",")[-1]) for x in df._jdf.queryExecution().toString().split("hashpartitioning(commit_id")[1:]}


def test_hotspots_follow_the_rows(spark, monkeypatch):
    commits, changes = _log(spark)
    monkeypatch.setattr(storage, "ROWS", 10)
    got = H.file_hotspots(commits, changes, "2001-08-01")
    assert min(_tasks_of_joins(got)) >= changes.count() // 10
    commits.createOrReplaceTempView("c")
    changes.createOrReplaceTempView("h")
    sql = """SELECT file, count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, sum(insertions) AS added, sum(deletions) AS removed,
      count_if(startswith(message, 'fix')) AS fixes, min(ts) AS first_ts, max(ts) AS last_ts FROM c JOIN h USING (commit_id) GROUP BY 1"""
    want = spark.sql(sql)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_file_commits_follow_the_rows(spark, monkeypatch):
    commits, changes = _log(spark)
    monkeypatch.setattr(storage, "ROWS", 10)
    got = H.file_commits(commits, changes)
    assert min(_tasks_of_joins(got)) >= changes.count() // 10
    want = commits.join(changes, "commit_id").groupBy("file").agg({"ts": "max"})
    assert {r["file"]: r[1] for r in got.groupBy("file").agg({"ts": "max"}).collect()} == {r["file"]: r[1] for r in want.collect()}
    assert {r["file"]: r[1] for r in got.groupBy("file").agg({"one": "sum"}).collect()} == {f: len({k for k in range(100) if f in (0, k % 5, k % 13)}) for f in range(13)}
