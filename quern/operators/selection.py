"""Choosing files, commits, factors and rules: scan filters, path factors, explanations, rule counts, sessions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- scans ---------------------------------------------------------------------------------------

#: Names that a scan leaves out, and extensions of binary files.
IGNORED = (
    ".git .svn .hg .bzr node_modules vendor bower_components __pycache__ *.pyc *.pyo .pytest_cache .mypy_cache venv .venv env .env build dist out target *.egg-info .idea .vscode "
    "*.swp *.swo .DS_Store *.log *.tmp *.temp *.cache"
).split()
BINARY = (
    ".exe .dll .so .dylib .a .o .jar .class .pyc .pyo .zip .tar .gz .bz2 .7z .rar .png .jpg .jpeg .gif .bmp .ico .svg .pdf .doc .docx .xls .xlsx .ppt .pptx .mp3 .mp4 .avi .mov .wav "
    ".ttf .otf .woff .woff2 .db .sqlite .bin .dat"
).split()


def glob_regex(pattern: str) -> str:
    """A regular expression of a shell pattern with *, ? and [...]."""
    out, i = "", 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 2)
        if c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"^(?s:{out})$"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether the path or its base name matches one of the shell patterns."""
    any_of = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return path.rlike(any_of) | base_name(path).rlike(any_of)


def included(path: Column, size: Column, include: list[str] | None = None, exclude: list[str] | None = None, largest: int | None = None) -> Column:
    """The scan's predicate: no binary extension, not too large, wanted, not unwanted, and no ignored name."""
    name = base_name(path)
    ok = ~F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*BINARY) & ~name.rlike("|".join(f"(?:{glob_regex(p)})" for p in IGNORED))
    if largest:
        ok = ok & (size <= largest)
    if include:
        ok = ok & matches(path, include)
    return ok & ~matches(path, exclude) if exclude else ok


def find_by_name(path: Column, pattern: str, case_sensitive: bool = False) -> Column:
    name = base_name(path)
    return name.rlike(glob_regex(pattern)) if case_sensitive else F.lower(name).rlike(glob_regex(pattern.lower()))


def find_by_content(content: Column, needle: str, case_sensitive: bool = False) -> Column:
    return F.coalesce(content.contains(needle) if case_sensitive else F.lower(content).contains(needle.lower()), F.lit(False))


def commits_between(commits: DataFrame, start: str, end: str, merges: bool = True) -> DataFrame:
    """Commits from start to end, both days included."""
    day = F.to_date("ts")
    out = commits.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out if merges else out.where(~F.lower("message").startswith("merge "))


def recent_commits(commits: DataFrame, n: int, changes: DataFrame | None = None, files: list | None = None) -> DataFrame:
    """(commit_id, title, day) of the n newest commits, of those that changed one of `files` if given."""
    if files is not None:
        commits = commits.join(changes.where(F.col("file").isin(*files)).select("commit_id").distinct(), "commit_id", "left_semi")
    out = commits.orderBy(F.col("ts").desc(), F.col("commit_id")).limit(n)
    return out.select("commit_id", F.split("message", "\n")[0].alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def changed_files(commits: DataFrame, changes: DataFrame, old: str, new: str) -> DataFrame:
    """Files that a commit after day `old` and up to day `new` changed."""
    day = F.to_date("ts")
    c = commits.where((day > F.lit(old).cast("date")) & (day <= F.lit(new).cast("date")))
    return changes.join(c.select("commit_id"), "commit_id", "left_semi").select("file").distinct()


# --- factors -------------------------------------------------------------------------------------

#: The first name found in a part of the path adds its weight.
ARCHITECTURE = {"api": 0.2, "controller": 0.2, "service": 0.2, "model": 0.15, "handler": 0.2, "core": 0.25, "main": 0.25, "lib": 0.15, "src": 0.15, "util": 0.1, "helper": 0.1, "config": 0.15}
#: By task, names that raise a file, scores with and without them, names that lower it, and by how much.
TYPES = {
    "test": (["test", "spec", "_test", ".test"], 1.0, 0.3, [], 1.0),
    "debug": (["error", "exception", "log", "debug", "trace"], 0.9, 0.5, [], 1.0),
    "feature": (["impl", "service", "handler", "controller", "api"], 0.8, 0.5, ["test", "spec"], 0.3),
    "refactor": ([], 0.7, 0.7, ["test"], 0.4),
}


def _contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def path_structure(path: Column, keywords: list[str], task: str) -> Column:
    low = F.lower(path)
    parts = F.size(F.split(path, "/"))
    score = sum((F.when(low.rlike(rf"(^|/)[^/]*{re.escape(k.lower())}"), 0.3).otherwise(0.0) for k in keywords), F.lit(0.0))
    weight = F.lit(0.0)
    for name, w in reversed(ARCHITECTURE.items()):
        weight = F.when(low.contains(name), w).otherwise(weight)
    score, tests = score + weight, _contains_any(low, ["test", "spec"])
    score = score + F.when(tests, 0.5).otherwise(0.0) if task == "test" else F.when(tests, score * 0.5).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - F.greatest(F.lit(0), parts - 4) * 0.05))


def complexity_relevance(cyclomatic: Column, task: str) -> Column:
    if task == "refactor":
        got = F.when(cyclomatic > 20, 1.0).when(cyclomatic > 10, 0.8).when(cyclomatic > 5, 0.5).otherwise(0.2)
    elif task == "debug":
        got = F.when(cyclomatic > 15, 0.8).when(cyclomatic > 10, 0.6).otherwise(0.4)
    else:
        got = F.lit(0.5)
    return F.when(cyclomatic.isNull(), 0.5).otherwise(got)


def type_relevance(path: Column, task: str) -> Column:
    if task not in TYPES:
        return F.lit(0.5)
    names, hit, miss, off, penalty = TYPES[task]
    low = F.lower(path)
    score = F.when(_contains_any(low, names), hit).otherwise(miss) if names else F.lit(miss)
    return F.when(_contains_any(low, off), score * penalty).otherwise(score) if off else score


def author_relevance(authors: Column, prompt: str) -> Column:
    """1 if a file's author is named in the prompt; 0.5 if not, or if no author is known."""
    return F.when(F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.lit(prompt.lower()).contains(F.lower(a))), 1.0).otherwise(0.5)


def depth_score(depth: Column) -> Column:
    """1 at the root, less with each step of the dependency tree; 0.5 where it is unknown (-1)."""
    return F.when(depth < 0, 0.5).otherwise(F.greatest(F.lit(0.2), 1 - depth * 0.2))


def contributions(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, factor, value, contribution, percent, place) of the factors that add to a row's score, largest first."""
    cells = F.array(*(F.struct(F.lit(k).alias("factor"), F.col(k).cast("double").alias("value"), (F.col(k) * w).alias("contribution")) for k, w in weights.items()))
    kept = F.filter(cells, lambda x: x["contribution"] > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["contribution"])
    order = F.array_sort(F.transform(kept, lambda x: F.struct((-x["contribution"]).alias("o"), x["factor"].alias("factor"), x["value"].alias("value"), x["contribution"].alias("contribution"))))
    out = rows.select(key, total.alias("total"), F.posexplode(order).alias("place", "x"))
    return out.select(key, "x.factor", "x.value", "x.contribution", (F.col("x.contribution") / F.col("total") * 100).alias("percent"), (F.col("place") + 1).cast("long").alias("place"))


# --- text ----------------------------------------------------------------------------------------

#: Fragments that speak for code.
CODE_SIGNS = ["def ", "class ", "function ", "import ", "from ", "const ", "var ", "let ", "return ", "if ", "else ", "for ", "while ", "switch ", "case ", "try ", "except ", "catch ", "finally "]
CODE_SIGNS += ["async ", "await ", "export ", "{", "}", "()", "=>", "[]", '"""', "'''", "@", "self.", "__init__"]


def looks_like_code(text: Column, threshold: int = 2) -> Column:
    """Whether the first ten lines hold enough of the signs."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 10), "\n")
    return sum((head.contains(s).cast("int") for s in CODE_SIGNS), F.lit(0)) >= threshold


def simple_truncate(text: Column, ratio: float, largest: int | None = None) -> Column:
    """The head of the text: up to a full stop in its last fifth, or else up to a blank, with dots."""
    n = F.floor(F.length(text) * ratio).cast("int")
    n = F.least(n, F.lit(largest)) if largest else n
    head = F.substring(text, F.lit(1), n)
    stop = n - F.instr(F.reverse(head), ".") + 1
    at_stop = (F.instr(head, ".") > 0) & (stop - 1 > n * 0.8)
    blank = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(blank >= 0, F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(text) <= n, text).when(at_stop, F.substring(head, F.lit(1), stop)).otherwise(F.concat(cut, F.lit("...")))


def first_url(text: Column) -> Column:
    """The first http(s) address, null without one."""
    got = F.regexp_extract(text, r"https?://[^\s<>\"{}|\\^`\[\]]+", 0)
    return F.when(got != "", got)


#: The task of each intent.
TASKS = {"implement": "feature", "debug": "debug", "understand": "understand", "refactor": "refactor", "test": "test", "document": "document", "review": "review", "optimize": "optimize"}
TASKS |= {"integrate": "feature", "migrate": "refactor", "configure": "configuration", "analyze": "analysis"}


def task_of(intent: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv))[intent], F.lit("general"))


# --- rules and sessions --------------------------------------------------------------------------


def injection_count(length: Column, available: Column, tokens: int = 1000, each: int = 30) -> Column:
    """How many rules to add to a text, by its length, the rules there are, and the tokens they may add."""
    base = F.when(length < 1000, 1).when(length < 5000, 2).when(length < 20000, 3).when(length < 50000, 5).otherwise(7)
    return F.least(base, available, F.lit(tokens // each)).cast("long")


def sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, roles, last_turn, active): active is the session with the highest id, as only one may be."""
    per = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max("turn").alias("last_turn"))
    newest = per.agg(F.max("conv_id").alias("newest"))
    return per.join(F.broadcast(newest)).withColumn("active", F.col("conv_id") == F.col("newest")).drop("newest")


def search_tools(tools: DataFrame, query: str) -> DataFrame:
    """Rows of (name, description) of which either holds the query, in any case."""
    q = query.lower()
    return tools.where(F.lower("name").contains(q) | F.lower("description").contains(q))


# --- selection -----------------------------------------------------------------------------------


def pinned_first(pinned: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place) of pinned rows, then found ones, each once, in the order of `place` of its table."""
    both = pinned.select(key, F.lit(0).alias("part"), "place").unionByName(found.select(key, F.lit(1).alias("part"), "place"))
    return both.groupBy(key).agg(F.min(F.struct("part", "place")).alias("at")).select(key, F.col("at.part").alias("part"), F.col("at.place").alias("place"))


def first_of_each(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")
