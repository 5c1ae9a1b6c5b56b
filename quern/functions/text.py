"""Text primitives: column to column, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of code search.
CODE_STOP_WORDS = "the a an is are was were be been to of and or in on at by for with".split()
#: Names of one letter that are kept as tokens.
SHORT_NAMES = "i a x y z".split()


def _words(text: Column) -> Column:
    """Whole runs of letters, digits and underscores that are ASCII identifiers, of one letter if it is a short name."""
    short = "".join(SHORT_NAMES + [x.upper() for x in SHORT_NAMES])
    # a run of other kind is taken as a whole, by the second choice, and leaves the group empty
    pattern = rf"(?:([a-zA-Z_][a-zA-Z0-9_]++|[{short}])(?![\p{{L}}\p{{N}}_])|[\p{{L}}\p{{N}}_]++)"
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: w != "")


def _camel(word: Column) -> Column:
    parts = F.regexp_extract_all(word, F.lit(r"[A-Z][a-z]+|[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)"), F.lit(0))
    return F.transform(F.filter(parts, lambda p: F.length(p) > 1), F.lower)


def code_tokens(text: Column, stop_words: list[str] | None = None, dedup: bool = True) -> Column:
    """Identifiers in order of first appearance: parts of camelCase and snake_case names, then the name itself."""
    words = _words(text)

    def split(w: Column) -> Column:
        whole = F.array(F.lower(w))
        snake = F.filter(F.split(F.lower(w), "_"), lambda p: p != "")
        camel = w.rlike("[A-Z]") & w.rlike("[a-z]")
        other = F.when(camel, F.concat(_camel(w), whole)).when(w.contains("_"), F.concat(snake, whole)).otherwise(whole)
        # most words need no more than one look
        return F.when((w == F.lower(w)) & ~w.contains("_"), whole).when(w.rlike("^[A-Z][a-z]+$"), F.array(F.lower(w), F.lower(w))).otherwise(other)

    tokens = F.flatten(F.transform(words, split))
    if dedup:
        tokens = F.array_distinct(tokens)
    return F.filter(tokens, lambda t: ~t.isin(stop_words)) if stop_words else tokens


def text_tokens(text: Column, min_length: int = 2, stop_words: list[str] = CODE_STOP_WORDS) -> Column:
    """Lower-case words of ASCII letters and digits, repeats kept."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"^[a-z][a-z0-9]*$"))
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(stop_words))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain use inside a lambda would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counted(tokens: Column) -> Column:
    """(term, tf) of the different tokens, by a sort within the row."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda k: (k == 1) | (t[k - 1] != t[k - 2]))
        last = lambda s, j: F.when(j + 1 < F.size(s), s[j + 1]).otherwise(F.size(t) + 1)
        return _let(starts, lambda s: F.transform(s, lambda k, j: F.struct(t[k - 1].alias("term"), (last(s, j) - k).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return _let(F.sort_array(tokens), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(none))


def ngrams(tokens: Column, n: int) -> Column:
    def windows(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(t, i, n)))

    return _let(tokens, lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(windows(t)))


def singular(word: Column) -> Column:
    """ies to y, es and s dropped (not after another s)."""
    w = F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_\s]", "")
    n = F.length(w)
    return (
        F.when(w.endswith("ies") & (n > 3), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when(w.endswith("es") & ~w.endswith("ses") & (n > 2), F.substring(w, F.lit(1), n - 2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 1), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def condensed(text: Column, one_newline: bool = True) -> Column:
    """No blanks at line ends, at most one empty line in a row, one newline at the end (or at least one, of a text not empty)."""
    t = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    if not one_newline:
        return F.when(text == "", text).when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    return F.concat(F.regexp_replace(t, r"\n+\z", ""), F.lit("\n"))


def token_count(text: Column) -> Column:
    n = F.length(text)
    return F.when(n.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.substring(text, i + 1, F.lit(size))))


def head_tail(text: Column, head: int = 1000, tail: int = 1000) -> Column:
    n = F.length(text)
    return F.when(n <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.substring(text, n - tail + 1, F.lit(tail))))


def occurrences(text: Column, word: str) -> Column:
    """How often a literal occurs, without overlaps."""
    n = len(word)
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / n).cast("long")
