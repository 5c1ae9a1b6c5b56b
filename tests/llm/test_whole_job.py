"""Inputs on which an operator did less than the whole job before."""

from collections import Counter

import numpy as np
import pytest

from quern.llm import decontaminate, html_extract, line_dedup
from tests.llm.test_brute_force import SF, Union, lower, words


@pytest.mark.parametrize("per_block", [2, 3])
def test_decontamination_blocks_keep_rows(spark, monkeypatch, per_block):
    """4 windows in blocks of 2 (even) and 3 (uneven last block), with repeated rows, repeated ids and null ids."""
    rows = [(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (1, "z"), (2, "z"), (None, "h i"), (None, "h i"), (3, None), (3, None), (4, "x y z a b c d e f g h i j k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j k"), (8, "h i"), (9, "z")], "item_id long, text string")
    whole = Counter(tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "WINDOWS_PER_BLOCK", per_block)
    assert Counter(tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()) == whole
    assert whole.total() == len(rows)


def test_decontamination_beyond_one_block(spark):
    """More windows than a real block holds, the last one uneven: one row a document, its items not split."""
    n = decontaminate.WINDOWS_PER_BLOCK + 1000
    docs = spark.createDataFrame([(1, f"w0 and w{n - 1}"), (2, "nothing"), (2, "nothing")], "doc_id long, text string")
    items = spark.range(n).selectExpr("id as item_id", "concat('w', id) as text")
    got = Counter((r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect())
    assert got == {(1, 2, 2): 1, (2, 0, 0): 2}


def sets_of(forms):
    return {x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in forms}


def near(a, b):
    return 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)


def test_line_dedup_of_every_line(spark):
    """As test_line_dedup, over all lines that hold a word."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(" ".join(w), (d, k)) for d, t in sorted(docs) for k, line in enumerate(t.split("\n")) if (w := words(lower(line)))]
    forms = sorted({x for x, _ in rows})
    sets, u = sets_of(forms), Union(forms)
    for i, a in enumerate(forms):
        for b in forms[:i]:
            if near(sets[a], sets[b]):
                u.join(a, b)
    first = {}
    for x, place in rows:
        first[u.find(x)] = min(first.get(u.find(x), place), place)
    gone = Counter(place[0] for x, place in rows if first[u.find(x)] != place)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.op6_line_dedup(spark, SF).collect()}
    assert got == {d: gone[d] for d, _ in docs}


def test_line_dedup_short_lines(spark):
    text = "Licensed under the Apache License, Version 2.0.\n}\n\n \n\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u3067\u3059\u306d\nRead more about this\n"
    other = "licensed  under the Apache License, Version 2.0.\n}\n\n \n\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u3067\u3059\u306d\nRead more about this.\nelse\nfirst"
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.deduplicated(docs).collect()}
    assert got == {1: (0, text), 2: (4, "\n \nelse\nfirst")}


def test_short_linked_lines_share_a_key():
    """Every pair of random lines of up to 50 characters at 0.8 or more is proposed, if one has fewer than SHORT shingles
    (letters hardly repeat here); and repetitive ones with equal sets."""
    rng, forms = np.random.default_rng(1), set()
    for _ in range(3000):
        base = "".join(rng.choice(list("abcdefghijklmnopqrstu \u00e9\u4eca"), rng.integers(1, 50)))
        forms.add(base)
        for _ in range(4):
            x = list(base)
            for _ in range(rng.integers(1, 4)):
                at = int(rng.choice([0, len(x), rng.integers(0, len(x) + 1)]))
                x[at : at + int(rng.integers(0, 3))] = list(rng.choice(list("abcz"), rng.integers(0, 3)))
            forms.add("".join(x))
    forms = sorted({" ".join(words(x)) for x in forms} - {""} | {"-" * n for n in (5, 9, 40, 300)})
    raw = [x.encode() for x in forms]
    own, keys = line_dedup.line_keys(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert (np.diff(own) >= 0).all()
    mine = [set(x.tolist()) for x in np.split(keys, np.searchsorted(own, np.arange(1, len(forms))))]
    sets, by_shingle, linked = sets_of(forms), {}, 0
    for i, x in enumerate(forms):
        for j in {j for g in sets[x] for j in by_shingle.get(g, ())}:
            if min(len(x), len(forms[j])) < line_dedup.SHORT + 4 and near(sets[x], sets[forms[j]]):
                linked += 1
                assert mine[i] & mine[j], (x, forms[j])
        for g in sets[x]:
            by_shingle.setdefault(g, []).append(i)
    assert linked > 1000


STORY = "<div class='entry'>" + "".join(f"<p>{'Story words go on and on here ' * 6}{i}.</p>" for i in range(5)) + "</div>"
ARTICLE = f"<article><p>{'real text ' * 30}</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"{STORY}<article><h2>Teaser</h2><p>A short blurb.</p></article>",
        f"<div class='container has-sidebar'>{STORY}</div>",
        f"<div class='post no-comments'>{STORY}</div>",
        f"<div class='page right-sidebar'>{STORY}<div class='sidebar'><p>Never shown</p></div></div>",
        f"<svg class='i'/>{STORY}<svg><text>Never shown</text></svg>",
        f"<script src='x'/>{STORY}<script>Never shown</script>",
    ],
)
def test_html_keeps_the_story(page):
    text = html_extract.extract(f"<body>{page}</body>")
    assert all(f"here {i}." in text for i in range(5)) and "Never shown" not in text


def test_html_keeps_the_article():
    for page in (f"<div class='layout with-sidebar'>{ARTICLE}<div class='sidebar'>Links</div></div>", f"<p>Loose words</p>{ARTICLE}<div class='comments'><p>{'so true ' * 200}</p></div>", f"<script/>hidden</script>{ARTICLE}"):
        assert html_extract.extract(f"<body>{page}</body>") == ("real text " * 30).strip()
