"""The methods behind the operators: exact optima, finite differences, and results that change without them."""

import itertools
import random

import numpy as np
import pytest

from quern.llm import line_dedup, packing, pii, quality_crf, quality_rules
from quern.llm.corpus_queries import ORACLES, QUERIES
from tests.oracle import DATA, differences, duck


def fewest(pieces, capacity):
    """Smallest number of bins, by trying all ways."""
    best = [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= pieces[i]:
                go(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    pieces = sorted(pieces, reverse=True)
    go(0, [])
    return best[0]


def counts_of(pieces):
    return {x: pieces.count(x) for x in set(pieces)}


def test_bin_completion_finds_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        pieces = [rng.randint(3, 60) for _ in range(rng.randint(1, 13))]
        found, proven = packing.search(counts_of(pieces), 100)
        assert sorted(x for p, t in found for x in p for _ in range(t)) == sorted(pieces) and all(sum(p) <= 100 for p, _ in found)
        assert proven and sum(t for _, t in found) == fewest(pieces, 100)
    hard = {4: 1, 3: 2, 2: 3}  # best fit needs 3 bins of 8
    assert sum(t for _, t in packing.best_fit(hard, 8)) == 3 and sum(t for _, t in packing.search(hard, 8)[0]) == 2


def test_best_fit_decreasing_piece_by_piece():
    rng = random.Random(5)
    for _ in range(100):
        pieces = sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 80))), reverse=True)
        rooms = []
        for x in pieces:
            fits = [r for r in rooms if r >= x]
            r = min(fits) if fits else 50
            if fits:
                rooms.remove(r)
            rooms.append(r - x)
        got = packing.best_fit(counts_of(pieces), 50)
        assert sorted(50 - sum(p) for p, t in got for _ in range(t)) == sorted(rooms)


def test_crf_gradient_by_differences():
    rng = np.random.default_rng(2)
    cut = np.array([0, 4, 5, 5, 9])
    z, y, share = rng.normal(size=(9, 3)), rng.integers(0, 2, 9).astype(float), np.repeat([0.3, 0.5, 0.2], [4, 1, 4])
    theta = rng.normal(size=4)
    grad = quality_crf.loss(theta, z, cut, y, share)[1]
    for i in range(4):
        d = np.eye(4)[i] * 1e-6
        assert abs((quality_crf.loss(theta + d, z, cut, y, share)[0] - quality_crf.loss(theta - d, z, cut, y, share)[0]) / 2e-6 - grad[i]) < 1e-6
    # and the loss itself, by enumeration
    total = 0.0
    for a, b, w in ((0, 4, 0.3), (4, 5, 0.5), (5, 9, 0.2)):
        score = lambda v: sum((z[a + i] @ theta[:3]) * v[i] for i in range(b - a)) + sum(theta[3] * (v[i] == v[i + 1]) for i in range(b - a - 1))  # noqa: B023, E731
        total -= w * (score(y[a:b]) - np.log(sum(np.exp(score(v)) for v in itertools.product((0, 1), repeat=b - a))))
    assert abs(total - quality_crf.loss(theta, z, cut, y, share)[0]) < 1e-9


@pytest.mark.parametrize("kind, least", [("words", 0.995), ("characters", 0.98)])
def test_line_candidates_recall(kind, least):
    """Pairs at a similarity of 0.80 to 0.82: the share that has a key in common."""
    rng, hit, n = random.Random(7), 0, 0
    while n < 600:
        word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
        a = [word() for _ in range(rng.randint(15, 70))]
        b = list(a)
        if kind == "words":
            for i in rng.sample(range(len(b)), max(1, len(b) // rng.randint(12, 18))):
                b[i] = word()
            x, y = " ".join(a), " ".join(b)
        else:
            x = " ".join(a)
            y = list(x)
            for i in rng.sample(range(len(y)), max(1, len(y) // rng.randint(40, 55))):
                y[i] = rng.choice("0123456789")
            y = "".join(y)
        sx, sy = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (x, y))
        if not 0.8 <= len(sx & sy) / len(sx | sy) < 0.82:
            continue
        raw = (x + y).encode()
        own, keys = line_dedup.line_keys(np.frombuffer(raw, np.uint8), np.array([0, len(x), len(raw)]))
        hit += bool(set(keys[own == 0].tolist()) & set(keys[own == 1].tolist()))
        n += 1
    assert hit >= least * n


def test_frequent_lines_fire(spark):
    """The share of a host's documents takes lines of the given tables, and leaves documents that have others."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = quality_rules.quality_rules(docs)
    assert got.where("n_frequent_words > 0 and kept").count() > 0
    none = quality_rules.quality_rules(docs, max_documents=10**9)
    assert none.where("n_frequent_words > 0").count() == 0


def test_rows_with_nulls_are_told_apart(spark):
    rows = [(1, None, "x"), (1, "x", None), (None, "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality_rules.quality_rules(df).select("row").distinct().count() == 3


@pytest.mark.parametrize("name", ["op5_decontaminate", "op7_quality_rules", "op10_ngram_jaccard_join"])
def test_oracle(spark, name):
    sf = f"{DATA}/sf0.001"
    assert differences(QUERIES[name](spark, sf), ORACLES[name], duck(sf)) == ""


def test_pii_adds_loose_forms(spark):
    """The trees tell written loose forms from look-alikes, and the added spans are disjoint and off the base spans."""
    texts = {
        1: "Please call (415) 555-2671 or write to jane.doe (at) example.org today.",
        2: "Pay with card 4000.1234.5678.9010 now; see 1.2.3.4 for details.",
        3: "The part 415-555-2671 is missing, order 1234-5678-1234 came, version 1,2,3,4000 is out.",
        4: "a@b.org " * 3000 + "10.0.0.1 " * 3000,
    }
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    said = lambda d: {(x.split(":")[0], texts[d][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in got[d] if x}
    assert said(1) == {("phone", "(415) 555-2671"), ("email", "jane.doe (at) example.org")}
    assert said(2) == {("card", "4000.1234.5678.9010"), ("ip", "1.2.3.4")}
    assert said(3) == set() and len(got[4]) == 6000
