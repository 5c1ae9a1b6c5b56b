"""Language identification: batched scores against a plain loop, and the drawn sample."""

import math
from collections import Counter

import numpy as np

from quern.llm import langid


def _model():
    words = {"aa": Counter({"tree": 5, "house": 3, "green": 2, "rare": 1}), "bb": Counter({"baum": 4, "haus": 6, "gruen": 2, "tree": 1})}
    return langid.Model(["aa", "bb"], words, {"aa": 3, "bb": 5})


def _plain(model, word):
    """Scores of one word, position by position."""
    if word in model.word:
        return model.table[model.word[word]]
    edged, total = f"^{word}$", np.zeros(2)
    for i in range(len(edged)):
        known = [edged[i : i + n] for n in range(5, 0, -1) if i + n <= len(edged) and edged[i : i + n] in model.gram]
        if known:
            total = total + model.table[model.gram[known[0]]]
    return total / len(edged)


def test_words_score_as_one_by_one():
    model = _model()
    words = ["tree", "trees", "hausbaum", "zzz", "q", "rare", "gruen"]
    assert np.allclose(model.of_words(words), [_plain(model, w) for w in words])
    assert model.of_words([]).shape == (0, 2)


def test_longer_grams_pay_no_back_off():
    model = _model()
    size = sum(c * (len(w) + 2 - 4) for w, c in {"tree": 5, "house": 3, "green": 2, "rare": 1}.items())
    assert math.isclose(model.table[model.gram["^tree"]][0], math.log(5.01 / (size + 1)))
    assert math.isclose(model.table[model.gram["tree"]][0], math.log(5.01 / (sum(c * max(0, len(w) - 1) for w, c in {"tree": 5, "house": 3, "green": 2, "rare": 1}.items()) + 1)) + math.log(0.4))


def test_scorer_keeps_answers_over_slices_and_resets(monkeypatch):
    model = _model()
    texts = [b"tree house", b"", b"12 34 !", "Haus, Baum.".encode(), b"tree house", b"haus12baum " * 500]
    whole = langid.Scorer(model).score(texts)
    monkeypatch.setattr(langid, "CACHE", 1)
    scorer = langid.Scorer(model)
    assert [scorer.score([t])[0] for t in texts] == whole
    assert [w[0] for w in whole] == ["aa", "und", "und", "bb", "aa", "bb"] and whole[1][1] == 0.0


def test_sample_counts_copies_once_and_keeps_rare_languages(spark):
    rows = [("en", "the same text")] * 500 + [("en", f"text number {i}") for i in range(300)] + [("xx", "only one"), ("xx", None), (None, "no label")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    drawn, per = langid.sample_of(docs, 40)
    got = drawn.collect()
    assert per == {"en": 301, "xx": 1}
    assert len(got) == len(set(got)) == 21 and ("xx", "only one") in [tuple(r) for r in got]
    assert langid.fit(docs.limit(0)).languages == ["und"]
