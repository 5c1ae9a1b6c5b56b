"""Operators against plain Python on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import decontaminate, html_extract, langid, line_dedup, ngram_join, packing, pii, quality_crf, quality_rules, signature_tree, warc
from tests.oracle import DATA, differences, duck

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


class Union:
    def __init__(self, ids):
        self.p = {x: x for x in ids}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    u, ids = Union(sets), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                u.join(a, b)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 3])
def test_ngram_join(spark, docs, block, monkeypatch):
    monkeypatch.setattr(signature_tree, "BLOCK", block)
    base = " ".join(f"w{i}" for i in range(60)).split()
    more = [(10_000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(12)] + [(20_000, " ".join(base)), (20_001, " ".join(base[:47])), (20_002, "one two"), (20_003, "ONE two")]
    rows = docs[:80] + more
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == components(rows)


def test_signature_tree_equals_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.6:
            s = sets[rng.integers(len(sets))]
            s = np.union1d(s[rng.random(len(s)) > rng.random() * 0.3], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64))
        else:
            s = np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
        sets.append(s)
    u = Union(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if signature_tree.linked(sets[i], sets[j], 75, 100):
                u.join(i, j)
    label = signature_tree.block_labels(sets, 75, 100)
    assert all((label[i] == label[j]) == (u.find(i) == u.find(j)) for i in range(len(sets)) for j in range(i))


def test_decontamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    where = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            where[tuple(w[k : k + n])].add(i)
    got = {r["doc_id"]: r for r in decontaminate.op5_decontaminate(spark, SF).collect()}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in where}:
            for k in range(len(w) - n + 1):
                if own := where.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
        assert tuple(got[d][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_decontamination_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "z"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j k"), (8, "h i"), (9, "z")], "item_id long, text string")
    whole = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.contamination(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "WINDOWS_PER_BLOCK", 2)
    assert {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.contamination(docs, items).collect()} == whole
    assert whole[1][:3] == (12, 11, 2) and whole[2][:3] == (1, 1, 1) and whole[3][0] == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok, seen, per = Tokenizer.from_file(packing.tokenizer_path()), 0, defaultdict(list)
    rows = {(r["doc_id"], r["piece"]): r for r in packing.op2_best_fit_packing(spark, SF).collect()}
    for d, t in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part, r = ids[at : at + 4096], rows[d, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(part.tobytes()))
            per[r["sequence_id"]].append((r["offset"], r["length"]))
            seen += len(part)
    for own in per.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(per) <= -(-seen // 4096) + 1


def test_bin_completion_beats_or_equals_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = Counter(rng.integers(1, 101, 60).tolist())
        found = packing.bin_completion(dict(counts), 100, 2000)
        assert Counter(x for p, t in found for x in p for _ in range(t)) == counts
        assert all(sum(p) <= 100 for p, _ in found)
        assert sum(t for _, t in found) <= sum(t for _, t in packing.best_fit(dict(counts), 100))


def test_quality_rules(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.op7_quality_rules(spark, SF).collect()}
    for d, t in docs:
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        count, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if count[tuple(w[i : i + 5])] > 1:
                cover |= set(range(i, i + 5))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want


def test_frequent_lines(spark):
    text = lambda i: "Shared   line of the host 12\n" + f"own words number {chr(97 + i) * 3} " + "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, text(i), "a") for i in range(6)] + [(10, text(0), "b"), (11, "shared line of the host 34\nx y z v", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_frequent_words"], r["kept"]) for r in quality_rules.quality_rules(df, max_documents=4).collect()}
    assert got[0] == (6, True) and got[10] == (0, True) and got[11] == (6, True)
    kept = {r["doc_id"]: r["text"] for r in quality_rules.apply_rules(df, max_documents=4).collect()}
    assert set(kept) == {0, 1, 2, 3, 4, 5, 10, 11} and kept[1].startswith("own words") and kept[10].startswith("Shared")


def test_line_dedup(spark, docs):
    rows = []
    for d, t in sorted(docs):
        for k, line in enumerate(t.split("\n")):
            w = words(lower(line))
            if len(w) >= 8:
                rows.append((" ".join(w), (d, k)))
    forms = sorted({x for x, _ in rows})
    sets = {x: {x[i : i + 5] for i in range(len(x) - 4)} for x in forms}
    u = Union(forms)
    for i, a in enumerate(forms):
        for b in forms[:i]:
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    first = {}
    for x, place in rows:
        first[u.find(x)] = min(first.get(u.find(x), place), place)
    gone = Counter(place[0] for x, place in rows if first[u.find(x)] != place)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.op6_line_dedup(spark, SF).collect()}
    assert got == {d: gone[d] for d, _ in docs}


def test_html_extraction(spark):
    page = (
        "<html><body><header><h1>Site</h1></header><ul class='menu'><li><a href='/'>Home</a></li></ul><div id=cookie-notice>We use cookies</div><article><h1>A &amp; B</h1><p>One\n  two <b>three</b>."
        "<div class='advert'>Buy now</div><p>Four&nbsp;five<br>six.<form>Name <input></form></article><section class='comments'><p>Great post, thanks a lot to you all</p></section><aside>More</aside><script>x='<p>no</p>'</script><footer>(c)</footer>"
    )
    assert html_extract.extract(page) == "A & B\n\nOne two three.\n\nFour five six."
    plain = "<body><div><ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul></div><div><p>" + "word " * 40 + "</p><p>more text here</p></div></body>"
    assert html_extract.extract(plain) == ("word " * 40).strip() + "\n\nmore text here"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>a b c</nav>") == ""
    rows = html_extract.op1_html_extraction(spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_language_id_held_out(spark):
    got = {r["doc_id"]: r for r in langid.op9_language_id(spark, f"{DATA}/sf0.01").collect()}
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in quality_crf.op4_quality_classifier(spark, f"{DATA}/sf0.01").collect()}
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    score, move, cut = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 9])
    got = quality_crf._marginals(score, move, cut)
    for a, z in zip(cut[:-1], cut[1:]):
        n, total, good = z - a, 0.0, np.zeros(z - a)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[a:z], good / total) if n else True


def test_warc_round_trip(spark):
    assert differences(warc.op8_warc(spark, SF), warc.OP8_SQL, duck(SF)) == ""
    big = "<p>é</p>" * 200
    rows = [(1, "u", big), (5, "v w\r\n", big), (3, None, big), (2, "u", "x"), (4, "u", "x"), (6, "u", None)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("revisit", 5, 1800), 3: ("revisit", 5, 1800), 5: ("response", None, 1800), 2: ("response", None, 1), 4: ("response", None, 1), 6: ("response", None, 0)}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum((2 * int(c) - 9 if c > "4" else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "phone": 9 <= len(digits) <= 15}[kind]


def test_pii_base_spans(spark, docs):
    odd = [None, "", "a@b.c.d@e.f x@y", "1.2.3.4.5 999.1.1.1 01.002.3.4", "4111 1111-1111 1111, 4111111111111112", "+1 (755) 555-3798 +12 (", "é😀 foo@bar.com 𝒳 10.0.0.1", "a@b.c_d@e.f a@.-.-", "1" * 30_000]
    rows = docs + [(90_000 + i, t) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if valid(k, m[0])] for k, p in PATTERNS.items()}
        flat = [x for k in PATTERNS for x in spans[k]]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(got[d]["spans"].split(",")) | {""}
        assert [got[d][f"n_{k}"] for k in PATTERNS] == [len(spans[k]) for k in PATTERNS]
