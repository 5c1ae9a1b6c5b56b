"""Fuzzy line deduplication by MinHash.

A line that holds a word, however short, is a set of 5-character shingles of its normal form (lower case in A-Z, white
space as one space); below 5 characters the line is its only shingle. Equal normal forms are one class. Lines are proposed
to each other in two ways:

- Short ones, of fewer than SHORT shingles, by their trims. One changed character inside a line breaks 5 shingles of either
  line, too many there for a similarity of 0.8, so a pair has one run of characters in common, and each line is that run
  with at most a fifth of its shingles cut off at its ends. All such runs of a line are keys: no pair is missed. Where runs
  of characters repeat, a pair need not have that one run: lines that hold a shingle twice also have their set, and the set
  less any one shingle, as keys. Such a pair is missed if more shingles differ, or one line holds none twice.
- Others by a one-permutation MinHash of 36 bins (empty bins borrow from the next) in 12 bands of 3. Its shingles have 8
  bytes: lines of one language share many of 5, which would propose nearly every line. At a similarity of 0.8, replaced
  words leave 0.75 of these shingles and scattered single characters 0.70, so a pair is missed with a chance of about
  0.002 or 0.007; closer ones far less. `tests/llm/test_methods.py` measures it.

Lines that could be partners of either kind have the keys of both. Proposed lines are compared exactly (Jaccard 0.8 or
more) within the group of lines that share a key, by the block join of `signature_tree`; equal groups of several keys are
compared once, and groups of any size are split into blocks. Only verified links go to the distributed union-find, and of
each component only the first line, by doc_id and line number, stays. Of lines that share no key only hashes travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _GOLD, SPACE, Words, distinct_sorted, documents, forget, mix, sequence_hashes, shuffle_width, slices, stored, string_buffers
from .components import connected_components
from .lines import Lines
from .ngram_join import BROADCAST_IDS, BUCKETED, bucketed
from .signature_tree import BLOCK, verified_links

SHINGLE, NUM, DEN = 5, 80, 100
BINS, ROWS, BAND_SHINGLE = 36, 3, 8
#: Lines of fewer shingles can differ at their ends only; and how many shingles a partner of one can have at most.
SHORT, PARTNER = 36, 43
#: Bytes of text that a Python worker handles at once.
SLICE = 1 << 18
SEEN = 500_000

_ROLL = int(_BASE) | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _ROLL, and those of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, x in enumerate((_ROLL, pow(_ROLL, -1, 1 << 64))):
            _POWERS[i] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, x, np.uint64)])
    return _POWERS


class _Runs:
    """Hashes of any runs of some bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        power, self.back = _powers(len(data) + 1)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.upto[1:])

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the runs from each x to each y."""
        return mix((self.upto[y] - self.upto[x]) * self.back[x] + (y - x).astype(np.uint64) * _GOLD)

    def all_of(self, k: int) -> np.ndarray:
        """Of every run of k bytes."""
        g = (self.upto[k:] - self.upto[:-k]) * self.back[: len(self.upto) - k]
        return (g ^ (g >> np.uint64(32))) * _SPREAD


_SPREAD = np.uint64(0x9FB21C651E98DF25)


class _Found:
    """The lines of a slice that hold a word: their normal forms one after the other and classes (hashes of those)."""

    def __init__(self, b):
        data, off = string_buffers(b.column("text"))
        w = Words(data, off, SPACE, lower=True)
        self.lines = lines = Lines(w.data, off, w)
        first, last = lines.first, lines.first + lines.count - 1
        keep = w.inside.copy()
        inner = np.ones(len(w), bool)
        inner[last] = False
        keep[w.end[:-1][inner[:-1]]] = True  # the byte behind a word that is not its line's last
        letters = np.r_[0, np.cumsum(w.end - w.start)]
        self.data = np.where(w.inside, w.data, np.uint8(32))[keep]
        self.off = np.r_[0, np.cumsum(letters[last + 1] - letters[first] + lines.count - 1)]
        self.runs = _Runs(self.data)
        self.key = self.runs.between(self.off[:-1], self.off[1:]).view(np.int64)

    def unseen(self, seen: set[int]) -> np.ndarray:
        """One line of each class that is not in `seen`, which gets them and forgets all now and then."""
        key, first = np.unique(self.key, return_index=True)
        new = np.array([k not in seen for k in key.tolist()], bool)
        if len(seen) > SEEN:
            seen.clear()
        seen.update(key[new].tolist())
        return np.sort(first[new])


def _characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the characters of UTF-8 texts, and the offsets counted in characters."""
    more = (data & 0xC0) == 0x80
    behind = np.flatnonzero(more)
    if not len(behind):
        return _BYTE[data], off
    h = _BYTE[data[~more]]
    lead = np.flatnonzero(data >= 0xC0)
    wide = np.r_[data, np.zeros(3, np.uint8)].astype(np.uint32)
    value, go = wide[lead].astype(np.uint64), np.ones(len(lead), bool)
    for k in (1, 2, 3):
        go &= (wide[lead + k] & 0xC0) == 0x80
        value |= np.where(go, wide[lead + k], 0).astype(np.uint64) << np.uint64(8 * k)
    h[lead - np.searchsorted(behind, lead)] = mix((value + np.uint64(1)) * _GOLD)
    return h, off - np.searchsorted(behind, off)


def line_shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles of non-empty UTF-8 lines, one after the other, and how many each has."""
    h, off = _characters(data, off)
    first, size = off[:-1], np.diff(off)
    count = np.maximum(size - k + 1, 1)
    g = sequence_hashes(np.concatenate([h, np.zeros(k, np.uint64)]), k)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    out = g[at]
    for i in np.flatnonzero(size < k):
        out[np.cumsum(count)[i] - 1] = sequence_hashes(h[first[i] : first[i] + size[i]], int(size[i]))[0]
    return out, count


def band_keys(runs: _Runs, off: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """(lines, bands) hashes of the bands of the MinHashes of the given lines (each of BAND_SHINGLE bytes or more)."""
    n, size = len(lines), off[lines + 1] - off[lines]
    count = size - BAND_SHINGLE + 1
    g = runs.all_of(BAND_SHINGLE)
    own = np.repeat(np.arange(n), count)
    if len(own) < len(g):
        g = g[np.repeat(off[lines] - (np.cumsum(count) - count), count) + np.arange(len(own))]
    sig = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(sig, ((g >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64) + own * BINS, g)
    sig = sig.reshape(n, BINS)
    empty = sig == np.iinfo(np.uint64).max
    for _ in range(1, BINS):
        if not empty.any():
            break
        sig = np.where(empty, np.roll(sig, -1, axis=1) + np.uint64(0x9E37), sig)
        empty = empty & np.roll(empty, -1, axis=1)
    out = np.empty((n, BINS // ROWS), np.uint64)
    for band in range(BINS // ROWS):
        h = np.full(n, band + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h ^ sig[:, band * ROWS + r])
        out[:, band] = h
    return out


def _take(data: np.ndarray, off: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ones of texts (indices in order) in the same form."""
    keep = np.zeros(len(off) - 1, bool)
    keep[chosen] = True
    size = np.diff(off)
    return data[np.repeat(keep, size)], np.r_[0, np.cumsum(size[chosen])]


def trim_keys(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every run of a line that leaves out at most a fifth of its shingles, at its ends; h are the
    hashes of the lines' characters."""
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(h), _BASE, np.uint64)])
    back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(h), pow(int(_BASE), -1, 1 << 64), np.uint64)])
    upto = np.r_[np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64)]
    depth = (np.diff(off) - SHINGLE + 1) * (DEN - NUM) // DEN
    own, keys = [], []
    for cut in range(int(depth.max(initial=-1)) + 1):
        line = np.flatnonzero(depth >= cut)
        for left in range(cut + 1):
            x, y = off[line] + left, off[line + 1] - (cut - left)
            own.append(line)
            keys.append(mix((upto[y] - upto[x]) * back[x] + (y - x).astype(np.uint64) * _GOLD))
    return np.concatenate([np.zeros(0, np.int64), *own]), np.concatenate([np.zeros(0, np.uint64), *keys])


def set_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the shingle set of lines that repeat a shingle or have too few for trims, and of that set without
    one shingle; none of lines of more than PARTNER distinct ones."""
    g, count = line_shingles(data, off)
    line = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((g, line))
    g, line = g[order], line[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (line[1:] != line[:-1])] if len(g) else np.zeros(0, bool)
    g, line = mix(g[new]), line[new]
    size = np.bincount(line, minlength=len(count))
    whole = np.add.reduceat(g, np.cumsum(size) - size)
    wanted = (size <= PARTNER) & ((size < count) | (count < NUM // (DEN - NUM)))
    one_less = (wanted & (size > NUM // (DEN - NUM)))[line]
    return np.r_[np.flatnonzero(wanted), line[one_less]], np.r_[mix(whole[wanted]), mix(whole[line[one_less]] - g[one_less])]


def _few(h: np.ndarray, off: np.ndarray, lines: np.ndarray, n: int) -> np.ndarray:
    """Those of the lines (of n shingles or more) that have at most PARTNER distinct ones among their first n."""
    width = n + SHINGLE - 1
    g = sequence_hashes(np.r_[h[(off[lines][:, None] + np.arange(width)).ravel()], np.zeros(SHINGLE - 1, np.uint64)], SHINGLE)
    g = np.sort(g.reshape(len(lines), width)[:, :n], axis=1)
    return lines[(g[:, 1:] != g[:, :-1]).sum(axis=1) < PARTNER]


def line_keys(data: np.ndarray, off: np.ndarray, runs: _Runs | None = None, lines: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(line, key), line ascending, of the given ones (all) of non-empty normal forms: lines that share a key are
    proposed to each other."""
    runs = _Runs(data) if runs is None else runs
    lines = np.arange(len(off) - 1) if lines is None else lines
    h, at = _characters(data, off)
    count = np.maximum(np.diff(at) - SHINGLE + 1, 1)[lines]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    long = lines[count >= SHORT]
    if len(long):
        bands = band_keys(runs, off, long)
        found.append((np.repeat(long, bands.shape[1]), bands.ravel()))
    short = lines[(count <= PARTNER) & (np.diff(at)[lines] >= SHINGLE)]
    if len(short):
        own, keys = trim_keys(*_take(h, at, short))
        found.append((short[own], keys))
    few = _few(h, at, lines[count > PARTNER], PARTNER + 1)
    wide = np.diff(at)[few] - SHINGLE + 1 >= 2 * PARTNER
    few = np.sort(np.r_[short, few[~wide], _few(h, at, few[wide], 2 * PARTNER)])
    if len(few):
        own, keys = set_keys(*_take(data, off, few))
        found.append((few[own], keys))
    own, keys = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(own, kind="stable")
    return own[order], keys[order]


def _bands(batches, buckets: int):
    seen: set[int] = set()
    for b in slices(batches, "text", SLICE):
        found = _Found(b)
        new = found.unseen(seen)
        if len(new):
            own, keys = line_keys(found.data, found.off, found.runs, new)
            yield from bucketed(found.key, np.zeros(len(found.key), np.uint32), own, keys, buckets)


def _line_rows(batches):
    for b in slices(batches, "text", SLICE):
        found = _Found(b)
        ids = b.column("doc_id").take(pa.array(found.lines.text))
        yield pa.record_batch([ids, pa.array(found.lines.number, pa.int64()), pa.array(found.key)], ["doc_id", "line_no", "node"])


def _groups(batches):
    """All rows of some buckets -> (comp, node, n): the n lines that share a key, for each key of two lines or more, once
    if several keys have the same lines; comp is a hash of them."""
    node, tok = [], []
    for b in batches:
        for bucket, ids, ref, t in zip(*(b.column(c).to_pylist() for c in ("bucket", "ids", "ref", "tok"))):
            node.append(np.frombuffer(ids, np.int64)[np.frombuffer(ref, np.uint16)])
            tok.append(np.frombuffer(t, np.uint32).astype(np.int64) | (bucket << 32))
    if not node:
        return
    node, tok = np.concatenate(node), np.concatenate(tok)
    order = np.argsort(tok, kind="stable")
    same = tok[order[1:]] == tok[order[:-1]]
    order = order[np.r_[same, False] | np.r_[False, same]]  # keys that occur once go early
    node, tok = node[order], tok[order]
    order = np.lexsort((node, tok))
    node, tok = node[order], tok[order]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])] if len(tok) else np.zeros(0, bool)
    node, tok = node[new], tok[new]
    start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(tok)])
    comp = mix(np.add.reduceat(mix(node.view(np.uint64) + _GOLD), start) + size.astype(np.uint64)).view(np.int64) if len(tok) else start
    _, first = np.unique(comp, return_index=True)
    first = first[size[first] > 1]
    for x in range(0, len(first), 1 << 14):
        f = first[x : x + (1 << 14)]
        n = size[f]
        at = np.repeat(start[f] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield pa.record_batch([pa.array(np.repeat(comp[f], n)), pa.array(node[at]), pa.array(np.repeat(n, n))], ["comp", "node", "n"])


def _node_bits(nodes: DataFrame, n: int) -> np.ndarray:
    """A bitmap of 16 times n bits, up to 2**28 of them, with a bit set for each of n nodes."""
    bits = 1 << min(28, max(10, (16 * n).bit_length()))
    place = F.pmod(F.col("node"), F.lit(bits))
    words = nodes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(node, {bits}) & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out


def _line_texts(batches, bits: np.ndarray):
    """(node, content) of the lines whose class has its bit set in `bits`, about once a task."""
    seen: set[int] = set()
    last = np.uint64(64 * len(bits) - 1)
    for b in slices(batches, "text", SLICE):
        found = _Found(b)
        new = found.unseen(seen)
        place = found.key[new].view(np.uint64) & last
        new = new[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        if len(new):
            line = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found.key), [None, pa.py_buffer(found.off.astype(np.int64)), pa.py_buffer(found.data)])
            yield pa.record_batch([pa.array(found.key[new]), line.take(pa.array(new)).cast(pa.binary())], ["node", "content"])


def line_sets(content) -> list[np.ndarray]:
    """The sets of 5-character shingles of a column of normal forms."""
    g, count = line_shingles(*string_buffers(content))
    return distinct_sorted(g, np.r_[0, np.cumsum(count)])


def line_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, comp) of the classes of lines that have a near copy of another form."""
    width = shuffle_width(docs.sparkSession)
    texts = docs.select("text")
    keyed = texts.mapInArrow(lambda it: _bands(it, 4 * width), BUCKETED).repartition(width, "bucket").mapInArrow(_groups, "comp long, node long, n long")
    chunks = F.ceil(F.col("n") / block).cast("long")
    keyed = keyed.dropDuplicates(["comp", "node"])
    cand = stored(keyed.select("node", "comp", F.pmod(F.xxhash64("node"), chunks).alias("chunk"), chunks.alias("chunks")), "line_candidates")
    facts = cand.agg(F.count("*").alias("n"), F.coalesce(F.max("chunks"), F.lit(0)).alias("c")).first()
    bits = _node_bits(cand, facts["n"])
    lines = texts.mapInArrow(lambda it: _line_texts(it, bits), "node long, content binary")
    lines = lines.join(F.broadcast(cand) if facts["n"] <= BROADCAST_IDS else cand, "node")
    links = stored(verified_links(lines.select("node", "comp", "chunk", "chunks", "content"), line_sets, NUM, DEN, width, facts["c"] > 1), "line_links")
    forget(cand)
    out = connected_components(links)
    forget(links)
    return out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _quern_drop): the numbers of the lines of each document that repeat an earlier line, exactly or nearly."""
    labels = line_components(docs)
    rows = stored(docs.select("doc_id", "text").mapInArrow(_line_rows, "doc_id long, line_no long, node long"), "line_rows")
    small = F.broadcast(labels) if labels.count() <= BROADCAST_IDS else labels
    grown = rows.join(small, "node", "left").select("doc_id", "line_no", F.coalesce("comp", "node").alias("label"))
    place = F.struct("doc_id", "line_no")
    groups = stored(grown.groupBy("label").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("label", "first"), "line_groups")
    gone = grown.join(groups, "label").where(~place.eqNullSafe(F.col("first")))
    drop = stored(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("_quern_drop")), "line_drops")
    for t in (labels, rows, groups):
        forget(t)
    return drop


def _clean(batches, names: list[str]):
    for b in slices(batches, "text"):
        drop, texts = b.column("_quern_drop").to_pylist(), b.column("text").to_pylist()
        removed, total = [], []
        for i, d in enumerate(drop):
            parts = (texts[i] or "").split("\n")
            total.append(len(parts) if texts[i] else 0)
            if d:
                gone = set(d)
                texts[i] = "\n".join(line for k, line in enumerate(parts) if k not in gone)
            removed.append(len(d or ()))
        cols = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        yield pa.record_batch([cols[n] if n in cols else b.column(n) for n in names], names)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without lines that repeat an earlier line, with n_lines and n_removed.

    Null texts stay null and empty ones empty. Repeated rows are one document: their lines stay or go alike. Rows with a
    null id count as one document before all others. Lines without a word are left alone. Columns of docs called n_lines or
    n_removed are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_removed")
    drop = repeated_lines(docs).withColumnRenamed("doc_id", "_quern_id")
    size = drop.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_quern_drop")), F.lit(0)).alias("k")).first()
    if 2 * size["n"] + size["k"] <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    rows = docs.join(drop, docs["doc_id"].eqNullSafe(F.col("_quern_id")), "left").select(*docs.columns, "_quern_drop")
    names = [*docs.columns, "n_lines", "n_removed"]
    schema = docs.limit(0).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(lambda it: _clean(it, names), schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")
