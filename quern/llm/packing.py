"""Best-fit packing of tokenised documents into sequences of at most 4096 tokens.

A document's ids are the tokenizer's, then an end id. Only a longer document is cut, into pieces of 4096; its last piece
may be shorter. All pieces are then packed into as few sequences as the search finds.

Pieces of one length are alike, so the search sees only how many pieces there are of each length (at most 4096 counts,
whatever the input) and works on the driver by bin completion: take the largest open length, enumerate the fillings of
the rest of its bin that no other filling dominates, and branch on them, least waste first; a filling is applied as
often as the counts allow, and in a second branch once. A branch ends where its waste leaves no hope against the
incumbent; the first incumbent is best-fit decreasing's. The search stops at the lower bound ceil(tokens / 4096), which
proves the packing best, or at its limit of steps, and then keeps the best packing found, unproven.

The pieces are numbered within their length in a distributed way (counts by task and length, then offsets) and looked up
in the list of patterns, so neither the driver nor a task ever holds the pieces of a length together.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, documents, slices, span_hashes, stored, string_buffers

CAPACITY, END = 4096, 1
NODE_LIMIT = 60_000
CACHE = 1_000_000

_TOKENIZERS: dict = {}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[_LETTER] = _MARK[48:58] = False


class Encoder:
    """Whole-text encoding put together from the ids of spans, which are kept in flat arrays by a 64-bit hash.

    A span is a run between ASCII white space, cut again where an ASCII mark follows an ASCII letter: the tokenizer's
    pre-tokens hold no white space and no letter before a mark. Its rules ignore the case of A-Z, so spans do too. Texts
    with `<|`, which opens the names of added tokens, are encoded in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = False
        names = self.tok.get_vocab()
        #: the last token of each pre-token, by id
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for x, i in names.items() if x.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the spans, one after the other, and how many each has."""
        size, got = np.zeros(len(spans), np.int64), [b""] * len(spans)
        plain = [i for i, x in enumerate(spans) if x.isalpha() and x.isascii()]
        for k in range(0, len(plain), 512):
            part = plain[k : k + 512]
            ids = np.array(self.tok.encode(b" ".join([spans[i] for i in part]).decode(), add_special_tokens=False).ids, np.uint32)
            cut = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
            if len(cut) != len(part) + 1:
                raise ValueError("a run of letters is not one pre-token of this tokenizer")
            for i, x, y in zip(part, cut[:-1].tolist(), cut[1:].tolist()):
                got[i], size[i] = ids[x:y], y - x
        odd = [i for i, x in enumerate(spans) if not (x.isalpha() and x.isascii())]
        for k in range(0, len(odd), 4096):
            part = odd[k : k + 4096]
            for i, e in zip(part, self.tok.encode_batch([spans[i].decode() for i in part], add_special_tokens=False)):
                got[i] = np.array(e.ids, np.uint32)
                size[i] = len(got[i])
        return np.concatenate(got), size

    def encode(self, column) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a string column; null counts as empty."""
        data, off = string_buffers(column)
        w = Words(data, off, SPACE, lower=True)
        cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        begin, end = np.zeros(len(data), bool), np.zeros(len(data), bool)
        begin[w.start], begin[cut] = True, True
        end[w.end - 1], end[cut - 1] = True, True
        start, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if not len(start):
            return [b""] * (len(off) - 1)
        key, where = np.unique(span_hashes(w.data[w.inside], end - start), return_inverse=True)
        if len(self.key) > CACHE:
            self._clear()
        place = np.searchsorted(self.key, key)
        new = np.ones(len(key), bool)
        new[place < len(self.key)] = self.key[place[place < len(self.key)]] != key[place < len(self.key)]
        if new.any():
            one = np.empty(len(key), np.int64)
            one[where] = np.arange(len(where))
            raw = w.data.tobytes()
            ids, size = self._ids([raw[x:y] for x, y in zip(start[one[new]].tolist(), end[one[new]].tolist())])
            at = len(self.pool) + np.cumsum(size) - size
            self.key, self.at, self.size = (np.insert(x, place[new], y) for x, y in ((self.key, key[new]), (self.at, at), (self.size, size)))
            self.pool = np.concatenate([self.pool, ids])
            place = np.searchsorted(self.key, key)
        size = self.size[place][where]
        total = np.r_[0, np.cumsum(size)]
        flat = self.pool[np.repeat(self.at[place][where] - total[:-1], size) + np.arange(total[-1])]
        edge = total[np.searchsorted(start, off)]
        out = [flat[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
        whole = data.tobytes()
        if b"<|" in whole:
            for i, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                if b"<|" in whole[x:y]:
                    out[i] = np.array(self.tok.encode(whole[x:y].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document; null and empty texts are the end id alone."""

    def run(batches):
        enc, end = encoder(path), np.array([END], "<u4").tobytes()
        for b in slices(batches, "text", 1 << 20):
            rows = ([], [], [], [], [])
            ids = b.column("doc_id").to_pylist()
            for doc, raw in zip(ids, enc.encode(b.column("text"))):
                raw = memoryview(raw + end)
                total = len(raw) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - at)
                    for col, v in zip(rows, (doc, k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]))):
                        col.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- search on counts ----------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, bins) of best-fit decreasing: pieces by falling length, each into the fullest bin that has room.

    Bins of one content are handled together: those of the least sufficient room r take r // x pieces of length x each,
    as a bin that has just taken one is the fullest while another fits.
    """
    bins: dict[int, list[list]] = {}  # room -> [pattern, how many bins]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if room not in bins:
                bisect.insort(rooms, room)
            bins.setdefault(room, []).append([pattern, n])

    for x in sorted(counts, reverse=True):
        c = counts[x]
        while c > 0:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                put(capacity, (), -(-c // (capacity // x)))
                continue
            room = rooms[at]
            pattern, n = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            k = room // x
            full = min(n, c // k)
            put(room - k * x, pattern + (x,) * k, full)
            c, n = c - full * k, n - full
            if n and 0 < c < k:  # the last pieces
                put(room - c * x, pattern + (x,) * c, 1)
                c, n = 0, n - 1
            put(room, pattern, n)
    return [(p, n) for r in rooms for p, n in bins[r] if p]


def _apply(left: dict[int, int], order: list[int], pattern: tuple[int, ...], times: int) -> None:
    """Take the pattern so many times."""
    for x in pattern:
        left[x] -= times
        if not left[x]:
            order.pop(bisect.bisect_left(order, x))


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces can be dealt out to a's so that those of each fit into it (a's and b's fall in length)."""

    def place(rest: tuple[int, ...], room: tuple[int, ...]) -> bool:
        if not rest:
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= rest[0] and r not in tried:
                tried.add(r)
                if place(rest[1:], room[:i] + (r - rest[0],) + room[i + 1 :]):
                    return True
        return False

    return sum(a) >= sum(b) and place(b, a)


def fillings(room: int, order: list[int], left: dict[int, int], slack: int, budget: list[int]) -> list[tuple[int, ...]]:
    """The undominated ways to fill `room` with at most `slack` of waste, least waste first.

    Only fillings that no further open piece fits into are enumerated, and of those that another one dominates (its pieces
    can be dealt out to the other's) none is kept: the other one can take its place in any packing. Each step of the
    enumeration takes one off budget[0]; at 0 it stops, and what it has is not all.
    """
    found: list[tuple[int, ...]] = []

    def extend(used: tuple[int, ...], r: int, top: int) -> None:
        """Pieces of lengths up to order[top] go on."""
        fits = bisect.bisect_right(order, r) - 1
        any_fits = False
        for at in range(min(top, fits), -1, -1):
            x = order[at]
            if left[x] <= used.count(x):
                continue
            any_fits = True
            if budget[0] <= 0:
                return
            budget[0] -= 1
            # all pieces from here on are at most x: what they cannot fill is waste
            extend((*used, x), r - x, at)
            if found and sum(found[-1]) == room and len(found[-1]) <= len(used) + 1:
                return  # one piece that fills what is left dominates all others with this beginning
        if not any_fits and r <= slack and all(left[x] <= used.count(x) for x in order[: fits + 1]):
            found.append(used)

    extend((), room, len(order) - 1)
    kept: list[tuple[int, ...]] = []
    for f in sorted(set(found), key=lambda f: (-sum(f), len(f))):
        if not any(_dominates(a, f) for a in kept):
            kept.append(f)
    return kept


def search(counts: dict[int, int], capacity: int, nodes: int = NODE_LIMIT) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """Patterns (lengths, bins) that pack counts (length -> pieces), and whether no packing has fewer bins.

    It is proven by the bound ceil(tokens / capacity) or by an ended search. A search that reaches `nodes` steps ends
    unproven with the best packing found, best-fit decreasing's at worst.
    """
    counts = {x: c for x, c in counts.items() if c > 0}
    total = sum(x * c for x, c in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(t for _, t in best)
    left, order, budget = dict(counts), sorted(counts), [nodes]
    path: list[tuple[tuple[int, ...], int]] = []

    def branches(waste: int):
        """Ways to fill the bin of the largest open piece: each as often as it goes, and once."""
        big = order[-1]
        slack = (best_bins - 1) * capacity - total - waste
        left[big] -= 1
        if not left[big]:
            order.pop()
        ways = fillings(capacity - big, order, left, slack, budget)
        if not left[big]:
            order.append(big)
        left[big] += 1
        for f in ways:
            pattern = (big, *f)
            most = min(left[x] // pattern.count(x) for x in set(pattern))
            for times in dict.fromkeys((most, 1)):
                yield pattern, times

    stack, waste, bins = [branches(0)] if order and best_bins > bound else [], 0, 0
    while stack and best_bins > bound and budget[0] > 0:
        pattern, times = next(stack[-1], (None, 0))
        if pattern is None:
            stack.pop()
            if path:
                pattern, times = path.pop()
                for x in pattern:
                    if not left[x]:
                        bisect.insort(order, x)
                    left[x] += times
                waste, bins = waste - (capacity - sum(pattern)) * times, bins - times
            continue
        budget[0] -= 1
        lost = waste + (capacity - sum(pattern)) * times
        if -(-(total + lost) // capacity) >= best_bins:
            continue  # with this waste no packing is better than the incumbent
        _apply(left, order, pattern, times)
        path.append((pattern, times))
        waste, bins = lost, bins + times
        if order:
            stack.append(branches(waste))
            continue
        best, best_bins = list(path), bins
        stack.append(iter(()))
    return best, best_bins <= bound or not stack


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODE_LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """The patterns of `search`."""
    return search(counts, capacity, nodes)[0]


# --- placing -------------------------------------------------------------------------------------


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: for each run of slots its end (count), first sequence, slots in a bin, and the offsets' place."""
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        at: dict[int, list[int]] = {}
        offset = 0
        for x in pattern:
            at.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in at.items():
            rows.setdefault(x, []).append((times * len(offsets), sequence, offsets))
        sequence += times
    out = {}
    for x, r in rows.items():
        base = np.cumsum([0, *[len(o) for _, _, o in r]])
        out[x] = (np.cumsum([n for n, _, _ in r]), np.array([s for _, s, _ in r]), np.array([len(o) for _, _, o in r]), base[:-1], np.array([v for _, _, o in r for v in o]))
    return out


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece.

    Every row of docs (doc_id, text) is packed, repeated rows and rows without an id or text too; other columns are
    ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path or tokenizer_path(), capacity).withColumn("task", F.spark_partition_id()), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(_slots(bin_completion(total, capacity)))
    from pyspark.sql.window import Window

    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("task", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("own", own).join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))

    def place(batches):
        table = slots.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.r_[np.flatnonzero(np.r_[True, length[order][1:] != length[order][:-1]]), len(order)] if len(order) else []
            for x, y in zip(cuts[:-1], cuts[1:]):
                rows = order[x:y]
                end, first, width, base, offsets = table[int(length[rows[0]])]
                r = rank[rows]
                run = np.searchsorted(end, r, "right")
                inner = r - np.where(run > 0, end[run - 1], 0)
                seq[rows] = first[run] + inner // width[run]
                off[rows] = offsets[base[run] + inner % width[run]]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
