"""Shared plumbing: tables in the cluster's shared folder, Arrow slicing and vectorised word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)


# --- shared folder -------------------------------------------------------------------------------

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return f"file://{_OWN_DIR[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that `stored` wrote and nothing will read again."""
    path = getattr(df, "_quern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- Arrow ---------------------------------------------------------------------------------------


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches, column: str, max_bytes: int = 1 << 21):
    """Yield record batches cut so that `column` holds about max_bytes in each; one row may be longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = string_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


# --- words ---------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Separators: white space \x20 and \x09-\x0D; or everything in ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False
NOT_ALNUM[128:] = False


class Words:
    """Words of the texts of one slice: byte starts and ends, and `first`, the index of each text's first word (n + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separator: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        inside = ~separator[data]
        begin, end = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            full = off[1:] > off[:-1]
            begin[off[:-1][full]] = inside[off[:-1][full]]
            end[off[1:][full] - 1] = inside[off[1:][full] - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        return span_hashes(self.data[self.inside], self.end - self.start)


def span_hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Polynomial 64-bit hashes of consecutive non-empty runs of bytes."""
    at = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    power = np.multiply.accumulate(np.full(int(lens.max()), _BASE, np.uint64))
    pos = np.arange(len(data)) - np.repeat(at, lens)
    return mix(np.add.reduceat(_BYTE[data] * power[pos], at) + lens.astype(np.uint64) * _GOLD)


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring elements (it may span two texts; the caller knows where texts end).

    Runs are put together from runs of 1, 2, 4, ... elements.
    """
    if len(h) < k or not k:
        return np.zeros(0, np.uint64)
    run, length, out, done = h, 1, None, 0
    while True:
        if k & length:
            out = run if out is None else _join(out, run, done)
            done += length
        if 2 * length > k:
            return mix(out + np.array([k], np.uint64) * _GOLD)
        run = _join(run, run, length)
        length *= 2


def _join(x: np.ndarray, y: np.ndarray, at: int) -> np.ndarray:
    n = min(len(x), len(y) - at)
    return (x[:n] * _BASE) ^ (y[at : at + n] + (x[:n] >> np.uint64(32)))


def distinct_sorted(g: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each run between neighbouring cuts of g, which is changed."""
    bounds = cut.tolist()
    for x, y in zip(bounds, bounds[1:]):
        g[x:y].sort()
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[cut[:-1][np.diff(cut) > 0]] = True
    g = g[new]
    bounds = np.r_[0, np.cumsum(new)][cut].tolist()
    return [g[x:y] for x, y in zip(bounds, bounds[1:])]


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    g, n = sequence_hashes(h, k), np.diff(first)
    many = np.maximum(n - k + 1, 0)
    cut = np.r_[0, np.cumsum(many)]
    at = np.repeat(first[:-1] - cut[:-1], many) + np.arange(int(cut[-1]))
    out = distinct_sorted(g[at], cut)
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[i] = sequence_hashes(h[first[i] : first[i + 1]], int(n[i]))
    return out


def digest(values: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a sequence of 64-bit values."""
    if not len(values):
        return 0
    p = np.multiply.accumulate(np.full(len(values), _BASE, np.uint64))
    s = np.add.reduce(mix(values + _GOLD) * p)
    return int(mix(np.array([s], np.uint64) + np.array([len(values)], np.uint64)).view(np.int64)[0])


def crc_remainder(column: str, modulus: int):
    """crc32(id as text) mod modulus, as a column; null ids give null."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string")) % modulus
