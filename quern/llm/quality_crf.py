"""Quality by a linear-chain conditional random field over a text's lines.

Every line is labelled good or bad from features of its own and of its neighbours. Forward-backward gives each line's
probability to be good; their mean, weighted by length, is the text's raw quality, and a logistic curve fitted on the
same labelled texts turns it into the score. Training texts lend their label to all of their lines.

Fitted on the SAMPLE labelled documents with the smallest hash (a stated bound); every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, crc_remainder, documents, slices, string_buffers
from .lines import Lines

SAMPLE, STEPS, RATE, DECAY = 6000, 150, 0.08, 1e-3

_CLASS = np.zeros((8, 256))
for _i, _chars in enumerate((b"#*$%&|<>@^~_=+\\{}[]", bytes(range(65, 91)), b"0123456789", b".,;:", b"!?", b"|", b"\"'()", bytes(range(97, 123)))):
    _CLASS[_i, list(_chars)] = 1
OWN = len(_CLASS) + 7
FEATURES = 3 * OWN + 3


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[Lines, np.ndarray]:
    """The lines that hold a word and a row of features for each."""
    w = Words(data, off, SPACE)
    lines = Lines(data, off, w)
    n = len(lines.text)
    own = np.zeros((n, OWN))
    if n:
        size = (lines.end - lines.start).astype(float)
        for i, table in enumerate(_CLASS):
            total = np.r_[0, np.cumsum(table[data])]
            own[:, i] = (total[lines.end] - total[lines.start]) / size
        h = w.hashes()
        owner = np.repeat(np.arange(n), lines.count)
        again = np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]
        own[:, -7] = np.bincount(owner, again, n) / lines.count
        key = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1)[0].astype(np.int64)
        own[:, -6] = np.bincount(key, minlength=n) / lines.count
        own[:, -5] = np.log1p(lines.count) / 5
        own[:, -4] = size / lines.count / 20
        first = lines.hashes(h)
        pair = np.lexsort((lines.number, first, lines.text))
        same = (first[pair][1:] == first[pair][:-1]) & (lines.text[pair][1:] == lines.text[pair][:-1])
        own[pair[1:][same], -3] = 1
        grams = h[:-1] * np.uint64(3) + h[1:]
        text = lines.text[owner]
        inside = np.flatnonzero(text[1:] == text[:-1])
        order = np.lexsort((grams[inside], text[inside]))
        g, t = grams[inside][order], text[inside][order]
        twice = np.r_[False, (g[1:] == g[:-1]) & (t[1:] == t[:-1])] if len(g) else np.zeros(0, bool)
        own[:, -2] = np.bincount(owner[inside[order[twice]]], minlength=n) / lines.count
        own[:, -1] = 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        chain = (lines.text[1:] == lines.text[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * chain, own[1:] * chain
    lone = np.stack([before[:, -1] == 0, after[:, -1] == 0, np.minimum(lines.number, 20) / 20], axis=1).astype(float)
    return lines, np.concatenate([own, before, after, lone], axis=1)


def _marginals(score: np.ndarray, move: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """P(good) of each line, given each line's log-odds, the 2 x 2 transition scores, and where texts begin (n + 1)."""
    ahead, back = _messages(score, move, cut)
    return 1 / (1 + np.exp(-np.clip(ahead + back, -50, 50)))


def _agreement(score: np.ndarray, move: np.ndarray, messages: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """P(line i and line i + 1 have one label) for each i of `at`: the marginals of the chain's edges."""
    a, b = messages[0][at], score[at + 1] + messages[1][at + 1]
    same = np.logaddexp(move[0, 0], a + b + move[1, 1])
    other = np.logaddexp(b + move[0, 1], a + move[1, 0])
    return 1 / (1 + np.exp(np.clip(other - same, -50, 50)))


def _messages(score: np.ndarray, move: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good of each line from it and the lines before it, and from the lines behind it."""
    ahead, behind = np.zeros(len(score)), np.zeros(len(score))
    length = np.diff(cut)
    order = np.argsort(-length, kind="stable")
    order = order[: np.count_nonzero(length)]
    if not len(order):
        return ahead, behind
    start, size = cut[:-1][order], length[order]
    longest = int(size[0])
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]  # texts with more than t lines
    forward: list[np.ndarray] = []
    for t in range(longest):
        k = live[t]
        e = score[start[:k] + t]
        if t == 0:
            a = e
        else:
            p = forward[-1][:k]
            # log-odds messages of a two-state chain
            a = e + np.logaddexp(move[0, 1], p + move[1, 1]) - np.logaddexp(move[0, 0], p + move[1, 0])
        forward.append(a)
    back = np.zeros(len(order))
    for t in range(longest - 1, -1, -1):
        k = live[t]
        m = np.zeros(k)
        if t + 1 < longest and (j := live[t + 1]):
            nxt = score[start[:j] + t + 1] + back[:j]
            m[:j] = np.logaddexp(move[1, 0], nxt + move[1, 1]) - np.logaddexp(move[0, 0], nxt + move[0, 1])
        back[:k] = m
        ahead[start[:k] + t], behind[start[:k] + t] = forward[t], m
    return ahead, behind


class Model:
    def __init__(self, mean, scale, weight, move, slope, shift):
        self.mean, self.scale, self.weight, self.move, self.slope, self.shift = mean, scale, weight, move, slope, shift

    def raw(self, x: np.ndarray, cut: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of each text; 0 for a text without lines."""
        weight = self.weight / self.scale
        p = _marginals(x @ weight - self.mean @ weight, self.move, cut)
        owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        n = len(cut) - 1
        return np.bincount(owner, p * size, n) / np.maximum(np.bincount(owner, size, n), 1)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * raw + self.shift)))


def loss(theta: np.ndarray, z: np.ndarray, cut: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood of the chains' labels and its gradient; theta is the features' weights and, last,
    the score of two neighbours with one label. share is constant in a text."""
    move = np.array([[theta[-1], 0.0], [0.0, theta[-1]]])
    score = z @ theta[:-1]
    messages = _messages(score, move, cut)
    p = 1 / (1 + np.exp(-np.clip(messages[0] + messages[1], -50, 50)))
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    chain = np.flatnonzero(owner[1:] == owner[:-1])
    agree, same = _agreement(score, move, messages, chain), y[chain] == y[chain + 1]
    grad = np.r_[z.T @ (share * (p - y)), (share[chain] * (agree - same)).sum()]
    # the partition function by the chain rule: log p(y) = sum of log p(y_i | y_i-1), each from the messages behind
    ends = np.r_[chain, -2][np.searchsorted(chain, np.arange(len(y)) - 1).clip(max=len(chain))] == np.arange(len(y)) - 1 if len(chain) else np.zeros(len(y), bool)
    odds = score + messages[1]
    prior = np.r_[0.0, np.where(y[:-1] == 1, theta[-1], -theta[-1])] if len(y) else odds
    odds = odds + np.where(ends, prior, 0.0)
    return float((share * np.logaddexp(0, np.where(y == 1, -odds, odds))).sum()), grad


def train(x: np.ndarray, cut: np.ndarray, size: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Model:
    """Weights that lessen `loss` and a ridge on the weights, by Adam, then a logistic curve over the texts' raw quality.
    Each text counts as one, and both labels alike."""
    mean, scale = x.mean(0), x.std(0)
    mean[scale < 1e-9], scale[scale < 1e-9] = 0, 1
    z = (x - mean) / scale
    owner = np.repeat(np.arange(len(label)), np.diff(cut))
    y = label[owner].astype(float)
    rate = max(1e-3, label.mean()), max(1e-3, 1 - label.mean())
    share = np.where(label == 1, 0.5 / rate[0], 0.5 / rate[1])[owner] / np.maximum(np.diff(cut), 1)[owner]
    share = share / share.sum()
    theta, m, v = np.zeros(z.shape[1] + 1), np.zeros(z.shape[1] + 1), np.zeros(z.shape[1] + 1)
    ridge = np.r_[np.full(z.shape[1], DECAY), 0.3]
    for step in range(1, steps + 1):
        grad = loss(theta, z, cut, y, share)[1] + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, scale, theta[:-1], np.array([[theta[-1], 0.0], [0.0, theta[-1]]]), 1.0, 0.0)
    raw = model.raw(x, cut, size)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # logistic calibration by Newton steps with a small ridge
        q = 1 / (1 + np.exp(-(slope * raw + shift)))
        g = np.array([((q - label) * raw).sum() + 1e-2 * slope, (q - label).sum()])
        s = q * (1 - q)
        h = np.array([[(s * raw * raw).sum() + 1e-2, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(d[0], -2, 2), shift - np.clip(d[1], -2, 2)
    model.slope, model.shift = max(slope, 1e-3), shift
    return model


def _features(b):
    data, off = string_buffers(b.column("text"))
    lines, x = line_features(data, off)
    return x, np.searchsorted(lines.text, np.arange(b.num_rows + 1)), (lines.end - lines.start).astype(float)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From (text, quality) of at most `sample` rows; None if they don't hold both labels."""

    def run(batches):
        for b in slices(batches, "text"):
            x, cut, size = _features(b)
            rows = [x[a:z].astype(np.float32).tobytes() for a, z in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([b.column("quality").cast(pa.int32()), pa.array(rows, pa.binary()), pa.array([size[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())], ["quality", "x", "size"])

    few = labelled.where("text is not null and quality is not null").select("text", "quality").withColumn("order", F.xxhash64("text")).orderBy("order", "quality").limit(sample)
    xs, sizes, labels = [], [], []
    for r in few.select("text", "quality").mapInArrow(run, "quality int, x binary, size binary").toLocalIterator():
        x = np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES)
        if len(x):
            xs.append(x)
            sizes.append(np.frombuffer(r["size"]))
            labels.append(r["quality"])
    label = np.array(labels)
    if len(set(labels)) < 2:
        return None
    return train(np.concatenate(xs).astype(float), np.cumsum([0, *map(len, xs)]), np.concatenate(sizes), label)


def quality(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs' doc_id and held_out, and (score, predicted).

    Null and empty texts have no lines and get the score of a text of bad lines only. If the labelled rows (text,
    quality) hold one label or none, every score is 0.5. Repeated rows get equal scores; of labelled rows with one text
    either label may be drawn first, smaller ones before. An empty table gives an empty one; other columns of docs are
    ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, sample))

    def run(batches):
        for b in slices(batches, "text"):
            m = model.value
            score = m.score(m.raw(*_features(b))) if m else np.full(b.num_rows, 0.5)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where((crc_remainder("doc_id", 4) != 2) & F.col("quality").isNotNull())
    # the sample is drawn among the labels, before texts move
    few = labels.select("doc_id", "quality").withColumn("order", F.xxhash64("doc_id")).orderBy("order").limit(SAMPLE).select("doc_id", "quality")
    return quality(docs, docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "quality"))
