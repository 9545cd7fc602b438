"""Quality rules and an isolation forest over their statistics.

Rule statistics are counted over whole texts. A forest of random splits, grown on at most ``MOST_LABELLED`` labelled
documents of good quality, gives each document a path length; documents isolated early are anomalous. The score above
which a document is rejected is calibrated on labelled documents of both kinds that the forest was not grown on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .toxicity import held_out

#: Labelled documents that the fit uses at most, those with the smallest hash of doc_id.
MOST_LABELLED = 16_384
TREES, SAMPLE, DEPTH, MARGIN = 128, 256, 10, 0.3
#: Share of good labelled documents that calibration may reject.
MOST_GOOD_LOST = 0.005
SYMBOLS = "#*$%&|<>"
#: White space as the rules have it: the blank and U+0009 to U+000D.
WHITE = re.compile("[ \t-\r]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: How many shares statistics() gives.
SHARES = 7
UPPER = bytes(range(65, 91))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(hashes: np.ndarray, k: int = 5) -> int:
    """Words inside k-word windows that occur at least twice, from the words' 64-bit hashes."""
    n = len(hashes) - k + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for j in range(k):
        window = (window ^ window >> np.uint64(29)) * _ODD + hashes[j : j + n]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + k, np.int64)
    at = np.nonzero(again)[0]
    edge[at] += 1
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[: len(hashes)] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS, and the shares that the forest sees."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at ASCII white space only
    n = len(words)
    white = sum(map(text.count, " \t\n\v\f\r"))
    chars = len(text) - white
    symbols = [text.count(c) for c in SYMBOLS]
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeat = repeated_words(hashes)
    lines = [x for x in text.split("\n") if x and WHITE.fullmatch(x) is None]
    dup = len(lines) - len(set(lines))
    counts = [n, chars, sum(symbols), dup, repeat]
    upper = len(data) - len(data.translate(None, UPPER))
    marks = sum(map(text.count, "!?.,;:"))
    digits = sum(map(text.count, "0123456789"))
    per = max(n, 1)
    shares = [sum(symbols) / per, dup / max(len(lines), 1), repeat / per, upper / max(chars, 1), text.count("!") / per, marks / per, digits / per]
    return counts, shares


class Forest:
    """Isolation trees as arrays: feature (-1: leaf), split, left child (the right one follows), path length at a leaf."""

    def __init__(self, data: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(data[rng.choice(len(data), min(SAMPLE, len(data)), replace=False)], rng) for _ in range(TREES)]
        most = max(len(t[0]) for t in self.trees)
        self.feature, self.split, self.left, self.length = (np.stack([np.pad(t[k], (0, most - len(t[k]))) for t in self.trees]) for k in range(4))
        self.usual = self._usual(min(SAMPLE, len(data)))

    @staticmethod
    def _usual(n: int) -> float:
        """Mean path length of a failed search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, data: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """Splits are drawn from the node's range and a margin around it: what lies beyond all of the sample falls to an
        empty side and is isolated there."""
        feature, split, left, length = [-1], [0.0], [0], [0.0]
        todo = [(0, data, 0)]
        while todo:
            k, own, depth = todo.pop()
            if depth >= DEPTH or len(own) <= 1:
                length[k] = depth + self._usual(len(own))
                continue
            f = int(rng.integers(data.shape[1]))
            at = rng.uniform(own[:, f].min() - MARGIN, own[:, f].max() + MARGIN)
            feature[k], split[k], left[k] = f, at, len(feature)
            for side in (own[:, f] < at, own[:, f] >= at):
                if side.any():
                    todo.append((len(feature), own[side], depth + 1))
                feature.append(-1)
                split.append(0.0)
                left.append(0)
                length.append(depth + 1.0)
        return np.array(feature), np.array(split), np.array(left), np.array(length)

    def score(self, data: np.ndarray) -> np.ndarray:
        """Anomaly, 0 to 1: 2 to the minus mean path length over the usual one."""
        if not len(data):
            return np.zeros(0)
        tree = np.arange(TREES)[:, None]
        node = np.zeros((TREES, len(data)), np.int64)
        row = np.arange(len(data))[None, :]
        for _ in range(DEPTH + 1):
            f = self.feature[tree, node]
            inner = f >= 0
            if not inner.any():
                break
            right = data[row, np.maximum(f, 0)] >= self.split[tree, node]
            node = np.where(inner, self.left[tree, node] + right, node)
        return 2 ** (-self.length[tree, node].mean(axis=0) / max(self.usual, 1e-9))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


class Judge:
    """A forest grown on every other good row, and the score from which it rejects, calibrated on the other rows.

    With a single good row it is grown on that one; with none there is no forest, and the base rules alone decide.
    """

    def __init__(self, shares: np.ndarray, good: np.ndarray):
        self.forest, self.limit = None, 2.0
        at = np.nonzero(good)[0]
        if not len(at):
            return
        self.forest = Forest(shares[at[::2]])
        own = at[1::2] if len(at) > 1 else at
        s, bad = np.sort(self.forest.score(shares[own])), np.sort(self.forest.score(shares[~good]))
        self.limit = float(np.nextafter(s[-1], 2))
        if len(bad):
            tries = np.unique(np.concatenate([s, bad]))
            lost = 1 - np.searchsorted(s, tries) / len(s)
            caught = 1 - np.searchsorted(bad, tries) / len(bad)
            ok = lost <= MOST_GOOD_LOST
            if ok.any():
                self.limit = float(tries[ok][np.argmax((caught - lost)[ok])])

    def kept(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.forest is None:
            return np.ones(len(shares), bool), np.zeros(len(shares))
        s = np.concatenate([self.forest.score(shares[k : k + 2000]) for k in range(0, len(shares), 2000)]) if len(shares) else np.zeros(0)
        return s < self.limit, s


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Judge:
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    # one text of a doc_id, however many rows it has
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")

    def run(batches):
        for b in batches:
            got = [statistics(t) for t in b.column(1).to_pylist()]
            fine = [not base_failed(c[0], c[4]) for c, _ in got]
            cols = [b.column(0), b.column(2).cast(pa.int32()), pa.array([s for _, s in got], pa.list_(pa.float64())), pa.array(fine, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "quality", "shares", "fine"])

    got = rows.mapInArrow(run, "doc_id long, quality int, shares array<double>, fine boolean").toArrow()
    order = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "quality", "shares", "fine")), strict=True))
    order = [x for x in order if x[3]]  # what the base rules reject is not the forest's to judge
    return Judge(np.array([x[2] for x in order]).reshape(len(order), SHARES), np.array([x[1] == 1 for x in order], bool))


def judge(docs: DataFrame, model: Judge) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and anomaly of every whole text.

    A null or empty text has no words and fails. Rows that repeat or have no doc_id are judged each; other columns are
    not read; no rows give no rows. A score equal to the limit rejects. A text is held whole, with its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [statistics(t) for t in b.column(1).to_pylist()]
            counts = np.array([c for c, _ in got], np.int64).reshape(len(got), len(COUNTS))
            failed = np.array([base_failed(c[0], c[4]) for c, _ in got], bool)
            kept, score = shared.value.kept(np.array([s for _, s in got]).reshape(len(got), SHARES))
            cols = [b.column(0), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(kept & ~failed), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
