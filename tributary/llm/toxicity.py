"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words and their first four and five letters, hashed. The machine adds a weight for
each term and, for each pair of terms, the inner product of their factors, so a pair (an insult and the mention of a
group, say) can weigh more than its parts. It is trained in numpy, on the driver, from at most ``MOST_LABELLED`` labelled
documents: the fit's size does not grow with the corpus. Scoring is a map over whole texts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, worker_cache

#: Labelled documents that a fit uses at most, those with the smallest hash of doc_id.
MOST_LABELLED = 16_384
SPACE, TERMS, FACTORS, THRESHOLD = 1 << 20, 4096, 8, 0.7
MAX_WORDS = 200_000
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split())


def terms_of(word: bytes) -> tuple[int, ...]:
    letters = word.decode("utf-8", "replace")
    out = [zlib.crc32(b"w" + word) % SPACE]
    for k in (4, 5):
        if len(letters) > k:
            out.append(zlib.crc32(b"p%d" % k + letters[:k].encode()) % SPACE)
    return tuple(out)


class Machine:
    """Terms in use, their weights and factors."""

    def __init__(self, terms=(), bias=-20.0, weights=(), factors=()):
        self.place = {int(t): k for k, t in enumerate(terms)}
        self.key = uuid.uuid4().hex
        self.bias, self.weights, self.factors = bias, np.asarray(weights), np.asarray(factors).reshape(-1, FACTORS)

    def active(self, text: str | None, known: dict[bytes, tuple[int, ...]]) -> list[int]:
        """Numbers of the terms in use; known remembers those of words."""
        place = self.place
        words = words_of(text)
        new = words.difference(known)
        if new:
            if len(known) > MAX_WORDS:
                known.clear()
                new = words
            for w in new:
                known[w] = tuple(place[t] for t in terms_of(w) if t in place)
        return sorted({k for w in words if known[w] for k in known[w]})

    def score(self, text: str | None, known: dict[bytes, tuple[int, ...]]) -> float:
        at = self.active(text, known)
        v = self.factors[at]
        x = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(sets: list[np.ndarray], toxic: np.ndarray, epochs: int = 60, seed: int = 7) -> Machine:
    """sets: hashed terms of each labelled document. Terms that go with the label are chosen by their odds; copies of
    one set count once."""
    unique = {(hashlib.blake2b(s, digest_size=16).digest(), int(y)): k for k, (s, y) in enumerate(zip(sets, toxic, strict=True))}
    keep = sorted(unique.values())
    sets, toxic = [sets[k] for k in keep], np.asarray(toxic)[keep].astype(float)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    if not n1 or not n0:
        return Machine(bias=-20.0 if not n1 else 20.0)
    in1, in0 = np.zeros(SPACE), np.zeros(SPACE)
    for s, y in zip(sets, toxic, strict=True):
        (in1 if y else in0)[s] += 1
    lift = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    usual = (in1 + in0) * n1 / (n1 + n0)
    beyond = (in1 - usual) / np.sqrt(usual + 1e-9)  # deviations above chance; a term may count only beside another
    worth = np.where((in1 >= 3) & ((lift >= 1.5) | (lift >= 0.7) & (beyond >= 6)), lift * np.sqrt(in1), 0)
    terms = np.argsort(-worth, kind="stable")[:TERMS]
    terms = terms[worth[terms] > 0]
    place = np.full(SPACE, -1)
    place[terms] = np.arange(len(terms))
    used = [place[s] for s in sets]
    used = [u[u >= 0] for u in used]
    at, doc = np.concatenate(used), np.repeat(np.arange(len(sets)), [len(u) for u in used])
    m = len(terms)
    rng = np.random.default_rng(seed)
    theta = [np.array(np.log(n1 / n0)), np.zeros(m), rng.normal(0, 0.05, (m, FACTORS))]
    first, second, t = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    bounds = np.searchsorted(doc, np.arange(len(sets) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for part in np.array_split(order, max(1, len(order) // 512)):
            per = bounds[part + 1] - bounds[part]
            d = np.repeat(np.arange(len(part)), per)
            pick = np.repeat(bounds[part] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            drop = rng.random(len(pick)) < 0.7  # terms are left out at random, so that one of several suffices
            d, a = d[drop], at[pick[drop]]
            bias, w, v = theta
            total = np.zeros((len(part), FACTORS))
            np.add.at(total, d, v[a])
            own = np.zeros(len(part))
            np.add.at(own, d, w[a] - 0.5 * (v[a] ** 2).sum(axis=1))
            x = bias + own + 0.5 * (total**2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - toxic[part]) / len(part)
            gw = np.bincount(a, g[d], m) + 1e-5 * w
            gv = np.zeros_like(v)
            np.add.at(gv, a, g[d, None] * (total[d] - v[a]))
            t += 1
            for k, grad in enumerate((g.sum(), gw, gv + 1e-4 * v)):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                theta[k] = theta[k] - 0.03 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return Machine(terms, float(theta[0]), theta[1], theta[2])


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Machine:
    """From whole texts of the labelled documents that are not held out, most at most."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    # one text of a doc_id, however many rows it has
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")

    def run(batches):
        known: dict[bytes, tuple] = defaultdict()
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                for w in words.difference(known):
                    known[w] = terms_of(w)
                out.append(np.unique(np.array([t for w in words for t in known[w]], np.int32)).tobytes())
                if len(known) > MAX_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2).cast(pa.int32())], ["doc_id", "terms", "toxic"])

    got = rows.mapInArrow(run, "doc_id long, terms binary, toxic int").toArrow()
    order = sorted(zip(got["doc_id"].to_pylist(), got["terms"].to_pylist(), got["toxic"].to_pylist(), strict=True))
    del got
    if not order:
        return Machine()
    return fit([np.frombuffer(t, np.int32) for _, t, _ in order], np.array([y for _, _, y in order]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.7 on): a map over whole texts.

    A null or empty text has no terms and scores by the bias alone. Rows that repeat or have no doc_id are scored each;
    columns of these two names are replaced and others pass through; no rows give no rows. A score of 0.7 is predicted 1.
    A text is held whole, with its distinct words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        m, known = shared.value, worker_cache(f"toxicity {shared.value.key}", dict)
        for b in batches:
            s = np.array([m.score(t, known) for t in b.column("text").to_pylist()])
            cols = [b.column(k) for k in range(b.num_columns)] + [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
