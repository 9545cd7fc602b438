"""Neighbours by blocks and reachability by bits, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import graph as gr
from tributary.operators.neighbours import nearest


@pytest.mark.parametrize("block", [8192, 7])
def test_nearest_equal_all_pairs(spark, block):
    r = np.random.default_rng(block)
    vectors = {k: r.normal(size=6).round(1).tolist() for k in range(60)}
    vectors |= {100 + k: vectors[k] for k in range(12)}  # ties
    bad = {200: None, 201: [0.0] * 6, 202: [1.0] * 5, 203: [1.0, None, 0.0, 0.0, 0.0, 0.0], 204: [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 205: [float("inf"), *[1.0] * 5]}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, embedding array<double>").repartition(3)
    queries = {k: v for k, v in (vectors | bad).items() if k % 5 == 0}
    got = {}
    for x in nearest(frame(queries), frame(vectors | bad), 4, block).collect():
        got.setdefault(x.qid, []).append((x.cid, x.sim))
    assert set(got) == {k for k in queries if k not in bad}
    for q in got:
        sim = lambda c, q=q: np.dot(vectors[q], vectors[c]) / (np.linalg.norm(vectors[q]) * np.linalg.norm(vectors[c]))
        want = sorted((round(-sim(c), 9), c) for c in vectors if c != q)[:4]
        assert sorted((round(-s, 9), c) for c, s in got[q]) == want
    assert nearest(frame(queries).limit(0), frame(vectors), 3).count() == 0


def plain(edges, sources, barrier=(), out=(), sinks=None):
    step = {}
    for a, b in edges:
        if b not in barrier and a not in out:
            step.setdefault(a, set()).add(b)
    pairs = set()
    for s in set(sources) - set(barrier):
        seen, todo = {s}, [s]
        while todo:
            for b in step.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        pairs |= {(s, x) for x in seen if sinks is None or x in sinks}
    return pairs


@pytest.mark.parametrize("sinks", [None, set(range(0, 90, 4))])
def test_reach_sets_equal_plain_walks(spark, sinks):
    """150 sources are three words of bits; cycles, barriers, and sinks to prune by."""
    r = random.Random(7)
    edges = [(r.randrange(160), r.randrange(90)) for _ in range(260)] + [(1, 2), (2, 1), (5, 5)]
    sources, barrier, out = [r.randrange(160) for _ in range(150)], {3, 8, 13}, {4, 9, 14}
    nodes = lambda x: spark.createDataFrame([(k,) for k in x], "node long")
    got = gr.reach_sets(spark.createDataFrame(edges, "src long, dst long"), nodes(sources), nodes(barrier), nodes(out), sinks=nodes(sinks) if sinks else None)
    pruned = gr.reach_sets(spark.createDataFrame(edges * 2, "src long, dst long"), nodes(sources), nodes(barrier), nodes(out), sinks=nodes(sinks) if sinks else None, prune=True)
    for rows in ([tuple(x) for x in df.collect()] for df in (got, pruned)):
        assert len(rows) == len(set(rows)) and set(rows) == plain(edges, sources, barrier, out, sinks)


def test_states_flow_with_bits(spark):
    edges = spark.createDataFrame([("a", "b", None, "seen"), ("b", "c", "seen", None), ("a", "c", None, None), ("c", "d", "raw", "done")], "src string, dst string, from_state string, to_state string")
    start = spark.createDataFrame([("a", "raw"), ("b", "raw")], "node string, state string")
    want = {tuple(x) for x in gr.reach(edges, start, states=True).select("source", "node", "state").collect()}
    assert {tuple(x) for x in gr.reach_sets(edges, start, states=True).select("source", "node", "state").collect()} == want


def test_nothing_to_reach(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert gr.reach_sets(edges, spark.range(0).withColumnRenamed("id", "node")).count() == 0
    lone = gr.reach_sets(edges.limit(0), spark.range(2).select(F.col("id").alias("node")))
    assert {tuple(x) for x in lone.collect()} == {(0, 0), (1, 1)}
