"""Boosting on cells against boosting on rows, and what it learns."""

import math
import random

import numpy as np
import pytest

from tributary.operators import boosting as bo


def rows_of(r, n):
    out = []
    for _ in range(n):
        a, b = r.choice([None, math.nan, r.random(), r.random(), r.random()]), r.randint(0, 5)
        out.append((a, b, int(((a or 0) > 0.5) != (b > 2)) if r.random() < 0.9 else r.randint(0, 1)))
    return out


def test_trees_equal_a_fit_on_single_rows(spark):
    data = rows_of(random.Random(1), 400)
    df = spark.createDataFrame(data, "a double, b int, y int").repartition(3)
    model = bo.fit(df, ["a", "b"], "y", rounds=12, least=5)
    value = lambda x: x is not None and not math.isnan(x)
    bins = np.array([[1 + sum(e < x for e in model.edges[c]) if value(x) else 0 for c, x in zip("ab", row)] for row in data])
    y, one = np.array([row[2] for row in data], float), np.ones(len(data))
    score = np.full(len(data), np.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-score))
        plain = bo.grow(bins, p - y, p * (1 - p), one, 3, 0.1, 5, 0.0)
        assert [t[:4] for t in plain] == [t[:4] for t in tree] and np.allclose([t[4] for t in plain], [t[4] for t in tree])
        score += bo.Boosted(model.edges, 0.0, [plain]).scores(bins)
    got = model.transform(df.selectExpr("*", "monotonically_increasing_id() id")).collect()
    want = {tuple(map(str, row[:2])): 1 / (1 + math.exp(-s)) for row, s in zip(data, score)}
    assert len(got) == 400 and all(x.prob == pytest.approx(want[str(x.a), str(x.b)]) for x in got)


def test_edges_are_quantiles(spark):
    values = [random.Random(2).random() for _ in range(500)] + [0.5] * 100
    edges = bo.cuts(spark.createDataFrame([(v, 1.0) for v in values], "a double, b double"), ["a", "b"])
    parts = bo.bins_for(2) - 1
    assert np.allclose(edges["a"], sorted(set(np.quantile(values, [k / parts for k in range(1, parts)]))), rtol=1e-12) and edges["b"] == [1.0]
    assert all(bo.bins_for(d) ** d <= bo.CELLS for d in range(1, 17))


def test_it_learns_what_no_column_says_alone(spark):
    train, test = rows_of(random.Random(3), 2000), rows_of(random.Random(4), 500)
    frame = lambda rows: spark.createDataFrame(rows, "a double, b int, y int")
    model = bo.fit(frame(train), ["a", "b"], "y")
    assert len(model.trees) == 200 and max(map(len, model.trees)) <= 15
    got = model.transform(frame(test)).collect()
    assert np.mean([(x.prob > 0.5) == x.y for x in got]) > 0.85


def test_constants_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int")
    assert bo.fit(df, ["a"], "y").transform(df).first().prob > 0.99
    none = bo.fit(df.limit(0), ["a"], "y")
    assert none.trees == [] and none.transform(df).first().prob == 0.5
