"""Running sums, quantiles, inversions and interpolation over ranges, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import aggregates as ag
from tributary.operators import ranges as rg
from tributary.operators import ranking as rk
from tributary.operators import topk as tk


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_running_sums_equal_plain_ones(spark, ranges):
    r = random.Random(ranges)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([1.0, 2.0, 2.0, None, math.inf, -5.0]), k, r.randint(-3, 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, k long, x long").repartition(4)
    got = {t.k: (t.s, t.n) for t in rg.prefix_sums(df, ["g"], [F.desc("v"), "k"], {"s": F.col("x"), "n": F.lit(1)}, ranges).collect()}
    for g in {x[0] for x in rows}:
        s = n = 0
        for _, _, k, x in sorted((t for t in rows if t[0] == g), key=lambda t: (t[1] is None, -(t[1] or 0.0) if t[1] is not None else 0, t[2])):
            s, n = s + x, n + 1
            assert got[k] == (s, n)


def test_a_group_lies_in_many_tasks(spark):
    """One model's rows are spread: no task of the window has more than a few ranges' worth of them."""
    df = spark.range(4000).select(F.lit("one").alias("model"), "id", F.col("id").cast("double").alias("p"))
    seen = []
    held = rg.cut

    def watched(x, name):
        out = held(x, name)
        seen.append(out)
        return out

    rg.cut = watched
    try:
        assert rg.numbered(df, ["model"], [F.desc("p"), "id"], ranges=8).agg(F.sum(F.col("rn") + F.col("id"))).first()[0] == 4000 * 4000
    finally:
        rg.cut = held
    sizes = [x["count"] for x in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1200


def test_empty_and_keyless(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert rg.numbered(empty, ["g"], ["v"]).count() == 0 and rg.quantiles_by(empty, ["g"], "v", {"q": 0.5}).count() == 0
    assert rg.inversions(empty, ["v"], "v") == 0
    assert sorted(x.rn for x in rg.numbered(spark.range(7), [], ["id"]).collect()) == list(range(1, 8))


@pytest.mark.parametrize("ranges", [1, 7])
def test_quantiles_of_groups_equal_numpy(spark, ranges):
    r = np.random.default_rng(ranges)
    groups = {"a": r.normal(size=301).tolist(), "b": [1.0], None: [5.0] * 40 + r.exponential(10, 25).tolist(), "i": [-math.inf, 3.0, math.inf], "w": [-1.7e308, 1.0, 1.7e308]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None, math.nan]] + [("none", None), ("none", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"q0": 0.0, "q3": 0.3, "q5": 0.5, "q9": 0.95, "q1": 1.0}
    got = {x.g: list(x)[1:] for x in rg.quantiles_by(df, ["g"], "v", shares, ranges).collect()}
    assert got.keys() == groups.keys()
    for g in ("a", "b", None):
        assert np.allclose(got[g], np.quantile(groups[g], list(shares.values())), rtol=1e-12)
    assert got["i"][0] == -math.inf and got["i"][2] == 3.0 and got["i"][4] == math.inf


@pytest.mark.parametrize("block", [1, 4, 64, 1 << 16])
def test_inversions_equal_all_pairs(spark, block):
    r = random.Random(block)
    for n, most in ((0, 1), (1, 1), (90, 1000), (150, 12), (130, 2)):
        values = [r.randint(0, most) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(values)), "k long, v long").repartition(3)
        want = sum(values[i] > values[j] for i in range(n) for j in range(i + 1, n))
        assert rg.inversions(df, ["k"], "v", block, 5) == want


def test_kendall_equals_all_pairs_and_has_no_cap(spark):
    r = random.Random(8)
    rows = [(r.choice([None, *range(9)]), r.choice([None, *range(7)])) for _ in range(160)]
    full = [x for x in rows if None not in x]
    s = [(a > c) - (a < c) and ((a > c) - (a < c)) * ((b > d) - (b < d)) for i, (a, b) in enumerate(full) for c, d in full[:i]]
    got = rk.kendall(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().tau
    assert got == pytest.approx(sum(s) / max(sum(map(abs, s)), 1), abs=1e-12)
    n = 300_000
    big = spark.range(n).select("id", F.pmod(F.col("id") + n // 3, F.lit(n)).alias("b"))  # a rotation: a third wraps round
    wrong = (n // 3) * (n - n // 3)
    assert rk.kendall(big, "id", "b").first().tau == pytest.approx(1 - 2 * wrong / (n * (n - 1) / 2), abs=1e-12)


def test_interpolation_equals_numpy(spark):
    r = np.random.default_rng(2)
    x = np.sort(r.choice(1000, 60, replace=False)) / 10
    y = r.normal(size=60)
    grid = [-5.0, *np.linspace(-1, 120, 97).tolist(), *x[:5].tolist()]
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    got = {t.g: t.value for t in tk.interpolate(points, spark.createDataFrame([(g,) for g in grid], "g double").repartition(3)).collect()}
    assert np.allclose([got[g] for g in grid], np.interp(grid, x, y))
    assert tk.interpolate(points.limit(1), spark.createDataFrame([(0.0,), (200.0,)], "g double")).select("value").distinct().count() == 1


def test_many_classes_against_the_rest(spark):
    """100,001 classes: no side is too large."""
    n = 100_001
    df = spark.range(n).select("id", F.col("id").cast("string").alias("t"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(0).cast("string").alias("g"))
    got = ag.one_vs_rest(df, "t", "g", df.select(F.col("t").alias("class")))
    assert got.count() == n
    by = {x["class"]: x for x in got.where("class in ('0', '1', '2')").collect()}
    assert by["2"].precision == by["2"].recall == by["2"].accuracy == 1.0
    assert by["1"].recall == 0.0 and by["1"].precision is None and by["0"].precision == pytest.approx(1 / (1 + n // 2))


def test_cut_tables_can_be_cleared(spark):
    from tributary.operators import storage
    from tributary.streaming.follow import exists

    rows = storage.cut(spark.range(3), "cleared")
    assert rows.count() == 3 and exists(spark, rows._cut_path)
    storage.drop(rows)
    assert not exists(spark, rows._cut_path)
    again = storage.cut(spark.range(2), "cleared")
    storage.clear(spark)
    assert not exists(spark, again._cut_path) and not exists(spark, storage.own_dir(spark))
