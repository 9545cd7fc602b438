"""Message passing against plain loops, and following a folder over restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import messages as mp
from tributary.streaming import follow as fo


def test_messages_equal_plain_loops(spark):
    r = random.Random(4)
    units = {k: np.array([r.random() for _ in range(4)]) for k in range(30)}
    models = {k: np.array([r.random() for _ in range(4)]) for k in range(5)}
    edges = [(u, m, r.choice([r.random(), None]), r.random() < 0.7) for u in range(28) for m in range(4)] + [(0, 0, 0.5, True)] * 2 + [(99, 1, 1.0, True), (2, 77, 1.0, True)]
    frame = lambda rows, key: spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], f"{key} long, x array<double>")
    e = spark.createDataFrame(edges, "unit_id long, m long, w double, seen boolean")
    got_u, got_m = mp.pass_messages(frame(units, "unit_id"), frame(models, "m"), e, 4, 3)
    for _ in range(3):
        to_u = {k: [w * models[m] for u, m, w, seen in edges if u == k and seen and w is not None and m in models] for k in units}
        to_m = {k: [w * units[u] for u, m, w, seen in edges if m == k and seen and w is not None and u in units] for k in models}
        units = {k: (v + np.mean(to_u[k], axis=0)) / 2 if to_u[k] else v for k, v in units.items()}
        models = {k: (v + np.mean(to_m[k], axis=0)) / 2 if to_m[k] else v for k, v in models.items()}
    assert all(np.allclose(x.x, units[x.unit_id]) for x in got_u.collect()) and all(np.allclose(x.x, models[x.m]) for x in got_m.collect())
    assert got_u.count() == 30 and got_m.count() == 5
    held = {(u, m): units[u] @ models[m] for u, m, _, seen in edges if not seen}
    assert {(x.unit_id, x.m): pytest.approx(x.score) for x in mp.link_scores(got_u, got_m, e, 4).collect()} == held


def test_held_out_edges_do_not_leak_and_are_predicted(spark):
    """Links follow hidden groups; predictions of held-out edges see them, and changing held-out weights changes nothing."""
    r = random.Random(6)
    rows = [(u, m, 1.0 if u % 2 == m % 2 else -1.0, int(u % 2 == m % 2), r.random() < 0.7) for u in range(120) for m in range(8)]
    e = spark.createDataFrame(rows, "unit_id long, m long, w double, right int, seen boolean")
    start = lambda n, key: spark.createDataFrame([(k, [1.0 if k % 2 else -1.0, r.random()]) for k in range(n)], f"{key} long, x array<double>")
    u0, m0 = start(120, "unit_id"), start(8, "m")
    u, m = mp.pass_messages(u0, m0, e, 2)
    other, _ = mp.pass_messages(u0, m0, e.withColumn("w", F.when(F.col("seen"), F.col("w")).otherwise(9.0)), 2)
    same = {x.unit_id: list(x.x) for x in u.collect()}
    assert {x.unit_id: list(x.x) for x in other.collect()} == same
    got = mp.predicted_links(u, m, e, 2, "right").collect()
    assert len(got) == sum(not x[4] for x in rows) and np.mean([(x.prob > 0.5) == x.right for x in got]) > 0.95


def test_following_over_three_drops_and_a_restart(spark, tmp_path):
    top = f"file://{tmp_path}"
    drops = [[("a", 1), ("b", 2)], [("a", 3)], [("b", 5), ("c", 7)]]
    put = lambda rows: spark.createDataFrame(rows, "k string, v long").write.mode("append").parquet(f"{top}/log")
    put(drops[0])
    plan = lambda: spark.readStream.schema("k string, v long").parquet(f"{top}/log").groupBy("k").agg(F.sum("v").alias("v"))
    run = lambda until=None: fo.follow(plan(), fo.overwritten_by_epoch(f"{top}/out"), f"{top}/c", f"{top}/done", f"{top}/failed", "update", "200 milliseconds", until)
    assert run(until=lambda: True) is False
    put(drops[1])
    looks = []

    def once_more():
        looks.append(1)
        if len(looks) == 2:  # while it runs, the last drop comes and then the flag
            put(drops[2])
            spark.range(1).write.csv(f"{top}/done")
        return False

    assert run(once_more) is True
    got = {x.k: x.v for x in fo.latest(spark, f"{top}/out", ["k"], plan().schema).collect()}
    assert got == {"a": 4, "b": 7, "c": 7}
    spark.range(1).write.csv(f"{top}/failed")
    with pytest.raises(fo.Failed):
        run()
