"""What only shows on larger tables: sums in another order, shuffles of what a task can count, files as one row."""

import glob
import math
import os

from pyspark.sql import functions as F

from tributary.operators import graph as gr
from tributary.operators import learned as ml
from tributary.plans import formats, more, registry, rest


def test_a_mean_is_never_below_itself(spark, monkeypatch):
    """As if summed in another order each time: a model that is compared with itself must have one cost."""
    noise = F.udf(lambda: int.from_bytes(os.urandom(3), "big") * 1e-17, "double").asNondeterministic()
    rows = spark.createDataFrame([(m, 0.4, 1, c) for m, c in (("a", 0.1), ("b", 0.2), ("c", 0.3)) for _ in range(3)], "model string, p double, pred int, seconds double")
    monkeypatch.setattr(rest, "probe", lambda s, d: rows.withColumn("seconds", F.col("seconds") + noise()))
    monkeypatch.setattr(rest, "fin", lambda df: df)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for _ in range(4):
            got = registry.QUERIES["ro22_cost_guard"](spark, "").select("small", "large").collect()
            assert sorted(map(tuple, got)) == [("a", "b"), ("a", "c"), ("b", "c")]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_grams_are_counted_where_texts_are_read(spark):
    docs = spark.createDataFrame([(k, f"Abc déf {k % 3}\x0b\n ABC x") for k in range(30)] + [(30, None), (None, "abc")], "k long, t string")
    words = ml.vocabulary(docs, "k", "t")
    plain = ml.gram_counts(docs, "k", "t").groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df >= 3")
    want = {r.gram: r.df for r in plain.collect()}
    got = {r.gram: r.idf for r in words.collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - (math.log(33 / (1 + n)) + 1)) < 1e-12 for g, n in want.items())
    found = ml.tfidf(docs, "k", "t", words)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k for r in found.collect()} == set(range(30))


def test_rows_of_one_key_are_one_document(spark):
    parts = [(1, "abc x"), (1, "abc"), (2, "abc"), (3, "abc abc"), (4, "x"), (None, "abc"), (None, "x")]
    whole = [(1, "abc x abc"), (2, "abc"), (3, "abc abc"), (4, "x"), (None, "abc x")]
    got, want = [], []
    for rows, to in ((parts, got), (whole, want)):
        docs = spark.createDataFrame(rows, "k long, t string")
        words = spark.createDataFrame([("abc", 1.0), (" x ", 2.0)], "gram string, idf double")
        to += sorted((r.k, r.gram, round(r.weight, 9)) for r in ml.tfidf(docs, "k", "t", words).collect())
        seen = ml.gram_counts(docs, "k", "t").groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df >= 3")
        assert {r.gram for r in ml.vocabulary(docs, "k", "t").collect()} == {r.gram for r in seen.collect()}
    assert got == want


def test_whole_files_hold_a_bounded_number_of_texts(spark, tmp_path, monkeypatch):
    rows = [(k, f"text\n{k}", "one" if k % 9 else None, len(f"text\n{k}")) for k in range(1300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(formats, "folder", lambda s: f"{tmp_path}/out")
    got = {r.source: r.chars for r in registry.QUERIES["sc8_whole_files"](spark, str(tmp_path)).collect()}
    assert got == {s: sum(x[3] for x in rows if x[2] == s) for s in ("one", None)}
    texts = [open(f).read().count("\x01") for f in glob.glob(f"{tmp_path}/out/*/*.txt")]
    assert sum(texts) == 1300 and max(texts) <= 500


def test_pairs_are_made_last(spark):
    """Neither shuffled nor made distinct; a source in two states is one."""
    edges = spark.createDataFrame([("a", "b", None, "seen"), ("b", "c", None, None), (None, "c", None, None)], "src string, dst string, from_state string, to_state string")
    start = spark.createDataFrame([("a", "raw"), ("a", "seen"), ("b", "raw"), (None, "raw")], "node string, state string")
    got = gr.reach_sets(edges, start, states=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {
        ("a", "a", "raw"), ("a", "a", "seen"), ("a", "b", "seen"), ("a", "c", "seen"), ("b", "b", "raw"), ("b", "c", "raw"), (None, None, "raw")}


def test_dead_ends_are_listed_once(spark, monkeypatch):
    """Words are written for nodes that edges leave; dead ends, a null one too, come from lists, here in several parts."""
    written, cut = [], gr.cut

    def counted(df, *name):
        out = cut(df, *name)
        written.append(out.count() if "bits" in out.columns else 0)
        return out

    monkeypatch.setattr(gr, "cut", counted)
    monkeypatch.setattr(gr, "LISTED", 40, raising=False)
    ends = [*range(2000, 2300), None]
    edges = [(k, 1000) for k in range(130)] + [(1000, e) for e in ends] + [(0, 2000), (3000, 2000)]
    sources = spark.range(130).select(F.col("id").alias("node"))
    got = [tuple(r) for r in gr.reach_sets(spark.createDataFrame(edges, "src long, dst long"), sources).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, e) for k in range(130) for e in (k, 1000, *ends)}
    assert sum(written) == 130 + 3


def test_keys_of_any_size_flow(spark, monkeypatch):
    """The largest key is no number of a node, so nodes go by name; results are the same."""
    for big in ((1 << 63) - 1, -7):
        rows = {"customer": [(big, "BUILDING")], "orders": [(5, big)], "lineitem": [(5, 6, 9)], "part": [(6,)]}
        schema = {"customer": "c_custkey long, c_mktsegment string", "orders": "o_orderkey long, o_custkey long", "lineitem": "l_orderkey long, l_partkey long, l_suppkey long", "part": "p_partkey long"}
        monkeypatch.setattr(more, "load", lambda s, d, t, rows=rows: s.createDataFrame(rows[t], schema[t]))
        assert [tuple(r) for r in registry.QUERIES["gx8_states"](spark, "").collect()] == [(f"c{big}", "s9", "seen")]
