"""Hierarchies and reachability by frontier joins.

Each round joins the frontier with the edges and keeps what is new; rounds are cut by a written table, so plans do not
grow and a lost executor costs one round. Only a count comes to the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered
from .storage import cut, drop, release


def reach(edges: DataFrame, sources: DataFrame, barrier: DataFrame | None = None, barrier_out: DataFrame | None = None, states: bool = False) -> DataFrame:
    """Pairs (source, node) with a path from source to node, and its length in steps; a source reaches itself in 0.

    edges: src, dst (with states: also from_state, to_state, and nodes carry a state, null edges' from_state matching
    any). Nodes of barrier are never entered; flow enters nodes of barrier_out but does not leave them.
    sources: node (with states: node, state).
    """
    key = ["node", "state"] if states else ["node"]
    if barrier is not None:
        bad = barrier.select(F.col("node").alias("dst")).distinct()
        edges = edges.join(bad, "dst", "left_anti")
        sources = sources.join(bad.withColumnRenamed("dst", "node"), "node", "left_anti")
    if barrier_out is not None:
        edges = edges.join(barrier_out.select(F.col("node").alias("src")).distinct(), "src", "left_anti")
    front = cut(sources.select(F.col("node").alias("source"), *key, F.lit(0).alias("steps")).distinct())
    seen = front
    for n in count(1):
        e = edges.withColumnRenamed("src", "node")
        step = front.drop("steps").join(e, "node")
        if states:
            step = step.where("from_state is null or from_state = state").select("source", F.col("dst").alias("node"), F.coalesce("to_state", "state").alias("state"))
        else:
            step = step.select("source", F.col("dst").alias("node"))
        front = cut(step.distinct().join(seen.drop("steps"), ["source", *key], "left_anti").withColumn("steps", F.lit(n)))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front)) if n % 16 == 0 else seen.union(front)  # so that the plan stays small


def leading_to(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) from whose end a node of sinks (node) can be reached, or which is one."""
    known = front = cut(sinks.select("node").distinct())
    while not front.isEmpty():
        before = edges.join(front.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        front = cut(before.join(known, "node", "left_anti"))
        known = known.union(front)
    return edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")


def reach_sets(
    edges: DataFrame, sources: DataFrame, barrier: DataFrame | None = None, barrier_out: DataFrame | None = None, states: bool = False,
    sinks: DataFrame | None = None, prune: bool = False,
) -> DataFrame:
    """Pairs (source, node), with states (source, node, state), as reach() has them, without lengths.

    Sources are numbered, and 64 of them are the bits of one word: what flows is (node, word, bits), words that meet at a
    node are joined by or, and only bits that are new there flow on. So a round's rows grow with edges times words and not
    with pairs, each bit is written once, in the round that it is new in, and a round's shuffles are let go after it.

    Only edges to nodes that edges leave again are walked in rounds. The others end at dead ends, to which nothing is ever
    new twice: their ends are listed by node, and the lists meet the words once, after the rounds (_dead_ends). With sinks
    only pairs with a sink as their node are given, and edges to dead ends that are none are left out; with prune, edges
    that lead to no sink are dropped first, by rounds of their own, which pays where there are many. Edges may repeat.
    """
    key = ["node", "state"] if states else ["node"]
    if barrier is not None:
        bad = barrier.select(F.col("node").alias("dst")).distinct()
        edges = edges.join(bad, "dst", "left_anti")
        sources = sources.join(bad.withColumnRenamed("dst", "node"), "node", "left_anti")
    if barrier_out is not None:
        edges = edges.join(barrier_out.select(F.col("node").alias("src")).distinct(), "src", "left_anti")
    edges = cut(edges)
    spark = edges.sparkSession
    release(spark)
    if sinks is not None and prune:
        edges, whole = cut(leading_to(edges, sinks)), edges
        drop(whole)
    marks = edges.select(F.col("src").alias("dst"), F.lit(True).alias("_on"), F.lit(sinks is None).alias("_asked"))
    if sinks is not None:
        marks = marks.union(sinks.select("node", F.lit(False), F.lit(True)))
    marks = marks.groupBy("dst").agg(F.max("_on").alias("_on"), F.max("_asked").alias("_asked"))
    known_ends = edges.join(marks, "dst", "left").withColumns({"_on": F.coalesce("_on", F.lit(False)), "_asked": F.coalesce("_asked", F.lit(sinks is None))})
    edges, whole = cut(known_ends.where("_on or _asked").drop("_asked"), "edges"), edges
    drop(whole)
    release(spark)
    # a source in several states is one bit
    starts = sources.groupBy("node").agg(F.collect_set(F.struct("state")).alias("_s")) if states else sources.select("node").distinct()
    names = cut(numbered(starts, [], ["node"], "_n").withColumns({"word": F.expr("(_n - 1) div 64"), "bit": ((F.col("_n") - 1) % 64).cast("int")}).drop("_n"))
    one, none = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")), F.lit(0).cast("long")
    first = names.select("node", "word", "bit", F.explode("_s").alias("_s")).select("node", "_s.state", "word", "bit") if states else names
    front = cut(first.groupBy(*key, "word").agg(F.bit_or(one).alias("bits")))
    known, held = front, [front]
    walked = edges.where("_on").drop("_on").withColumnRenamed("src", "node")
    for n in count(1):
        step = front.join(walked, "node")
        to = [F.col("dst").alias("node")]
        if states:
            step = step.where("from_state is null or from_state = state")
            to.append(F.coalesce("to_state", "state").alias("state"))
        both = known.select(*key, "word", "bits", none.alias("fresh")).union(step.select(*to, "word", none, "bits"))
        met = both.groupBy(*key, "word").agg(F.bit_or("bits").alias("old"), F.bit_or("fresh").alias("new"))
        front = cut(met.select(*key, "word", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits")).where("bits <> 0"))
        release(spark)
        if front.isEmpty():
            break
        known, held = known.union(front), [*held, front]
        if n % 16 == 0:  # so that the plan stays small
            known = cut(known.groupBy(*key, "word").agg(F.bit_or("bits").alias("bits")))
            for x in held:
                if x is not front:
                    drop(x)
            held = [known]
    sources64 = names.groupBy("word").agg(F.collect_list(F.struct("bit", F.col("node").alias("source"))).alias("_names"))
    ends = _dead_ends(known, edges.where("not _on").drop("_on"), sources64, names.count(), states)
    drop(edges)
    release(spark)
    if sinks is not None:
        known = known.join(sinks.select("node").distinct(), "node", "left_semi")
    return _named(known.join(sources64.hint("shuffle_hash"), "word"), key).union(_named(ends, key))


#: A node's dead ends are listed in parts of about so many.
LISTED = 10_000


def _dead_ends(known: DataFrame, edges: DataFrame, sources64: DataFrame, sources: int, states: bool) -> DataFrame:
    """(node, word, bits, _names), with states state too, of the nodes that edges to dead ends lead to from known.

    The ends are written as lists by node, a list for each deal of the ends and part of a very long one. The shuffle takes
    a list for each word that is known at its node, and not a row for each end; what meets there is joined by or in place,
    and so are the names. Deals make enough groups where words are few.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deals = max(1, -(-4 * n * 64 // max(1, sources)))
    by = ["from_state", "to_state"] if states else []
    long = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > LISTED))
    rows = edges.withColumns({"_deal": F.pmod(F.xxhash64("dst"), F.lit(deals)).cast("int"), "_part": F.lit(0).cast("long")})
    if not long.isEmpty():
        parts = F.pmod(F.xxhash64(F.lit(1), "dst"), F.floor(F.col("_many") / LISTED) + 1)
        rows = rows.drop("_part").join(long, "src", "left").withColumn("_part", F.coalesce(parts, F.lit(0))).drop("_many")
    rows = rows.groupBy("src", *by, "_deal", "_part").agg(F.collect_set("dst").alias("_to"), F.bool_or(F.col("dst").isNull()).alias("_null"))
    lists = cut(rows.select(F.col("src").alias("node"), *by, "_deal", F.expr("if(_null, array_append(_to, null), _to)").alias("_to")), "ends")
    release(spark)
    met = known.join(lists, "node")
    key = ["node"]
    if states:
        met = met.where("from_state is null or from_state = state").withColumn("state", F.coalesce("to_state", "state"))
        key.append("state")
    dealt = met.select("word", "_deal", *key[1:], "bits", "_to").repartition("word", "_deal")
    bits = dealt.withColumn("node", F.explode("_to")).groupBy("word", "_deal", *key).agg(F.bit_or("bits").alias("bits"))
    every = sources64.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return bits.join(every.hint("shuffle_hash"), ["word", "_deal"])


def _named(words: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of words' bits (key, bits, _names), made where the words are."""
    each = words.select(*key, "bits", F.explode("_names").alias("_x"))
    return each.where(F.call_function("shiftright", F.col("bits"), F.col("_x.bit")).bitwiseAND(F.lit(1)) == 1).select("_x.source", *key)


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a child-to-parent table, each node with itself at depth 0; cycles end at what is seen."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return reach(edges, nodes).select(F.col("source").alias("node"), F.col("node").alias("ancestor"), F.col("steps").alias("depth"))


def first_parent(df: DataFrame, child: str, parent: str, order: str) -> DataFrame:
    """One parent for each child, the first in order."""
    return df.groupBy(child).agg(F.min(F.struct(order, parent)).alias("_b")).select(F.col(child).alias("src"), F.col(f"_b.{parent}").alias("dst"))


def fixpoint(facts: DataFrame, rule) -> DataFrame:
    """The least set of rows (node) that holds the facts and what rule(rows) derives from them, for monotone rules."""
    known = cut(facts.distinct())
    n = known.count()
    while True:
        known = cut(known.union(rule(known)).distinct())
        m = known.count()
        if m == n:
            return known
        n = m


def spec_match(calls: DataFrame, spec: DataFrame, kind: str) -> DataFrame:
    """Call facts (package, clazz, method, arg, node) that a spec of a kind names; a null arg of the spec is any."""
    s = spec.where(F.col("kind") == kind).select("package", "clazz", "method", F.col("arg").alias("_a"))
    hit: Column = F.col("_a").isNull() | (F.col("_a") == F.col("arg"))
    return calls.join(s, ["package", "clazz", "method"]).where(hit).select(calls.columns).distinct()


def predicates(spec: DataFrame, kind: str, condition: Column, order: list[str], batch: int = 300) -> DataFrame:
    """Source text for each kind: the conditions of its rows, joined by "or", in batches of so many to a predicate.

    Gives kind, part (from 0) and body. Batches are numbered inside a kind; a batch is one row.
    """
    numbered = spec.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order)) - 1).withColumn("_c", condition)
    listed = numbered.groupBy(kind, F.floor(F.col("_n") / batch).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("_n", "_c"))).alias("_l"))
    name = F.concat(F.lit("predicate is_"), F.col(kind), F.lit("_"), F.col("part").cast("string"), F.lit("(Node n) {\n  "))
    return listed.select(kind, "part", F.concat(name, F.array_join(F.transform("_l", lambda x: x["_c"]), " or\n  "), F.lit("\n}")).alias("body"))


def unsanitised(calls: DataFrame, specs: DataFrame) -> DataFrame:
    """Call facts that any spec of kind sink names, from all packs of specs together, and none of kind sanitizer."""
    return spec_match(calls, specs, "sink").join(spec_match(calls, specs, "sanitizer"), calls.columns, "left_anti")
