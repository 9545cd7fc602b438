"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Equal vectors of a label are one node with a multiplicity. Each tree sends a node down random splits; close to a split
it goes to both sides. Nodes that meet in a leaf are compared exactly (cosine in double precision) inside the leaf, and
a leaf gives one row for each node (links counted) and one edge to its smallest neighbour, never pairs. A pair that
meets in several leaves counts in the first of them: each node carries the numbers of its earlier leaves. A leaf above
``BLOCK`` nodes is dealt out in pairs of blocks.

The splits are fitted on at most ``SAMPLE`` vectors; each level of a tree has one direction, and its nodes thresholds,
the sample's medians, while the sample reaches. All vectors are indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored, table

COSINE, TREES, SPILL, LEAF, BLOCK = 0.93, 4, 0.03, 2048, 2048
#: Vectors that the splits are fitted on at most, those with the smallest hash.
SAMPLE = 32_768
#: Levels with thresholds of their own for each node; deeper ones have one for the level.
OWN_LEVELS = 11


class Forest:
    """Trees for unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 3):
        """sample: (vectors, dimension); where it is empty the thresholds are 0, the middle of all directions."""
        self.levels = max(0, int(np.ceil(np.log2(max(rows, 1) / LEAF))))
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(TREES, self.levels, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts: list[list[np.ndarray]] = []
        for t in range(TREES):
            code, cuts = np.zeros(len(sample), np.int64), []
            for k in range(self.levels):
                at = sample @ self.directions[t, k]
                middle = float(np.median(at)) if len(at) else 0.0
                own = np.full(1 << k if k < OWN_LEVELS else 1, middle)
                if k < OWN_LEVELS and len(at):
                    order = np.argsort(code, kind="stable")
                    for part in np.split(order, np.nonzero(np.diff(code[order]))[0] + 1):
                        own[code[part[0]]] = np.median(at[part])
                cuts.append(own)
                code = code * 2 + (at > (own[code] if k < OWN_LEVELS else middle))
            self.cuts.append(cuts)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers (tree and leaf) of all leaves that they fall into, by row and number."""
        rows, numbers = [], []
        for t in range(TREES):
            row, code = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for k in range(self.levels):
                at = unit @ self.directions[t, k]
                away = at[row] - (self.cuts[t][k][code] if k < OWN_LEVELS else self.cuts[t][k][0])
                right = away > 0
                near = np.nonzero(np.abs(away) < SPILL)[0]
                row, code = np.concatenate([row, row[near]]), np.concatenate([code * 2 + right, code[near] * 2 + ~right[near]])
            rows.append(row)
            numbers.append(code | t << 48)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        order = np.lexsort((number, row))
        return row[order], number[order]


def _unit(x: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def compare(node: np.ndarray, weight: np.ndarray, unit: np.ndarray, side: np.ndarray, sets: list[np.ndarray], number: int, cosine: float):
    """Links inside a leaf: for each node the weight of its neighbours not met in an earlier leaf, and the smallest node
    of its part of the leaf. side: 0 and 1 for the two blocks of a pair, of which only pairs across count, else all 0."""
    m = len(node)
    early = [s[s < number] for s in sets]
    codes, inverse = np.unique(np.concatenate(early), return_inverse=True) if early else (np.zeros(0), np.zeros(0, int))
    bits = np.zeros((m, len(codes) // 64 + 1), np.uint64)
    owner = np.repeat(np.arange(m), [len(e) for e in early])
    np.bitwise_or.at(bits, (owner, inverse // 64), np.uint64(1) << (inverse % 64).astype(np.uint64))
    links, root = np.zeros(m, np.int64), np.arange(m)
    two = bool(side.any()) and not bool(side.all())
    found_i, found_j = [], []
    for a in range(0, m, 256):
        cos = unit[a : a + 256] @ unit.T
        i, j = np.nonzero(cos >= cosine)
        i += a
        ok = i < j
        if two:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        new = ~(bits[i] & bits[j]).any(axis=1)
        links += np.bincount(i[new], weight[j[new]], m).astype(np.int64) + np.bincount(j[new], weight[i[new]], m).astype(np.int64)
        # nodes that one row links join its smallest neighbour: two links a pair are not kept
        found_i.append(i)
        found_j.append(j)
    if found_i:
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
    return links, node[root]


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Rows with a null label or a vector that is null, empty, zero or holds a null, NaN or infinite component link with
    nothing; vectors of different lengths do not link. Rows that repeat link with each other; rows of one vec_id that
    differ are vectors of their own. A null vec_id links like any other: it is kept only if its component has no vec_id,
    which is then that component's id. Other columns are not read. No rows give no rows.
    """
    spark = vectors.sparkSession

    def raw(batches):
        for b in batches:
            out = []
            for e in b.column(1).to_pylist():
                v = None
                if e and None not in e:
                    f = np.array(e, np.float64)
                    if np.isfinite(f).all() and (f != 0).any():
                        v = f.astype(np.float32).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["vec_id", "x", "label"])

    kind = vectors.schema["label"].dataType.simpleString()
    rows = stored(vectors.select("vec_id", "embedding", "label").mapInArrow(raw, f"vec_id long, x binary, label {kind}"), "vectors")
    usable = rows.where("x is not null and label is not null")
    # a node's number is given as the table is written; nothing downstream computes it again
    nodes = usable.groupBy("label", "x").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # splits are fitted for the 64 most frequent lengths; those of others stand at 0
    lengths = nodes.groupBy(F.length("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    count = {r.d: r.n for r in lengths.orderBy(F.desc("n"), "d").limit(64).collect()}
    least = min(count.values(), default=0)
    sample = [bytes(r.x) for r in nodes.orderBy(F.xxhash64("x"), "label").limit(SAMPLE).select("x").collect()]
    by_size = {d: [x for x in sample if len(x) == d] for d in count}
    forests = spark.sparkContext.broadcast({d: Forest(_unit(x) if x else np.zeros((0, d // 4)), count[d]) for d, x in by_size.items()})

    def route(batches):
        others = {}
        for b in batches:
            x = b.column(2).to_pylist()
            size = np.array([len(v) for v in x])
            for d in np.unique(size):
                own = np.nonzero(size == d)[0]
                forest = forests.value.get(int(d)) or others.get(int(d))
                if forest is None:  # a rarer length than any of the 64
                    forest = others[int(d)] = Forest(np.zeros((0, int(d) // 4)), least)
                row, number = forest.leaves(_unit([x[k] for k in own]))
                begin = np.searchsorted(row, row, "left")
                take = pa.array(own[row])
                cols = [b.column(k).take(take) for k in range(4)]
                cols += [pa.array(number), pa.array([number[a:k].tobytes() for k, a in enumerate(begin.tolist())], pa.binary()), pa.array(np.full(len(row), d, np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["label", "node", "x", "weight", "leaf", "leaves", "size"])

    routed = nodes.select("label", "node", "x", "weight").mapInArrow(route, f"label {kind}, node long, x binary, weight long, leaf long, leaves binary, size int")
    routed = stored(routed, "leaves")
    key = ["size", "label", "leaf"]
    large = routed.groupBy(key).agg(F.count(F.lit(1)).alias("m")).where(f"m > {BLOCK}")
    dealt = routed.join(large, key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("side", F.col("block") > F.col("low"))

    def leaf(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        node, weight = node[order], t["weight"].to_numpy()[order]
        unit = _unit(t["x"].to_pylist())[order]
        sets = [np.frombuffer(s, np.int64) for s in t["leaves"].to_pylist()]
        links, root = compare(node, weight, unit, t["side"].to_numpy(zero_copy_only=False)[order], [sets[k] for k in order], t["leaf"][0].as_py(), cosine)
        some = (links > 0) | (root != node)
        return pa.table({"node": node[some], "links": links[some], "root": root[some]})

    columns = dealt.select(*key, "low", F.greatest("block", "other").alias("high"), "side", "node", "weight", "x", "leaves")
    met = stored(columns.groupBy(*key, "low", "high").applyInArrow(leaf, "node long, links long, root long"), "links")
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.join(links, "node", "left").join(roots, "node", "left")
    found = found.select("label", "x", "weight", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    least_id = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = rows.join(found.join(least_id, "root").withColumn("linked", F.lit(True)), ["label", "x"], "left")
    n_links = F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    kept = F.coalesce(F.col("vec_id") == component, component.isNull())
    return joined.select("vec_id", n_links, component.alias("component_id"), kept.alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
