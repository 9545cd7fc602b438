"""Exact nearest neighbours by blocks of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import top_k


def nearest(queries: DataFrame, corpus: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(qid, cid, sim): for each query the k corpus vectors of other ids with the largest cosine, the smallest cid on ties.

    queries, corpus: id, embedding. Both are dealt to blocks of about so many vectors; a block of queries meets a block of
    the corpus as one product of two matrices, k of each row of which go on, so nothing grows with the pairs but the
    products. Vectors that are null, zero, of another length than most queries', or hold null or non-finite components
    take no part.
    """
    width = queries.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), "d").first()
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        return rows.where((F.size("v") == (width.d if width else -1)) & ~bad & F.exists("v", lambda x: x != 0))

    queries, corpus = usable(queries), usable(corpus)
    nq, nc = (-(-df.count() // block) or 1 for df in (queries, corpus))
    home = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumns({"qb": home(nq), "cb": every(nc)}).withColumn("cb", F.col("cb").cast("long"))
    right = corpus.withColumns({"qb": every(nq), "cb": home(nc)}).withColumn("qb", F.col("qb").cast("long"))

    def meet(q, c):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            rows = t["v"].combine_chunks()
            return t["id"].to_numpy(), rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        if not q.num_rows or not c.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        (qid, a), (cid, b) = matrix(q), matrix(c)
        order = np.argsort(cid, kind="stable")
        cid, b = cid[order], b[order]
        long = np.sqrt((b * b).sum(axis=1))
        out = []
        for at in range(0, len(qid), 512):
            part = a[at : at + 512]
            sim = part @ b.T / (np.sqrt((part * part).sum(axis=1))[:, None] * long)
            sim[qid[at : at + 512, None] == cid] = -np.inf
            least = np.partition(sim, -min(k, len(cid)), axis=1)[:, -min(k, len(cid))]
            for row, limit in enumerate(least):
                near = np.flatnonzero((sim[row] >= limit) & (sim[row] > -np.inf))
                near = near[np.argsort(-sim[row][near], kind="stable")[:k]]  # by cid among equals
                out.append((np.full(len(near), qid[at + row]), cid[near], sim[row][near]))
        return pa.table({name: np.concatenate(x) for name, x in zip(("qid", "cid", "sim"), zip(*out))})

    keys = ["qb", "cb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "qid long, cid long, sim double")
    return top_k(near, ["qid"], "sim", k, "cid").drop("rn")
