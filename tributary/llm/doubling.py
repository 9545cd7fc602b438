"""Prefix doubling at every position, by Spark sorts: the plain form of what suffix_dedup does at chosen positions.

Each position starts with the rank of its first eight bytes, their value. A round pairs a position's rank with that of
the position one offset on, sorts the distinct pairs, and ranks those that occur more than once anew; a position whose
pair is unique drops out. Offsets double up to the threshold. It is exact by construction, as ranks stand for sorted
bytes and never for fingerprints, but takes a row for each byte: see the README for its figures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

FIRST = 8


def _first(rows: DataFrame) -> DataFrame:
    """row, p and rank of all strings of eight bytes."""

    def run(batches):
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                for a in range(0, len(data) - FIRST + 1, 100_000):
                    part = data[a : a + 100_000 + FIRST - 1]
                    value = np.lib.stride_tricks.sliding_window_view(part, FIRST).copy().view(">u8").ravel().astype(np.uint64).view(np.int64)
                    n = len(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), pa.array(np.arange(a, a + n)), pa.array(value)], ["row", "p", "rank"])

    return rows.mapInArrow(run, "row long, p long, rank long")


def repeated_strings(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows, places): docs' doc_id and text with a number for each row, and row and p of every string of length bytes
    (16 or more) that also starts elsewhere. Null texts are empty; rows that repeat are rows of their own."""
    if length < 2 * FIRST:
        raise ValueError("prefix doubling begins with eight bytes")
    rows = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "doubling-rows")
    ranks, k = stored(_first(rows.select("row", "text")), "doubling"), FIRST
    while k < length:
        offset = min(k, length - k)
        further = ranks.select("row", (F.col("p") - offset).alias("p"), F.col("rank").alias("next"))
        pairs = stored(ranks.join(further, ["row", "p"]), "doubling-pairs")
        again = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        order = again.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
        names = stored(order.select("rank", "next", F.monotonically_increasing_id().alias("new")), "doubling-names")
        left = stored(pairs.join(names, ["rank", "next"]).select("row", "p", F.col("new").alias("rank")), "doubling")
        for old in (ranks, pairs, names):
            drop_stored(old)
        ranks, k = left, k + offset
    return rows, ranks.select("row", "p")
