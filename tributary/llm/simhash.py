"""SimHash near-duplicates, linked through segment popcounts.

A fingerprint maps to the popcounts of its 32 two-bit segments, each written as 00, 01 or 11, so that the Manhattan
distance of two such vectors is the number of bits in which they differ. It is a lower bound of the fingerprints'
Hamming distance: fingerprints at 3 or fewer bits lie at Manhattan distance 3 or less, and in one half of the segments at
1 or less. The grid range-join meets, for each half, a fingerprint's own cell with the cells within Manhattan distance 1
of the other's; then the whole vectors' distance and the exact Hamming distance decide.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, stored, table, worker_cache

SEED, WORDS, BITS = 42, 3, 3
SLICE = 100_000
LOW_BITS = 0x5555555555555555


def fingerprint_batch(texts: list[str | None]) -> np.ndarray:
    """Fingerprints (uint64) of whole texts; of texts without words zero."""
    import xxhash

    h64, join = xxhash.xxh64_intdigest, b" ".join
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        sets = zip(words, words[1:], words[2:]) if len(words) >= WORDS else [words]
        h = np.fromiter((h64(join(s), SEED) for s in sets), np.uint64)
        count = np.zeros(64, np.int64)
        for a in range(0, len(h), SLICE):
            part = h[a : a + SLICE].view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = weights[2 * count > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and fp (the 64 bits as a signed long) of every whole text; a narrow map."""
    rows = docs.select(*keys, "text")

    def run(batches):
        worker_cache("simhash", dict)  # nothing is kept here; other operators' caches go
        for b in batches:
            fp = fingerprint_batch(b.column(len(keys)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keys, "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _popcounts(fp: Column) -> Column:
    """The segments' popcounts, 0 as 00, 1 as 01, 2 as 11: the low bit is the segment's or, the high bit its and."""
    high = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(high), fp.bitwiseAND(high)
    low = F.lit(LOW_BITS)
    return either.bitwiseAND(low).bitwiseOR(F.shiftleft(both.bitwiseAND(low), 1))


def _around(cell: Column) -> Column:
    """The cell of a half and all cells at Manhattan distance 1: one segment's count, of 0 to 2, one higher or one lower."""
    near = [cell]
    for s in range(16):
        one, two = 1 << 2 * s, 2 << 2 * s
        held = cell.bitwiseAND(F.lit(one | two))
        near += [F.when(held != two | one, cell.bitwiseXOR(F.lit(one))), F.when(held != 0, cell.bitwiseXOR(F.lit(two)))]
    return F.array_compact(F.array(*near))


def links(unique: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that differ in at most so many bits (3 at most), as they are.

    Each fingerprint sends 2 rows as itself and at most 66 as a neighbour, however large its group of copies; one join
    on (half, cell), whose large cells adaptive execution can split.
    """
    if bits > 3:
        raise ValueError("two halves find up to 3 bits")
    full = unique.select("fp", _popcounts(F.col("fp")).alias("u"))
    halves = F.array(*[F.shiftrightunsigned("u", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)) for h in (0, 1)])
    own = full.select("fp", "u", F.posexplode(halves).alias("half", "cell"))
    near = own.select("half", F.explode(_around(F.col("cell"))).alias("cell"), F.col("fp").alias("fp2"), F.col("u").alias("u2"))
    manhattan = F.bit_count(F.col("u").bitwiseXOR(F.col("u2")))
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    met = own.join(near.hint("merge"), ["half", "cell"]).where((F.col("fp") < F.col("fp2")) & (manhattan <= bits) & (hamming <= bits))
    return met.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document.

    Equal fingerprints are one node, so copies never meet in pairs. A text without words has fingerprint zero, and a
    null text none; rows of one doc_id keep a row each. A row without doc_id links like any other, and a component that
    has no doc_id has none as its component_id. Other columns are not read. An empty table gives no rows. A bit that is
    set in exactly half the shingles is 0. Of a very long text the shingles' hashes are held at once, 8 bytes each.
    """
    prints = stored(fingerprints(docs), "simhash")
    unique = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-unique")
    roots = components(links(unique, bits))
    # tables of a row for each fingerprint: merged, so that none is broadcast from the driver
    by_fp = unique.join(roots.hint("merge"), unique.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = by_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(by_fp.join(least.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs with one row of each component: the one that is first by doc_id (null last), text digest and the other columns.

    Components are of fingerprints, so rows are told apart by their texts and never by doc_id: one with a null or a
    repeated doc_id goes only if another row of its own component stays. Of rows equal in all columns one is kept.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = ["doc_id", "_digest", *others]
    rows = docs.withColumn("_digest", F.sha2("text", 256))
    prints = stored(fingerprints(rows, tuple(order)), "simhash")
    unique = stored(prints.select("fp").distinct(), "simhash-unique")
    roots = components(links(unique, bits))
    by_fp = unique.join(roots.hint("merge"), unique.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("_component"))
    first = F.min(F.struct(*[x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_n{k}"), F.col(c).alias(f"_c{k}"))])).alias("_first")
    kept = prints.join(by_fp.hint("merge"), "fp").groupBy("_component").agg(first).select(*[F.col(f"_first._c{k}").alias(f"_c{k}") for k in range(len(order))])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_c{k}")) for k, c in enumerate(order)])
    return rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates(order).drop("_digest")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
