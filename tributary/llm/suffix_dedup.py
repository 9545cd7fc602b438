"""Removal of repeated byte strings by distributed prefix doubling over content-chosen positions.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Prefix doubling ranks positions
by growing prefixes and drops a position when its rank is unique. Here the first rank is that of ``length / 2`` bytes,
and it is not taken at every position: among the half-length strings inside a window of ``length`` bytes the one with
the smallest fingerprint is the window's anchor, which equal windows share. So windows fall into units (runs with one
anchor, about length / 4 of them), and Spark groups by rank pairs at growing offsets:

1. units: rank at the anchor (half the length), paired with the rank of all that the unit's windows cover. A rank that
   occurs once ends its unit; an equal pair settles all of the unit's windows; what is left has neighbours that share
   some windows only.
2. blocks of 16 windows of those, placed by their distance from the anchor: rank of the bytes that all 16 share, paired
   with the rank of all that they cover.
3. single windows of the blocks still left: rank at the full length, the threshold, where doubling ends.

Ranks are fingerprints (names), as equality is all that is asked of them; pairs of independent 64-bit names decide.
Each level keeps one row for each distinct content, however many copies it has, and every grouping is pre-aggregated.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, table
from .rolling import MOST, anchors, base

#: Strings of LENGTH bytes are removed; those of SHORT are reported only.
LENGTH, SHORT, BLOCK = 400, 256, 16
SEGMENT = 900_000
KEY = ["doc_id", "own"]


def _release(spark) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def _segments(texts: list[bytes], length: int):
    """Groups of (row, first byte, bytes) of at most SEGMENT bytes or so; long texts in parts that overlap by a window."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t[a : a + SEGMENT + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > MOST - 1 and held:
                yield held
                held, size = [], 0
            held.append((k, a, part))
            size += len(part)
    if held:
        yield held


def unit_arrays(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Units of the texts: row, first window, windows, anchor's distance from the first window, name at the anchor, name
    of all the unit covers."""
    out = []
    one, two = base(1), base(2)
    half = length // 2
    for held in _segments(texts, length):
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        sizes = np.array([len(x) for _, _, x in held])
        start = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        names = one.rolling(one.sums(data), half)
        part = np.repeat(np.arange(len(held)), windows)
        p = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows - start, windows)
        a = anchors(names, length - half + 1)[p]
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (part[1:] != part[:-1])
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(p)))
        p, part, a = p[first], part[first], a[first]
        whole = two.prints(two.sums(data), p, p + n - 1 + length)
        row, at = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        out.append([row[part], p - start[part] + at[part], n, a - p, names[a].view(np.int64), whole.view(np.int64)])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def short_arrays(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of the anchors of all windows of length bytes: the half-length strings chosen by content."""
    one, half = base(1), length // 2
    rows, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for held in _segments(texts, length):
        sizes = np.array([len(x) for _, _, x in held])
        start, windows = np.cumsum(sizes) - sizes, sizes - length + 1
        found = one.rolling(one.sums(np.frombuffer(b"".join(x for _, _, x in held), np.uint8)), half)
        part = np.repeat(np.arange(len(held)), windows)
        p = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows - start, windows)
        a = anchors(found, length - half + 1)[p]
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (part[1:] != part[:-1])
        rows.append(np.array([x[0] for x in held])[part[new]])
        names.append(found[a[new]].view(np.int64))
    return np.concatenate(rows), np.concatenate(names)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, own (a digest that tells rows of one doc_id apart) and text. Rows equal in all have one fate."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.coalesce("doc_id", F.lit(-1))).alias("own"), text.alias("text"))


def _units(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            row, p, n, off, name, whole = unit_arrays([_bytes(t) for t in b.column(2).to_pylist()], length)
            row = pa.array(row)
            cols = [b.column(0).take(row), b.column(1).take(row), pa.array(p.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(name), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "own", "p", "n", "off", "name", "whole"])

    return docs.mapInArrow(run, "doc_id long, own long, p long, n int, off int, name long, whole long")


def _short_repeats(docs: DataFrame, length: int) -> DataFrame:
    """KEY and n_short_repeats of rows that have any: how many anchors of windows of length bytes have a name, of half
    the length, that is also another anchor's. A string of length bytes that repeats holds one at least."""

    def run(batches):
        for b in batches:
            row, name = short_arrays([_bytes(t) for t in b.column(2).to_pylist()], length)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(name)], ["doc_id", "own", "name"])

    made = stored(docs.mapInArrow(run, "doc_id long, own long, name long"), "short")
    again = stored(made.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("name"), "short-again")
    # rows equal in doc_id and text count each other's anchors; a row has as many as one of them
    each = made.join(again.hint("shuffle_hash"), "name").groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    copies = docs.groupBy(KEY).agg(F.count(F.lit(1)).alias("copies"))
    return each.join(copies, KEY).select(*KEY, (F.col("n") / F.col("copies")).cast("long").alias("n_short_repeats"))


def _packed(docs: DataFrame) -> DataFrame:
    """The same rows with the text's bytes compressed, for a shuffle."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data = pa.array([z.compress(_bytes(t)) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], ["doc_id", "own", "data"])

    return docs.mapInArrow(run, "doc_id long, own long, data binary")


def _judge(rows: DataFrame, key: list[str], content: list[str], refs: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by their rank (key) and rank pair (key and content): (a stored table, asking rows whose pair repeats, one row
    for each pair whose rank has other pairs too)."""
    # the aggregates are written, so that the joins' shuffles stand alone and adaptive execution can split a hot rank
    shared = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("ck")).where("ck > 1"), f"{name}-ranks")
    near = stored(rows.join(shared.hint("shuffle_hash"), key), name)
    pair = [*key, *content]
    one = F.min(F.struct(*refs, *(["ask"] if "ask" in rows.columns else []))).alias("ref")
    pairs = stored(near.groupBy(pair).agg(F.count(F.lit(1)).alias("cu"), F.first("ck").alias("ck"), one), f"{name}-pairs")
    again = pairs.where("cu > 1").select(pair)
    asking = near.where("ask") if "ask" in rows.columns else near
    settled = asking.join(again.hint("shuffle_hash"), pair)
    mixed = pairs.where("cu < ck").select(*pair, "ref.*", "cu")
    mixed = mixed.withColumn("ask", (F.col("cu") == 1) & (F.col("ask") if "ask" in rows.columns else F.lit(True)))
    return near, settled, mixed.drop("cu")


def _with_bytes(docs: DataFrame, units: DataFrame, length: int) -> DataFrame:
    """Units (doc_id, own, p, n, off, name, ask) with the bytes they cover, each from its document."""
    lists = units.groupBy(KEY).agg(F.collect_list(F.struct("p", "n", "off", "name", "ask")).alias("units"))
    joined = _packed(docs).join(lists.hint("shuffle_hash"), KEY)

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, own, data, units in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                text = z.decompress(data)
                for u in units:
                    out.append((doc, own, u["p"], u["n"], u["off"], u["name"], u["ask"], text[u["p"] : u["p"] + u["n"] - 1 + length]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "own", "p", "n", "off", "name", "ask", "data"])

    # rows equal in all but copies of one another are one row here, as their places are the same
    schema = "doc_id long, own long, p long, n int, off int, name long, ask boolean, data binary"
    return joined.select(*KEY, "data", "units").mapInArrow(run, schema)


def _blocks(units: DataFrame, length: int) -> DataFrame:
    """Blocks of 16 windows of units with bytes, by distance from the anchor: u is the unit's place, core the name of the
    bytes that all windows a block can have share, whole that of all the block covers."""

    def run(batches):
        two = base(2)
        for b in batches:
            out = [[] for _ in range(10)]
            for doc, own, u, n, off, name, ask, data in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                sums = two.sums(np.frombuffer(data, np.uint8))
                block = np.arange((off - n + 1) // BLOCK, off // BLOCK + 1)
                far, near = np.minimum(block * BLOCK + BLOCK - 1, off), np.maximum(block * BLOCK, off - n + 1)
                start = off - block * BLOCK
                core = two.prints(sums, start, start - BLOCK + 1 + length)
                whole = two.prints(sums, off - far, off - near + length)
                m = len(block)
                rows = ([doc] * m, [own] * m, [u] * m, (u + off - far).tolist(), (far - near + 1).tolist(), far.tolist(), [name] * m, core.view(np.int64).tolist(), whole.view(np.int64).tolist(), [ask] * m)
                for c, x in zip(out, rows, strict=True):
                    c += x
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.bool_()]
            names = ["doc_id", "own", "u", "p", "n", "off", "name", "core", "whole", "ask"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = "doc_id long, own long, u long, p long, n int, off int, name long, core long, whole long, ask boolean"
    return units.mapInArrow(run, schema).withColumn("block", F.floor(F.col("off") / BLOCK).cast("int"))


def _windows(units: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """Single windows of the blocks, from the bytes of their units."""
    lists = blocks.groupBy(*KEY, F.col("u").alias("p")).agg(F.collect_list(F.struct("p", "n", "off", "ask")).alias("blocks"))
    joined = units.select(*KEY, "p", "name", "data").join(lists, [*KEY, "p"])

    def run(batches):
        two = base(2)
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, own, u, name, data, blocks in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                names = two.rolling(two.sums(np.frombuffer(data, np.uint8)), length).view(np.int64)
                for x in blocks:
                    p, n, off = x["p"], x["n"], x["off"]
                    rows = ([doc] * n, [own] * n, range(p, p + n), [name] * n, range(off, off - n, -1), names[p - u : p - u + n].tolist(), [x["ask"]] * n)
                    for c, r in zip(out, rows, strict=True):
                        c += r
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.bool_()]
            names = ["doc_id", "own", "p", "name", "off", "whole", "ask"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return joined.mapInArrow(run, "doc_id long, own long, p long, name long, off int, whole long, ask boolean")


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, own, p and end of byte runs to remove; runs overlap and may repeat. docs: from _narrow()."""
    spark = docs.sparkSession
    where = [F.col(k) for k in KEY]
    near1, settled1, mixed1 = _judge(_units(docs, length), ["name"], ["whole", "n", "off"], [*KEY, "p"], "units")
    units = stored(_with_bytes(docs, mixed1, length).dropDuplicates([*KEY, "p"]), "unit-bytes", "zstd")
    _release(spark)
    near2, settled2, mixed2 = _judge(_blocks(units, length), ["name", "block", "core"], ["whole", "n", "off"], [*KEY, "u", "p"], "blocks")
    blocks = stored(mixed2.select(*KEY, "u", "p", "n", "off", "ask"), "blocks-left")
    windows = stored(_windows(units, blocks, length), "windows")
    rank = ["name", "off", "whole"]
    again = stored(windows.groupBy(rank).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(rank), "windows-again")
    settled3 = windows.where("ask").join(again.hint("shuffle_hash"), rank)
    runs = settled1.select(*where, "p", (F.col("p") + F.col("n") - 1 + length).alias("end"))
    runs = runs.union(settled2.select(*where, "p", (F.col("p") + F.col("n") - 1 + length).alias("end")))
    # rows equal in doc_id and text have the same runs: one of each
    runs = stored(runs.union(settled3.select(*where, "p", (F.col("p") + length).alias("end"))).distinct(), "runs")
    for x in (near1, units, near2, blocks, windows):
        drop_stored(x)
    _release(spark)
    return runs


def _merged(p: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(p):
        return p, end
    order = np.argsort(p, kind="stable")
    p, end = p[order], np.maximum.accumulate(end[order])
    new = np.ones(len(p), bool)
    new[1:] = p[1:] > end[:-1]
    first = np.nonzero(new)[0]
    return p[first], end[np.append(first[1:], len(p)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, short: int | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, own
    (which tells rows of one doc_id apart) and the text of the bytes kept; a character that a removed run cuts goes.

    With short, a length below the threshold, n_short_repeats tells of shorter passages that repeat, which stay: it is
    above 0 wherever a string of so many bytes also starts elsewhere, and 0 where none of half as many does.

    Null and empty texts, and those shorter than length, have nothing removed. Rows that repeat are each judged, so
    copies of length bytes or more go wholly; a null doc_id is a doc_id like any other (the least long stands for it, so a
    doc_id of that value comes out as null). Other columns are not read; an empty table gives no rows. A very long text is
    read in segments and its bytes are held whole where it is cut. There is nothing to tie: every place is judged alike.
    """
    docs = _narrow(docs)
    safe = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    runs = _spans(safe, length).groupBy(KEY).agg(F.collect_list(F.struct("p", "end")).alias("runs"))
    joined = _packed(safe).join(runs.hint("shuffle_hash"), KEY, "left").withColumn("n_short_repeats", F.lit(0).cast("long"))
    if short:
        joined = joined.drop("n_short_repeats").join(_short_repeats(safe, short), KEY, "left").fillna(0, ["n_short_repeats"])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", own long, kept string" * with_text
    schema += ", n_short_repeats long" * bool(short)

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            lists = b.column(3)
            flat, ends = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            starts, stops = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = 0
            for doc, own, data, to, n_short in zip(*(b.column(k).to_pylist() for k in range(3)), ends.tolist(), b.column(4).to_pylist(), strict=True):
                text = z.decompress(data)
                p, end = _merged(starts[at:to], stops[at:to])
                at = to
                kept = b"".join(text[a:e] for a, e in zip([0, *end.tolist()], [*p.tolist(), len(text)], strict=True))
                row = [doc if doc > -(1 << 63) else None, len(text), len(text) - len(kept), len(p), hashlib.sha256(kept).hexdigest()]
                out.append(row + [own, kept.decode("utf-8", "ignore")] * with_text + [n_short] * bool(short))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.int64(), pa.string()] * with_text + [pa.int64()] * bool(short)
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names)

    return joined.select(*KEY, "data", "runs", "n_short_repeats").mapInArrow(run, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), short=SHORT)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes gone from text and, where there is one, n_chars counted anew.

    A character that a removed run cuts goes with it. Null texts stay null; every row stays.
    """
    nul = -(1 << 63)
    own = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(-1)))
    kept = remove_repeats(docs, length, with_text=True).where("n_removed > 0")
    new = kept.select(F.coalesce("doc_id", F.lit(nul)).alias("_id"), F.col("own").alias("_own"), F.col("kept").alias("_text")).dropDuplicates(["_id", "_own"])
    rows = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(nul)), "_own": own})
    out = rows.join(new, ["_id", "_own"], "left").withColumn("text", F.coalesce("_text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
