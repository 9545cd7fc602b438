"""Running sums over an order of all rows, whatever the groups' sizes.

Rows are range-sorted by (keys, order) with splitters that Spark samples, and written with the number of their range. A
window then runs inside a range only, and what stands before it in its group is added. Only the first group of a range
can have begun in an earlier one, so those sums have a row for each range at most and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def _ordered(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _running(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Column], fold, join, before: bool, ranges: int | None) -> DataFrame:
    """df with fold of each value so far by keys; join(inside, base) brings together a range's own and what comes before
    it, either of which may be null. before leaves the row's own value out."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = [*_ordered(keys), *_ordered(order)]
    part = F.spark_partition_id()
    rows = cut(df.withColumns({f"_v{k}": v for k, v in enumerate(values.values())}).repartitionByRange(n, *(along or [F.lit(0)])).withColumn("_part", part), "ranges")
    totals = rows.groupBy(*keys, "_part").agg(*[fold(f"_v{k}").alias(f"_b{k}") for k in range(len(values))])
    # what a group has before a range; the group's first range needs nothing
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumns({f"_b{k}": fold(f"_b{k}").over(earlier) for k in range(len(values))} | {"_seen": F.count(F.lit(1)).over(earlier)})
    base = base.where("_seen > 0").drop("_seen").withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)} | {"_part": "_p"})
    inside = Window.partitionBy(*keys, "_part").orderBy(*_ordered(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    met = rows.withColumns({f"_v{k}": fold(f"_v{k}").over(inside) for k in range(len(values))})
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    met = met.join(F.broadcast(base), same, "left")
    return met.select(*df.columns, *[join(F.col(f"_v{k}"), F.col(f"_b{k}")).alias(name) for k, name in enumerate(values)])


def prefix_sums(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with running sums by keys, in the order given, each row's own value included.

    Rows that are equal in keys and order lie in one range, and which of them stands first is undefined; an order that
    ends in an id avoids both. Values to be summed must not be null. Null keys are groups like any other.
    """
    return _running(df, keys, order, sums, F.sum, lambda own, base: own + F.coalesce(base, F.lit(0)), False, ranges)


def prefix_max(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Column], before: bool = False, ranges: int | None = None) -> DataFrame:
    """df with the largest values so far (before: of earlier rows only) by keys, in the order given; null where none is."""
    return _running(df, keys, order, values, F.max, lambda own, base: F.greatest(own, base), before, ranges)


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """Row numbers from 1 by keys in the order given."""
    return prefix_sums(df, keys, order, {name: F.lit(1).cast("long")}, ranges)


def quantiles_by(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], ranges: int | None = None) -> DataFrame:
    """Exact quantiles of each group with linear interpolation: keys and a column for each share.

    Values that are null or NaN do not count; a group without others is absent. Infinite values are values like any
    other. Running counts by distinct value tell which two values each quantile lies between.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    counts = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = prefix_sums(counts, keys, ["_v"], {"_upto": F.col("_c")}, ranges)
    total = upto.groupBy(*keys).agg(F.max("_upto").alias("_n")).withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    rows = upto.join(total, same) if keys else upto.crossJoin(F.broadcast(total))  # without keys the total is one row
    place = {k: F.lit(q) * (F.col("_n") - 1) for k, q in enumerate(shares.values())}
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    picked = rows.groupBy(*keys).agg(
        F.first("_n").alias("_n"), *[at(f(place[k]).cast("long")).alias(f"_{side}{k}") for k in place for side, f in (("a", F.floor), ("z", F.ceil))]
    )
    rest = {k: place[k] - F.floor(place[k]) for k in place}
    between = {k: F.when((rest[k] == 0) | (F.col(f"_a{k}") == F.col(f"_z{k}")), F.col(f"_a{k}")).otherwise((1 - rest[k]) * F.col(f"_a{k}") + rest[k] * F.col(f"_z{k}")) for k in place}
    return picked.select(*keys, *[between[k].alias(name) for k, name in enumerate(shares)])


def inversions(df: DataFrame, order: list[str | Column], value: str, block: int = 1 << 16, ranges: int | None = None) -> int:
    """Pairs of rows of which the earlier one has the larger value.

    Rows are numbered in order. Those in one block of numbers are counted by merging in memory. Above blocks a merge level
    joins FAN runs to one: of rows sorted by value, descending, inside a run of runs, each meets the running counts of the
    runs before its own. Every level is a pass of running sums, so n rows take n log n of work and no pair is formed.
    """
    import numpy as np
    import pyarrow as pa

    rows = cut(numbered(df.select(*df.columns), [], order, "_i", ranges).select((F.col("_i") - 1).alias("i"), F.col(value).alias("v")), "inversions")

    def inside(t: pa.Table) -> pa.Table:
        by = np.argsort(t["i"].to_numpy(), kind="stable")
        _, v = np.unique(t["v"].to_numpy()[by], return_inverse=True)
        n, width, found = len(v), 1, 0
        m = np.int64(v.max() + 1)
        while width < n:
            run = np.arange(n) // (2 * width)
            left = np.arange(n) // width % 2 == 0
            held = np.sort(run[left] * m + v[left])
            # of the left run's values, those above a right one's
            end = np.searchsorted(held, (run[~left] + 1) * m)
            found += int((end - np.searchsorted(held, run[~left] * m + v[~left], side="right")).sum())
            width *= 2
        return pa.table({"found": pa.array([found], pa.int64())})

    found = rows.groupBy(F.floor(F.col("i") / block).alias("b")).applyInArrow(inside, "found long").agg(F.sum("found")).first()[0] or 0
    n, width = rows.count(), block
    while width < n:
        level = rows.select("v", F.floor(F.col("i") / width).alias("run")).withColumn("over", F.floor(F.col("run") / FAN))
        child = F.col("run") % FAN
        upto = prefix_sums(level.withColumn("run", child), ["over"], [F.desc("v"), F.desc("run")], {f"_c{k}": (F.col("run") == k).cast("long") for k in range(FAN - 1)}, ranges)
        met = sum((F.when(F.col("run") > k, F.col(f"_c{k}")).otherwise(0) for k in range(1, FAN - 1)), F.when(F.col("run") > 0, F.col("_c0")).otherwise(0))
        found += upto.agg(F.sum(met.cast("decimal(38,0)"))).first()[0] or 0
        width *= FAN
    return int(found)


#: Runs that one merge level joins.
FAN = 16
