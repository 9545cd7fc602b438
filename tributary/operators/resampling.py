"""Resampling and null models on integer hash streams.

Every draw is a function of (unit, draw), so it can be recomputed anywhere and repeats after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered

P = 2_147_483_647


def stream(*parts: str | Column | int) -> Column:
    """A number below P = 2**31 - 1 from integer columns and constants. What of a part lies above 31 bits counts too, by
    another factor, so ids that P divides apart differ."""
    primes = (7919, 104729, 1299709, 15485863)
    above = (32452843, 49979687, 67867967, 86028121)
    cols = [(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("long") for p in parts]
    low = sum((c.bitwiseAND(F.lit(P)) * k for c, k in zip(cols[1:], primes[1:], strict=False)), cols[0].bitwiseAND(F.lit(P)) * primes[0])
    high = sum((F.shiftright(c, 31) % P * k for c, k in zip(cols[1:], above[1:], strict=False)), F.shiftright(cols[0], 31) % P * above[0])
    t = F.pmod(low + high + 11, F.lit(P))
    square = t * t % P
    return square * square % P * t % P  # the fifth power permutes the numbers below this prime, and is not linear


def draws(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("draw"))


def poisson_weights(df: DataFrame, n: int, *ids: str) -> DataFrame:
    """Each row n times with a Poisson(1) weight for its id: the bootstrap without draws that depend on other rows.

    Rows are the sufficient statistics of groups where the metric allows, so that n multiplies few rows.
    """
    u = stream(*ids, F.col("draw")) / float(P)
    # the distribution function of Poisson(1) at 0 to 6
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    weight = sum((u >= s).cast("long") for s in steps)
    return df.crossJoin(F.broadcast(draws(df.sparkSession, n))).withColumn("weight", weight)


def interval(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))


def matched_selection(df: DataFrame, picked: str, n: int, keys: list[str], unit: str = "unit_id") -> DataFrame:
    """For each draw, as many rows of each group as are picked there, at random."""
    want = df.groupBy(*keys).agg(F.sum(picked).alias("_k"))
    rows = df.crossJoin(F.broadcast(draws(df.sparkSession, n))).withColumn("_u", stream(unit, "draw"))
    w = Window.partitionBy("draw", *keys).orderBy("_u", unit)
    return rows.withColumn("_r", F.row_number().over(w)).join(want, keys).where(F.col("_r") <= F.col("_k")).drop("_r", "_k", "_u")


def permuted(df: DataFrame, value: str, keys: list[str], unit: str, seed: int = 0, name: str = "shuffled") -> DataFrame:
    """Another row's value of the same group: places by id meet places by hash, both numbered by ranges."""
    left = numbered(df, keys, [unit], "_r")
    right = numbered(df.select(*keys, unit, F.col(value).alias(name), stream(unit, seed).alias("_u")), keys, ["_u", unit], "_r")
    return left.join(right.select(*keys, name, "_r"), [*keys, "_r"]).drop("_r")


def z_and_p(null: DataFrame, value: str, observed: float | Column) -> DataFrame:
    """(x - mean) / population deviation, null where that is 0, and the share of null values at or above x."""
    x = observed if isinstance(observed, Column) else F.lit(observed)
    one = null.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.avg((F.col(value) >= x).cast("double")).alias("p_value"))
    return one.select(F.try_divide(x - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))).alias("z"), "p_value")


def folds(df: DataFrame, k: int, unit: str = "unit_id", seed: int = 0) -> DataFrame:
    """Fold numbers by place in hash order, sizes equal up to one.

    Places come from counts of a thousand hash ranges and row numbers inside them: no window runs over all rows.
    """
    ids = df.select(unit).distinct().withColumn("_u", stream(unit, seed)).withColumn("_b", F.floor(F.col("_u") / (P / 1000)))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_u", unit)) - 1 + F.col("_before")
    numbered = ids.join(F.broadcast(base), "_b").select(unit, F.pmod(place, F.lit(k)).cast("int").alias("fold"))
    return df.join(numbered, unit)


def expand_share(p: str, n: int) -> Column:
    """An array of n samples of which the first round(p n), half-even, are 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i <= F.bround(F.col(p) * n)).cast("int"))


def stratified(df: DataFrame, strata: list[str], k: int, unit: str = "unit_id", seed: int = 0) -> DataFrame:
    """k random rows of each stratum, in hash order."""
    w = Window.partitionBy(*strata).orderBy(stream(unit, seed), unit)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
