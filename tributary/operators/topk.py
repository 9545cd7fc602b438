"""Grouped top-k, argmin with ties, cumulative windows and interpolation.

Orders carry an id as tie-breaker, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, prefix_sums
from .sizes import quantiles
from .storage import cut


def ranked(df: DataFrame, keys: list[str], score: str, tie: str = "unit_id", name: str = "rn") -> DataFrame:
    """Row numbers by score, best first, ties in input order (tie)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))


def top_k(df: DataFrame, keys: list[str], score: str, k: int, tie: str = "unit_id") -> DataFrame:
    """The k best rows of each group. A filter on row_number lets Spark limit each task's group before the shuffle."""
    return ranked(df, keys, score, tie).where(F.col("rn") <= k)


def top_share(df: DataFrame, keys: list[str], score: str, share: float, least: int = 0, tie: str = "unit_id") -> DataFrame:
    """The best round(share * n) rows of each group, half-even, at least so many."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.bround(share * F.col("_n")).cast("long"), F.lit(least))
    return ranked(df, keys, score, tie).join(n, keys).where(F.col("rn") <= k).drop("_n")


def arg_best(df: DataFrame, keys: list[str], value: str, order: str, take: list[str], largest: bool = False) -> DataFrame:
    """The row with the smallest (or largest) value of each group, ties to the lowest order: one aggregate, no sort."""
    v = -F.col(value) if largest else F.col(value)
    best = F.min(F.struct(v.alias("v"), F.col(order).alias("o"), *[F.col(c) for c in take if c != order])).alias("b")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, *[F.col("b.o").alias(c) if c == order else F.col(f"b.{c}") for c in take])


def running_counts(df: DataFrame, keys: list[str], score: str, gold: str = "gold", tie: str = "unit_id") -> DataFrame:
    """True and false positives so far, best score first; a group may lie in many tasks."""
    return prefix_sums(df, keys, [F.desc(score), tie], {"cum_tp": F.col(gold), "cum_fp": 1 - F.col(gold)})


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean. Counts by distinct value come first, and their running sums are taken by
    ranges of values, so a group of any size lies in many tasks."""
    by_value = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = prefix_sums(by_value, keys, [value], {name: F.col("_c")}).withColumn(name, F.col(name) - (F.col("_c") - 1) / 2.0).drop("_c")
    return df.join(ranks, [*keys, value])


def percentile_rank(df: DataFrame, keys: list[str], value: str, name: str = "pct") -> DataFrame:
    """(average rank - 1) / (n - 1), one half in a group of one."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pct = F.when(F.col("_n") > 1, (F.col("avg_rank") - 1) / (F.col("_n") - 1)).otherwise(0.5)
    return average_rank(df, keys, value).join(n, keys).withColumn(name, pct).drop("_n", "avg_rank")


def quartile_bins(df: DataFrame, value: str, name: str = "bin") -> DataFrame:
    """Equal-frequency bins 0 to 3 by exact quartiles, right-closed."""
    one, two, three = (F.lit(x) for x in quantiles(df, value, [0.25, 0.5, 0.75]))
    return df.withColumn(name, F.when(F.col(value) <= one, 0).when(F.col(value) <= two, 1).when(F.col(value) <= three, 2).otherwise(3))


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area under y over sorted x; neighbours meet by their numbers. Of equal x the smaller y comes first."""
    points = cut(numbered(df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), keys, ["_x", "_y"], "_r"), "points")
    after = points.select(*keys, (F.col("_r") - 1).alias("_r"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    step = (F.col("_x2") - F.col("_x")) * (F.col("_y2") + F.col("_y")) / 2
    return points.join(after, [*keys, "_r"], "left").groupBy(*keys).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("area"))


def interpolate(points: DataFrame, grid: DataFrame, x: str = "x", y: str = "y", at: str = "g") -> DataFrame:
    """Piecewise-linear y at grid values, flat beyond the ends, as a join with the last point at or before each.

    Points and grid are sorted together, so that running counts tell how many points lie before; of points with one x
    the last by y counts. Both may be of any size.
    """
    order = numbered(points.select(F.col(x).alias("x1"), F.col(y).alias("y1")), [], ["x1", "y1"], "r")
    ends = order.join(order.select((F.col("r") - 1).alias("r"), F.col("x1").alias("x2"), F.col("y1").alias("y2")), "r", "left")
    both = points.select(F.col(x).alias("v"), F.lit(1).alias("point")).union(grid.select(F.col(at), F.lit(0)))
    met = prefix_sums(both, [], ["v", F.desc("point")], {"r": F.col("point")}).where("point = 0").select(F.col("v").alias(at), "r").join(ends, "r", "left")
    first = points.agg(F.min(F.struct(x, y)).alias("_f")).select(F.col(f"_f.{y}").alias("_first"))
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    value = F.when(F.col("r") == 0, F.col("_first")).when(F.col("x2").isNull(), F.col("y1")).otherwise(F.col("y1") + slope * (F.col(at) - F.col("x1")))
    return met.crossJoin(F.broadcast(first)).select(at, value.alias("value"))


def ends_of(array: str, k: int = 4):
    """An array longer than 2 k keeps its first and last k items."""
    a = F.col(array)
    return F.when(F.size(a) > 2 * k, F.concat(F.slice(a, 1, k), F.slice(a, -k, k))).otherwise(a)


def strided(array: str):
    """Inner items of an array at a stride of a tenth of its length, one at least."""
    n = F.size(array)
    step = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
    return F.filter(F.col(array), lambda x, i: (i > 0) & (i < n - 1) & ((i - 1) % step == 0))


def budget_prefix(df: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows in order until their sizes pass the budget; the first always stays, and after the first that overflows none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"_s": F.sum(size).over(w), "_r": F.row_number().over(Window.partitionBy(*keys).orderBy(order))}).where((F.col("_s") <= budget) | (F.col("_r") == 1)).drop("_s", "_r")
