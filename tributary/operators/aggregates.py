"""Aggregations over the measurement table: confusion counts, precision and recall, macro metrics, costs, votes.

Undefined ratios are null, unless a function says 0. Verdicts may be null (unparsed); ``verdict`` says what they count as.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import prefix_sums


ratio = F.try_divide


def verdict(policy: str, pred: str = "pred") -> Column:
    """Unparsed verdicts as 'benign' (0), 'keep' (1), 'null' (stay null)."""
    return {"benign": F.coalesce(F.col(pred), F.lit(0)), "keep": F.coalesce(F.col(pred), F.lit(1)), "null": F.col(pred)}[policy]


def confusion(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn by keys; rows with a null verdict count nowhere."""
    c = lambda g, p: F.count_if((F.col(gold) == g) & (F.col(pred) == p))
    return df.groupBy(*keys).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


def prf(df: DataFrame, undefined_zero: bool = True) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn."""
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if undefined_zero else (lambda c: c)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return df.withColumns({"precision": fill(p), "recall": fill(r), "f1": fill(f)})


def macro_detection(df: DataFrame, dim: DataFrame, keys: list[str], group: str = "grp", kept: str = "kept", gold: str = "gold") -> DataFrame:
    """Detection by group, averaged: a group is detected if a kept row is gold. False discovery averages over groups with
    kept rows, F1 over all groups of dim; groups without rows stay in the denominator."""
    per = df.groupBy(*keys, group).agg(F.sum(kept).alias("n"), F.sum(F.col(kept) * F.col(gold)).alias("tp"))
    full = dim.join(per, [*keys, group], "left").fillna(0, ["n", "tp"])
    precision, hit = ratio(F.col("tp"), F.col("n")), (F.col("tp") > 0).cast("int")
    f1 = F.coalesce(ratio(2 * precision * hit, precision + hit), F.lit(0.0))
    return full.groupBy(*keys).agg(
        F.sum(hit).alias("detected"), F.count(F.lit(1)).alias("groups"),
        F.avg(1 - precision).alias("avg_fdr"), F.avg(f1).alias("avg_f1"),
    )


def complete_case(df: DataFrame, unit: str = "unit_id", model: str = "model") -> DataFrame:
    """Rows of units measured by every model that occurs; exact counts."""
    n = df.select(model).distinct().agg(F.count(F.lit(1)).alias("_n"))
    whole = df.groupBy(unit).agg(F.countDistinct(model).alias("_m")).join(F.broadcast(n), F.col("_m") == F.col("_n")).select(unit)
    return df.join(whole, unit, "left_semi")


def one_vs_rest(df: DataFrame, truth: str, guess: str, classes: DataFrame) -> DataFrame:
    """precision, recall and accuracy of each class (column class), from counts by truth, by guess and of both."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("class"), "n", F.lit(0).cast("long").alias("as"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("g").alias("class"), F.lit(0).cast("long").alias("n"), F.col("n").alias("as"), F.lit(0).cast("long").alias("tp")),
        )).alias("x")
    ).groupBy("x.class").agg(F.sum("x.n").alias("true_n"), F.sum("x.as").alias("guess_n"), F.sum("x.tp").alias("tp"))
    rows = classes.select("class").join(counts, "class", "left").fillna(0, ["true_n", "guess_n", "tp"]).crossJoin(F.broadcast(pairs.agg(F.sum("n").alias("n"))))
    wrong = F.col("true_n") + F.col("guess_n") - 2 * F.col("tp")
    return rows.select("class", ratio(F.col("tp"), F.col("guess_n")).alias("precision"), ratio(F.col("tp"), F.col("true_n")).alias("recall"), ((F.col("n") - wrong) / F.col("n")).alias("accuracy"))


def min_max(df: DataFrame, value: str, keys: list[str], name: str = "scaled") -> DataFrame:
    """(x - lo) / (hi - lo) within a group, 0 where all are equal; bounds by aggregate and join, not by a window."""
    b = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.join(b, keys).withColumn(name, x).drop("_lo", "_hi")


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The element at floor(share * n) of the sorted values, from running counts by distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = prefix_sums(counts, keys, [value], {"_upto": F.col("_c")})
    n = upto.groupBy(*keys).agg(F.max("_upto").alias("_n"))
    place = F.least(F.floor(share * F.col("_n")), F.col("_n") - 1)
    return upto.join(n, keys).where((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto"))).select(*keys, value)


def unanimity(df: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Shares of units with one verdict from all, all right, all wrong, and disagreement."""
    right = (F.col("pred") == F.col("gold")).cast("int")
    per = df.where("pred is not null").groupBy(unit).agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.min(right).alias("all_right"), F.max(right).alias("any_right"))
    return per.agg(
        F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("unanimous"), F.avg(F.col("all_right").cast("double")).alias("all_right"),
        F.avg((1 - F.col("any_right")).cast("double")).alias("all_wrong"), F.avg((F.col("lo") != F.col("hi")).cast("double")).alias("live"),
    )


def votes(df: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Votes for and against by unit, strict majority (ties 0) and unanimity, over parsed verdicts."""
    per = df.groupBy(unit).agg(F.sum("pred").alias("yes"), F.count("pred").alias("n"))
    return per.select(unit, F.coalesce("yes", F.lit(0)).alias("yes"), "n", (2 * F.coalesce("yes", F.lit(0)) > F.col("n")).cast("int").alias("majority"), ((F.col("n") > 0) & (F.col("yes") == F.col("n"))).cast("int").alias("unanimous"))


def cheapest_correct(df: DataFrame, unit: str = "unit_id", cost: str = "seconds") -> DataFrame:
    """By unit, the cost of the cheapest model that is right; null if none is."""
    return df.groupBy(unit).agg(F.min(F.when(F.col("pred") == F.col("gold"), F.col(cost))).alias("cost"))
