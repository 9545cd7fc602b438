"""Ranking, calibration and agreement metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import inversions
from .storage import cut, drop
from .topk import average_rank, ranked, running_counts


def auc_parts(df: DataFrame, keys: list[str], score: str = "p", gold: str = "gold") -> DataFrame:
    """pos, neg and num = pairs won (ties one half) of each group, by ranks: no pair is formed."""
    g = F.col(gold)
    per = average_rank(df.where(F.col(score).isNotNull()), keys, score).groupBy(*keys).agg(
        F.sum(g).alias("pos"), F.sum(1 - g).alias("neg"), F.sum(F.when(g == 1, F.col("avg_rank"))).alias("_r")
    )
    return per.select(*keys, "pos", "neg", (F.coalesce("_r", F.lit(0.0)) - F.col("pos") * (F.col("pos") + 1) / 2.0).alias("num"))


def auc(df: DataFrame, keys: list[str], score: str = "p", gold: str = "gold", default: float | None = None) -> DataFrame:
    """AUC by keys; null (or default) where a class is missing."""
    value = F.try_divide(F.col("num"), (F.col("pos") * F.col("neg")).cast("double"))
    return auc_parts(df, keys, score, gold).select(*keys, (value if default is None else F.coalesce(value, F.lit(default))).alias("auc"))


def group_auc(df: DataFrame, keys: list[str], group: str = "grp", score: str = "p", gold: str = "gold") -> DataFrame:
    """By keys: AUC within groups, averaged over the groups with both classes, and weighted by pairs."""
    parts = auc_parts(df, [*keys, group], score, gold).where("pos > 0 and neg > 0")
    pairs = F.col("pos") * F.col("neg")
    return parts.groupBy(*keys).agg(F.avg(F.col("num") / pairs).alias("mean_auc"), (F.sum("num") / F.sum(pairs)).alias("weighted_auc"), F.count(F.lit(1)).alias("groups"))


def recall_at_k(df: DataFrame, keys: list[str], k: int, group: str = "grp", score: str = "p", gold: str = "gold", tie: str = "unit_id") -> DataFrame:
    """Recall and detection in each group's k best, averaged over groups with positives; ``binding`` groups have more
    than 3 k rows."""
    top = F.when(F.col("rn") <= k, F.col(gold)).otherwise(0)
    per = ranked(df, [*keys, group], score, tie).groupBy(*keys, group).agg(F.sum(gold).alias("pos"), F.sum(top).alias("hit"), F.count(F.lit(1)).alias("n"))
    rec = F.col("hit") / F.col("pos")
    return per.where("pos > 0").groupBy(*keys).agg(
        F.avg(rec).alias("recall_at_k"), F.avg((F.col("hit") > 0).cast("double")).alias("det_at_k"), F.avg(F.when(F.col("n") > 3 * k, rec)).alias("recall_binding")
    )


def first_hit(df: DataFrame, keys: list[str], ks: list[int], score: str = "p", gold: str = "gold", tie: str = "unit_id") -> DataFrame:
    """By keys: false ones read before the first positive (ifa), their share, and whether one is found in the first k.

    The best positive is an aggregate, and what stands before it is counted: nothing is sorted.
    """
    place = F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), F.col(tie).alias("t"))
    rows = df.select(*keys, F.col(gold).alias("_g"), place.alias("_at"))
    best = rows.groupBy(*keys).agg(F.min(F.when(F.col("_g") == 1, F.col("_at"))).alias("_best"), F.sum(1 - F.col("_g")).alias("false_n"))
    upto = F.count(F.when(F.col("_at") <= F.col("_best"), 1))
    per = rows.join(best, keys).groupBy(*keys).agg(F.when(F.max("_best").isNotNull(), upto).alias("_f"), F.max("false_n").alias("false_n"))
    found = [(F.coalesce(F.col("_f"), F.lit(1 << 60)) <= k).cast("int").alias(f"found_at_{k}") for k in ks]
    return per.select(*keys, (F.col("_f") - 1).alias("ifa"), F.try_divide(F.col("_f") - 1, F.col("false_n")).alias("share_read"), *found)


def random_expectation(df: DataFrame, keys: list[str], k: int, gold: str = "gold") -> DataFrame:
    """In closed form for a random order: expected ifa = F / (R + 1), chance of a positive in k draws."""
    per = df.groupBy(*keys).agg(F.sum(gold).cast("long").alias("r"), F.sum(1 - F.col(gold)).cast("long").alias("f"))
    f, n = F.col("f"), F.col("f") + F.col("r")
    none = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(f - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return per.select(*keys, (f / (F.col("r") + 1)).alias("e_ifa"), F.when(n < k, 1.0).otherwise(1 - none).alias("p_found"))


def ece(df: DataFrame, keys: list[str], score: str = "p", gold: str = "gold", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = df.where(F.col(score).isNotNull()).groupBy(*keys, b.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("conf"), F.avg(gold).alias("acc"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def miss_rate_at(df: DataFrame, keys: list[str], budget: float, score: str = "p", gold: str = "gold", tie: str = "unit_id") -> DataFrame:
    """Share of positives missed by the most permissive cut whose false-positive rate is within budget; 1 if there is
    none."""
    total = df.groupBy(*keys).agg(F.sum(gold).alias("pos"), F.sum(1 - F.col(gold)).alias("neg"))
    walk = running_counts(df, keys, score, gold, tie).join(total, keys)
    best = walk.groupBy(*keys).agg(F.max(F.when(F.col("cum_fp") <= budget * F.col("neg"), F.col("cum_tp"))).alias("tp"), F.first("pos").alias("pos"))
    return best.select(*keys, F.coalesce(1 - F.try_divide(F.col("tp"), F.col("pos")), F.lit(1.0)).alias("miss_rate"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """(concordant - discordant) / max(their sum, 1) of all pairs of items, without correction for ties: one row.

    Of items sorted by a and b, the pairs with b out of order are the discordant ones; all others that tie in neither are
    concordant. Items with a null in either do not count.
    """
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    apart = cut(rows, "kendall")
    pairs = lambda keys: apart.groupBy(*keys).agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
    n = int(pairs([]) - pairs(["a"]) - pairs(["b"]) + pairs(["a", "b"]))
    wrong = inversions(apart, ["a", "b"], "b")
    drop(apart)
    return df.sparkSession.createDataFrame([((n - 2 * wrong) / max(n, 1),)], "tau double")


def error_correlation(df: DataFrame, unit: str = "unit_id", model: str = "model") -> DataFrame:
    """Correlation of correctness of each pair of models over the units both measured."""
    right = df.where("pred is not null").select(unit, model, (F.col("pred") == F.col("gold")).cast("double").alias("ok"))
    other = right.select(unit, F.col(model).alias("model2"), F.col("ok").alias("ok2"))
    return right.join(other, unit).where(F.col(model) < F.col("model2")).groupBy(model, "model2").agg(F.corr("ok", "ok2").alias("correlation"))


def oracle_null(df: DataFrame, group: str = "grp", model: str = "model") -> DataFrame:
    """Right by at least one model, measured and as independence has it (1 - product of error rates by group), both
    weighted by units."""
    right = F.coalesce((F.col("pred") == F.col("gold")).cast("int"), F.lit(0))
    per_model = df.groupBy(group, model).agg(F.avg(right).alias("a"))
    miss = per_model.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list("a")), F.lit(1.0), lambda acc, a: acc * (1 - a)).alias("miss"))
    any_right = df.groupBy(group, "unit_id").agg(F.max(right).alias("ok")).groupBy(group).agg(F.avg("ok").alias("oracle"), F.count(F.lit(1)).alias("n"))
    both = any_right.join(miss, group)
    return both.agg((F.sum(F.col("n") * F.col("oracle")) / F.sum("n")).alias("oracle"), (F.sum(F.col("n") * (1 - F.col("miss"))) / F.sum("n")).alias("independent"))


def pareto(df: DataFrame, name: str, group: str, quality: str, cost: str) -> DataFrame:
    """Names not dominated: no other is at least as good in every group, better in one or cheaper, and not dearer."""
    a = df.select(F.col(name).alias("n1"), F.col(group).alias("g"), F.col(quality).alias("q1"), F.col(cost).alias("c1"))
    b = df.select(F.col(name).alias("n2"), F.col(group).alias("g"), F.col(quality).alias("q2"), F.col(cost).alias("c2"))
    pair = a.join(b, "g").where("n1 <> n2").groupBy("n1", "n2").agg(F.min((F.col("q2") >= F.col("q1")).cast("int")).alias("all"), F.max((F.col("q2") > F.col("q1")).cast("int")).alias("some"), F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    beaten = pair.where("all = 1 and c2 <= c1 and (some = 1 or c2 < c1)").select(F.col("n1").alias(name)).distinct()
    return df.select(name).distinct().join(beaten, name, "left_anti")


def trigger_lift(df: DataFrame, keys: list[str], fired: str, wrong: str) -> DataFrame:
    """How often a trigger fires, and the error rate where it does over the error rate at all."""
    return df.groupBy(*keys).agg(F.avg(fired).alias("fire_rate"), F.try_divide(F.avg(F.when(F.col(fired) == 1, F.col(wrong))), F.avg(wrong)).alias("lift"))


def marginal_gain(df: DataFrame, keys: list[str], order: str, quality: str, cost: str) -> DataFrame:
    """Change in quality over change in cost from each budget to the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("gain", F.try_divide(F.col(quality) - F.lag(quality).over(w), F.col(cost) - F.lag(cost).over(w)))
