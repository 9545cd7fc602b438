"""Routing rules, cascades and cost-quality frontiers over the long measurement table.

A strategy is a function of (measurements, lambda) that gives a row for each unit with the chosen model's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import nearest
from .ranges import prefix_sums
from .sizes import quantiles
from .topk import arg_best, ranked, trapezoid


def loss(c_fn: float = 5.0, c_fp: float = 1.0) -> Column:
    """Asymmetric loss of a verdict; an unparsed one counts as 0 (benign)."""
    pred = F.coalesce(F.col("pred"), F.lit(0))
    return F.when((F.col("gold") == 1) & (pred == 0), c_fn).when((F.col("gold") == 0) & (pred == 1), c_fp).otherwise(0.0)


def quality(rho: float = 10.0) -> Column:
    """1 for a right verdict, 0 for a miss, 1 - 1 / rho for a false alarm."""
    pred = F.coalesce(F.col("pred"), F.lit(0))
    return F.when(pred == F.col("gold"), 1.0).when(F.col("gold") == 1, 0.0).otherwise(1.0 - 1.0 / rho)


def fixed(df: DataFrame, m: int) -> DataFrame:
    return df.where(F.col("m") == m)


def random_choice(df: DataFrame, models: int, seed: int = 0) -> DataFrame:
    u = (F.col("unit_id") * 48271 + seed * 69621 + 7) % 1000003
    return df.where(F.col("m") == F.pmod(u, F.lit(models)))


def oracle(df: DataFrame, lam: float = 0.0) -> DataFrame:
    """The model with least loss + lambda * cost by unit; the first one among equals."""
    take = ["model", "seconds", "gold", "pred", "p", "grp", "cls", "loss"]
    scored = df.withColumn("loss", loss()).withColumn("_v", F.col("loss") + lam * F.col("seconds"))
    return arg_best(scored, ["unit_id"], "_v", "m", ["m", *take])


def threshold(df: DataFrame, weak: int, strong: int, q: float, score: str = "p") -> DataFrame:
    """Units whose weak score is at or above its q-quantile go to the strong model."""
    w = df.where(F.col("m") == weak)
    (cut,) = quantiles(w, score, [q])
    to = w.select("unit_id", F.when(F.col(score) >= F.lit(cut), strong).otherwise(weak).alias("m"))
    return df.join(to, ["unit_id", "m"], "left_semi")


def relative_cut(df: DataFrame, value: str, share: float) -> DataFrame:
    """The cut (value >= cut) whose count is nearest to share * n, the largest on ties: one row. Counts by value are
    summed by ranges of values."""
    by = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    picked = prefix_sums(by, [], [F.desc(value)], {"picked": F.col("c")}).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))
    best = F.min(F.struct(F.abs(F.col("picked") - share * F.col("n")).alias("gap"), (-F.col(value)).alias("neg"), F.col("picked"))).alias("b")
    return picked.agg(best).select((-F.col("b.neg")).alias("cut"), F.col("b.picked").alias("picked"))


def frontier(df: DataFrame, lams: list[float]) -> DataFrame:
    """For each lambda the oracle route's mean quality and cost. Lambdas are a small table; one aggregate routes all."""
    grid = df.sparkSession.createDataFrame([(float(x),) for x in lams], "lam double")
    rows = df.withColumns({"loss": loss(), "quality": quality()}).crossJoin(F.broadcast(grid)).withColumn("_v", F.col("loss") + F.col("lam") * F.col("seconds"))
    chosen = arg_best(rows, ["lam", "unit_id"], "_v", "m", ["m", "quality", "seconds", "loss"])
    return chosen.groupBy("lam").agg(F.avg("quality").alias("quality"), F.avg("seconds").alias("cost"), F.avg("loss").alias("loss"))


def area(curve: DataFrame, x: str = "cost", y: str = "quality") -> DataFrame:
    """Area under the strictly increasing part of a curve, over its width: one row."""
    points = curve.groupBy(x).agg(F.max(y).alias(y)).withColumn("_one", F.lit(1))
    width = points.groupBy("_one").agg((F.max(x) - F.min(x)).alias("_w"))
    return trapezoid(points, ["_one"], x, y).join(width, "_one").select(F.try_divide(F.col("area"), F.nullif(F.col("_w"), F.lit(0.0))).alias("aiq"))


def lookup_router(train: DataFrame, test: DataFrame, cat: str, reward: str = "reward") -> DataFrame:
    """By category the model with the best mean reward on train, else the best over all; the first among equals."""
    means = train.groupBy(cat, "m").agg(F.avg(reward).alias("_r"))
    best = arg_best(means, [cat], "_r", "m", ["m"], largest=True).withColumnRenamed("m", "_cm")
    overall = train.groupBy("m").agg(F.avg(reward).alias("_r")).agg(F.min(F.struct((-F.col("_r")).alias("v"), F.col("m"))).alias("b")).select(F.col("b.m").alias("_gm"))
    to = test.join(best, cat, "left").crossJoin(F.broadcast(overall))
    return to.where(F.col("m") == F.coalesce("_cm", "_gm")).drop("_cm", "_gm")


def knn_router(queries: DataFrame, corpus: DataFrame, rewards: DataFrame, k: int) -> DataFrame:
    """For each query vector the k nearest corpus vectors by cosine (exact, id breaks ties) and the model with the best
    mean reward among them.

    queries, corpus: id, embedding; rewards: id, m, reward.
    """
    near = nearest(queries, corpus, k)
    mean = near.join(rewards, near.cid == rewards.id).groupBy("qid", "m").agg(F.avg("reward").alias("_r"))
    return arg_best(mean, ["qid"], "_r", "m", ["m"], largest=True)


def cascade(df: DataFrame, cheap: int, dear: int, w: float) -> DataFrame:
    """Units whose cheap score lies within w of one half go on to the dear model; cost adds up."""
    c = df.where(F.col("m") == cheap).select("unit_id", "gold", F.col("p").alias("pc"), F.col("pred").alias("predc"), F.col("seconds").alias("sc"))
    d = df.where(F.col("m") == dear).select("unit_id", F.col("p").alias("pd"), F.col("pred").alias("predd"), F.col("seconds").alias("sd"))
    up = F.abs(F.col("pc") - 0.5) < w
    return c.join(d, "unit_id").select("unit_id", "gold", up.cast("int").alias("escalated"), F.when(up, F.col("pd")).otherwise(F.col("pc")).alias("p"), F.when(up, F.col("predd")).otherwise(F.col("predc")).alias("pred"), (F.col("sc") + F.when(up, F.col("sd")).otherwise(0.0)).alias("seconds"))


def suspicion_cascade(df: DataFrame, cheap: int, dear: int, share: float, group: str = "grp") -> DataFrame:
    """In each group the share of units that the cheap model suspects most is scored by the dear one; ordered before all
    others."""
    c = df.where(F.col("m") == cheap)
    n = c.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(c, [group], "p").join(n, group)
    up = F.col("rn") <= F.bround(share * F.col("_n"))
    d = df.where(F.col("m") == dear).select("unit_id", F.col("p").alias("pd"), F.col("seconds").alias("sd"))
    return r.join(d, "unit_id").select("unit_id", group, "gold", up.cast("int").alias("escalated"), F.when(up, 1.0 + F.col("pd")).otherwise(F.col("p")).alias("order_score"), (F.col("seconds") + F.when(up, F.col("sd")).otherwise(0.0)).alias("seconds"))


def cheapest_within(df: DataFrame, value: str, cost: str, name: str, tau: float) -> DataFrame:
    """The cheapest name whose value is within tau of the best: one row."""
    best = df.agg(F.max(value).alias("_b"))
    near = df.crossJoin(F.broadcast(best)).where(F.col(value) >= F.col("_b") - tau)
    return near.agg(F.min(F.struct(F.col(cost), F.col(name), F.col(value))).alias("b")).select("b.*")


def dual_ascent(df: DataFrame, budget: Column | float, eta: float = 0.05, start: float = 1e-3, group: str = "grp") -> DataFrame:
    """Online budget pacing by group: units in id order go to the model with least loss + lambda * cost (the first among
    equals); after each, lambda moves by eta times what spending is ahead of an even pace, in paces, and stays at 0 or
    above. budget is a group's whole.

    df: group, unit_id, m, loss, cost. The fold is sequential by nature: one row holds a group's units. Gives choices in
    order, spent, lost and the last lambda.
    """
    unit = df.groupBy(group, "unit_id").agg(F.array_sort(F.collect_list(F.struct("m", "loss", "cost"))).alias("c"))
    scans = unit.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("unit_id", "c"))).alias("units"), F.count(F.lit(1)).alias("n"))
    scans = scans.withColumn("pace", (budget if isinstance(budget, Column) else F.lit(float(budget))) / F.col("n"))
    zero = F.struct(F.lit(float(start)).alias("lam"), F.lit(0.0).alias("spent"), F.lit(0.0).alias("lost"), F.lit(0).cast("bigint").alias("i"), F.array().cast("array<int>").alias("choices"))

    def step(acc: Column, u: Column) -> Column:
        best = F.array_min(F.transform(u["c"], lambda x: F.struct((x["loss"] + acc["lam"] * x["cost"]).alias("v"), x["m"].alias("m"), x["cost"].alias("cost"), x["loss"].alias("loss"))))
        spent = acc["spent"] + best["cost"]
        lam = acc["lam"] + eta * (spent - F.col("pace") * (acc["i"] + 1)) / F.greatest(F.col("pace"), F.lit(1e-9))
        return F.struct(F.greatest(F.lit(0.0), lam).alias("lam"), spent.alias("spent"), (acc["lost"] + best["loss"]).alias("lost"), (acc["i"] + 1).alias("i"), F.concat(acc["choices"], F.array(best["m"].cast("int"))).alias("choices"))

    return scans.select(group, F.aggregate("units", zero, step).alias("a")).select(group, F.col("a.i").alias("n"), "a.lam", "a.spent", "a.lost", "a.choices")
