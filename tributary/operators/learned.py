"""Learned components on pyspark.ml: cost models, soft-target and multi-output logistic regression, calibration, n-grams."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import prefix_sums
from .storage import cut


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="error").transform(df)


def least_squares(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Coefficients by name, with an intercept, in closed form."""
    m = LinearRegression(solver="normal", labelCol=label).fit(assembled(df, columns))
    return df.sparkSession.createDataFrame([*zip(columns, map(float, m.coefficients), strict=True), ("intercept", float(m.intercept))], "term string, value double")


def held_out_r2(train: DataFrame, test: DataFrame, columns: list[str], label: str) -> DataFrame:
    """1 - SSR / SST on test, SST about the train mean: one row."""
    m = LinearRegression(solver="normal", labelCol=label).fit(assembled(train, columns))
    mean = train.agg(F.avg(label).alias("_m"))
    got = m.transform(assembled(test, columns)).crossJoin(F.broadcast(mean))
    return got.agg((1 - F.sum(F.pow(F.col(label) - F.col("prediction"), 2)) / F.sum(F.pow(F.col(label) - F.col("_m"), 2))).alias("r2"))


def char_ngrams(text: str, low: int = 3, high: int = 5):
    """N-grams of characters inside words, words padded by blanks; a padded word no longer than n is one gram, once."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w, n):
        last = F.greatest(F.length(w) - n + 1, F.lit(1))
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.lit(n)))
        return each if n == low else F.when(F.length(w) >= n, each).otherwise(F.array().cast("array<string>"))

    def of(n):  # transform() would hand a second parameter the word's place
        return lambda w: grams(w, n)

    return F.flatten(F.flatten(F.array(*[F.transform(padded, of(n)) for n in range(low, high + 1)])))


def gram_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, tf) of every document that has grams."""
    return docs.select(key, F.explode(char_ngrams(text)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def _gram_counter(low: int = 3, high: int = 5):
    """A function that counts the grams of a lower-cased text as char_ngrams() makes them. It goes to workers by value."""
    import re
    from collections import Counter

    blanks = re.compile("[ \t\n\x0b\f\r]+")

    def of(text: str | None) -> dict[str, int]:
        found: dict[str, int] = {}
        for word, times in Counter(blanks.split(text or "")).items():
            w = f" {word} "
            for n in range(low, high + 1) if word else ():
                for i in range(len(w) - n + 1):
                    gram = w[i : i + n]
                    found[gram] = found.get(gram, 0) + times
        return found

    return of


def _once(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of docs whose key no other row has, and the others, where there are any."""
    again = cut(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col(key).alias("_again")))
    if again.isEmpty():
        return docs, None
    same = F.col(key).eqNullSafe(F.col("_again"))
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


def _gram_totals(docs: DataFrame, text: str, most: int = 1 << 17) -> DataFrame:
    """(gram, df, all): in how many rows of docs a gram is, and how often, summed for about so many grams before they
    leave a task; the rows of one gram are still to be added up."""
    count = _gram_counter()

    def run(batches):
        import pyarrow as pa

        rows: dict[str, int] = {}
        times: dict[str, int] = {}

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array(rows.values(), pa.int64()), pa.array(times.values(), pa.int64())], ["gram", "df", "all"])
            rows.clear()
            times.clear()
            return out

        for b in batches:
            for t in b.column(0):
                for gram, n in count(t.as_py()).items():
                    rows[gram] = rows.get(gram, 0) + 1
                    times[gram] = times.get(gram, 0) + n
                if len(rows) > most:
                    yield told()
        yield told()

    return docs.select(F.lower(text)).mapInArrow(run, "gram string, df long, all long")


def vocabulary(train: DataFrame, key: str, text: str, size: int = 20000, least: int = 3) -> DataFrame:
    """(gram, idf) of the most frequent grams that at least so many documents of train have; ties by gram.

    idf is ln((1 + n) / (1 + documents with it)) + 1. A document is all rows of a key. Those of one row are counted where
    they are read, so what is shuffled is a task's distinct grams; only repeated keys send each document's.
    """
    once, again = _once(train, key)
    rows = _gram_totals(once, text)
    if again is not None:
        rows = rows.union(gram_counts(again, key, text).select("gram", F.lit(1).cast("long"), "tf"))
    by = rows.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("all").alias("all")).where(F.col("df") >= least)
    n = train.agg(F.count(F.lit(1)).alias("_n"))
    return by.orderBy(F.desc("all"), "gram").limit(size).crossJoin(F.broadcast(n)).select("gram", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, gram, weight): counts damped to 1 + ln(tf), times idf, each document's to length 1; rows without key have none.
    words: a vocabulary(), which has a row for each of its bounded number of grams; it is collected, and broadcast.

    A document of one row is weighed where it is read, without a shuffle; only repeated keys' counts meet by key.
    """
    once, again = _once(docs.where(F.col(key).isNotNull()), key)
    idf = {r["gram"]: r["idf"] for r in words.collect()}
    count, shape = _gram_counter(), T.StructType([docs.schema[key], T.StructField("gram", T.StringType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        import math

        import pyarrow as pa

        for b in batches:
            for k, t in enumerate(b.column(1)):
                own = {g: (1 + math.log(n)) * idf[g] for g, n in count(t.as_py()).items() if g in idf}
                length = math.sqrt(sum(w * w for w in own.values()))
                keys = b.column(0).take(pa.array([k] * len(own), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(own.keys(), pa.string()), pa.array([w / length for w in own.values()], pa.float64())], [key, "gram", "weight"])

    weights = once.select(key, F.lower(text)).mapInArrow(run, shape)
    if again is None:
        return weights
    known = docs.sparkSession.createDataFrame([*idf.items()], "gram string, idf double")
    met = gram_counts(again, key, text).join(F.broadcast(known), "gram").withColumn("_w", (1 + F.ln("tf")) * F.col("idf"))
    length = met.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return weights.union(met.join(length, key).select(key, "gram", (F.col("_w") / F.col("_l")).alias("weight")))


def standardised(train: DataFrame, columns: list[str], category: str | None = None):
    """Scaling fitted on train; an unseen category has zeros."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
    last = ["_scaled"]
    if category:
        stages += [StringIndexer(inputCol=category, outputCol="_cat", handleInvalid="keep"), OneHotEncoder(inputCol="_cat", outputCol="_hot", handleInvalid="keep")]
        last.append("_hot")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=last, outputCol="features")]).fit(train)


def best_threshold(df: DataFrame, keys: list[str], score: str = "p", gold: str = "gold") -> DataFrame:
    """By keys the cut (score >= cut) with the best accuracy, the highest among equals, from running counts."""
    by = df.groupBy(*keys, score).agg(F.sum(gold).alias("g"), F.count(F.lit(1)).alias("n"))
    total = df.groupBy(*keys).agg(F.sum(gold).alias("pos"), F.count(F.lit(1)).alias("all"))
    walk = prefix_sums(by, keys, [F.desc(score)], {"tp": F.col("g"), "sel": F.col("n")}).join(total, keys)
    right = F.col("tp") + (F.col("all") - F.col("pos")) - (F.col("sel") - F.col("tp"))
    return walk.groupBy(*keys).agg(F.max(F.struct((right / F.col("all")).alias("accuracy"), F.col(score).alias("cut"))).alias("b")).select(*keys, "b.cut", "b.accuracy")


def auc_scan(df: DataFrame, columns: list[str], gold: str = "gold") -> DataFrame:
    """The AUC of each raw column."""
    from .ranking import auc

    long = df.select(gold, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(gold, "x.*")
    return auc(long, ["feature"], "value", gold)


def newton_logistic(rows: DataFrame, keys: list[str], columns: list[str], target: str, l2: str, rounds: int = 40) -> DataFrame:
    """Logistic regressions of all keys at once, on targets from 0 to 1: keys, coefficients (intercept first) and whether
    the last step was below 1e-9; on separable rows without a weight there is no optimum, and none is.

    Each round is one aggregate over all rows, of as many sums as a Hessian has entries; the small systems, one for each
    key, are solved on the driver. The number of keys is a grid's, not the data's. The column l2 weighs half the squared
    coefficients against the mean loss; the intercept is free.
    """
    import numpy as np

    d = len(columns) + 1
    spark = rows.sparkSession
    rows = rows.select(*dict.fromkeys([*keys, *columns, target, l2])).persist()
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    shape = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", beta array<double>"
    settled: dict[tuple, bool] = {}
    found = {tuple(r): np.zeros(d) for r in rows.select(*keys).distinct().collect()}
    for _ in range(rounds):
        table = spark.createDataFrame([(*k, b.tolist()) for k, b in found.items()], shape)
        joined = rows.join(F.broadcast(table), keys)
        p = 1 / (1 + F.exp(-sum((x[i] * F.col("beta")[i] for i in range(1, d)), F.col("beta")[0])))
        joined = joined.withColumns({"_p": p})
        sums = [F.avg((F.col("_p") - F.col(target)) * x[i]).alias(f"g{i}") for i in range(d)]
        sums += [F.avg(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        moved = 0.0
        for r in joined.groupBy(*keys).agg(F.first(l2).alias("_l2"), *sums).collect():
            own = tuple(r[k] for k in keys)
            free = np.array([0.0] + [1.0] * (d - 1)) * r["_l2"]
            g = np.array([r[f"g{i}"] for i in range(d)]) + free * found[own]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + np.diag(free + 1e-12)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-300))
            found[own] = found[own] - step
            settled[own] = bool(np.abs(step).max() < 1e-9)
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    rows.unpersist()
    return spark.createDataFrame([(*k, b.tolist(), settled.get(k, False)) for k, b in found.items()], shape + ", converged boolean")


def predicted(df: DataFrame, fitted: DataFrame, keys: list[str], columns: list[str], name: str = "prob") -> DataFrame:
    """df with the probabilities of fitted (keys, beta), which is a grid's and broadcast."""
    z = sum((F.col(c).cast("double") * F.col("beta")[i + 1] for i, c in enumerate(columns)), F.col("beta")[0])
    return df.join(F.broadcast(fitted), keys).withColumn(name, 1 / (1 + F.exp(-z))).drop("beta", "converged")


def l2_grid(df: DataFrame, model: str, columns: list[str], target: str, fold: str, grid: list[float]) -> DataFrame:
    """For each model the L2 weight of the grid with the least mean cross-entropy over held-out folds (the smallest among
    equals), and that entropy. All models, folds and weights are fitted in the same passes."""
    spark = df.sparkSession
    cells = df.select(F.col(fold).alias("_held")).distinct().crossJoin(spark.createDataFrame([(x,) for x in grid], "l2 double"))
    keys = [model, "_held", "l2"]
    every = df.crossJoin(F.broadcast(cells))
    fitted = newton_logistic(every.where(F.col(fold) != F.col("_held")), keys, columns, target, "l2")
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-12)), F.lit(1 - 1e-12))
    test = predicted(every.where(F.col(fold) == F.col("_held")), fitted, keys, columns)
    loss = test.groupBy(model, "l2").agg(F.avg(-(F.col(target) * F.ln(p) + (1 - F.col(target)) * F.ln(1 - p))).alias("bce"))
    return loss.groupBy(model).agg(F.min(F.struct(F.round("bce", 9).alias("bce"), "l2")).alias("_b")).select(model, "_b.l2", "_b.bce")
