"""Joins that need more than a key: intervals, sets, suffixes, deduplicated work, quantifiers, caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, cond: Column, message: str) -> DataFrame:
    """df, failing at run time on a row where cond does not hold."""
    return df.where(F.assert_true(cond, F.lit(message)).isNull())


def aligned(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """df with the features of its key; a key without features fails."""
    return require(df.join(features.withColumn("_has", F.lit(1)), key, "left"), F.col("_has").isNotNull(), f"a {key} has no features").drop("_has")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join of sides on which keys occur once; a key that repeats fails."""
    single = lambda df: require(df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")), key), F.col("_c") == 1, f"{key} repeats").drop("_c")
    return single(left).join(single(right), key, "left")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, point: str, rule: str = "latest", width: int = 64) -> DataFrame:
    """Each point (key, at) with the span of its key that holds it: of several the one that starts last, or the
    shortest. Points without one are left out.

    Spans are dealt to the blocks of ``width`` that they touch, so the join is an equi-join and a hot key spreads.
    """
    blocks = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    hit = points.withColumn("_b", F.floor(F.col(at) / width)).join(blocks, [key, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    rest = [c for c in spans.columns if c != key]
    order = -F.col(start) if rule == "latest" else F.col(end) - F.col(start)
    best = F.min(F.struct(order.alias("_o"), *[F.col(c) for c in rest])).alias("_s")
    return hit.groupBy(key, point, at).agg(best).select(key, point, at, *[F.col(f"_s.{c}").alias(c) for c in rest])


def hits_any(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points inside at least one span of their key."""
    p, s = points.alias("p"), spans.alias("s")
    return p.join(s, (F.col(f"p.{key}") == F.col(f"s.{key}")) & F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}")), "left_semi")


def same_tail(a: Column, b: Column) -> Column:
    """Equal paths, or one is the tail of the other after a slash."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def suffix_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose paths match by tail; the last path part is the equi-key."""
    last = lambda c: F.substring_index(F.col(c), "/", -1)
    return left.withColumn("_k", last(a)).join(right.withColumn("_k", last(b)), "_k").where(same_tail(F.col(a), F.col(b))).drop("_k")


def dedup_apply(df: DataFrame, content: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Does the work once for each distinct content and copies the result to all its rows, by a digest."""
    keyed = df.withColumn("_h", F.sha1(F.col(content)))
    unique = keyed.groupBy("_h").agg(F.any_value(content).alias(content))
    return keyed.join(work(unique).drop(content), "_h", "left").drop("_h")


def for_all(df: DataFrame, keys: list[str], cond: Column, needs_one: bool = False) -> DataFrame:
    """By keys whether cond holds for all rows; with needs_one also that there is one where it is known."""
    return df.groupBy(*keys).agg(F.coalesce(F.every(cond), F.lit(not needs_one)).alias("holds"))


def upsert(cache: DataFrame, new: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """Cache entries, with new values in their place and new keys added; a null new value of a new key is the default."""
    n = new.withColumnRenamed(value, "_new")
    return cache.join(n, keys, "full_outer").select(*keys, F.coalesce("_new", value, F.lit(default)).alias(value))


def reconcile(truth: DataFrame, mine: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Rows by key that one side lacks or on which a measure differs (null-safe): none if the two agree."""
    t = truth.select(*keys, F.lit(1).alias("_t"), *[F.col(m).alias(f"truth_{m}") for m in measures])
    x = mine.select(*keys, F.lit(1).alias("_m"), *[F.col(m).alias(f"mine_{m}") for m in measures])
    same = F.col("_t").isNotNull() & F.col("_m").isNotNull()
    for m in measures:
        same &= F.col(f"truth_{m}").eqNullSafe(F.col(f"mine_{m}"))
    return t.join(x, keys, "full_outer").where(~same).drop("_t", "_m")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the highest order: one aggregate."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [order, *rest]])
