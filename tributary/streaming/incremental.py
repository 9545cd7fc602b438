"""Operators over growing inputs: resume, ordered state, windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered, prefix_max, prefix_sums
from ..operators.storage import cut


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once_each(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once, while it can still come again within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; in a stream late rows are dropped after the watermark."""
    rows = df.withWatermark(ts, late) if late else df
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Takes all there is in batches and stops; the checkpoint lets a later run go on."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def cached_verdicts(alarms: DataFrame, group: str = "project", order: str = "ord") -> DataFrame:
    """Verdicts with memory, in order within a project: a flow (source, sink) seen before keeps its verdict; one of a
    rejected source or sink is rejected; else the row's own verdict holds and, if it rejects, blames a side.

    alarms: project, ord, source, sink, verdict (0 or 1), blame ('source', 'sink' or null); ord does not repeat in a
    project. Gives project, ord, source, sink, final and why.

    Only a flow's first row decides. A source is rejected from the first row on that blames it while its sink is not yet
    rejected, and a sink likewise, so the times of sources and of sinks each follow from the other's. They are taken in
    turn until none changes: what lies before the first wrong time is right, so each round puts at least one more right.
    All is joins and minima by (project, source) and (project, sink); no project is gathered.
    """
    side = ["source", "sink"]
    rows = alarms.select(group, order, "source", "sink", "verdict", "blame")
    first = rows.groupBy(group, *side).agg(F.min(F.struct(order, "verdict", "blame")).alias("_f"))
    first = cut(first.select(group, *side, F.col(f"_f.{order}").alias("_at"), F.col("_f.verdict").alias("_own"), F.col("_f.blame").alias("_blame")), "flows")
    blames = {s: first.where((F.col("_own") == 0) & (F.col("_blame") == s)).select(group, *side, "_at") for s in side}
    times = {s: first.select(group, s, F.col("_at").alias(f"_t_{s}")).limit(0) for s in side}

    def rejected(s: str) -> DataFrame:
        """When each source, or sink, is first blamed by a row whose other side is not rejected before."""
        o = side[1 - side.index(s)]
        met = blames[s].join(times[o], [group, o], "left").where(F.col(f"_t_{o}").isNull() | (F.col(f"_t_{o}") > F.col("_at")))
        return cut(met.groupBy(group, s).agg(F.min("_at").alias(f"_t_{s}")), "rejected")

    mark = lambda df, s: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(group, s, f"_t_{s}").cast("decimal(20,0)"))).first()
    was = None
    while True:
        times["source"] = rejected("source")
        times["sink"] = rejected("sink")
        now = [mark(times[s], s) for s in side]
        if now == was:
            break
        was = now
    by = {s: F.col(f"_t_{s}") < F.col("_at") for s in side}
    judged = first.join(times["source"], [group, "source"], "left").join(times["sink"], [group, "sink"], "left")
    why = F.when(by["source"], "source").when(by["sink"], "sink").otherwise("own")
    judged = judged.select(group, *side, "_at", why.alias("_why"), F.when(why == "own", F.col("_own").cast("int")).otherwise(0).alias("final"))
    again = F.when(F.col(order) == F.col("_at"), F.col("_why")).otherwise("flow")
    return rows.join(judged, [group, *side]).select(group, order, *side, "final", again.alias("why"))


def stop_early(ranked: DataFrame, keys: list[str], batch: int, k: int, patience: int) -> DataFrame:
    """Reading a ranking in batches, stop after ``patience`` batches that leave the top k by a second score unchanged.

    ranked: keys, rn (from 1), second (not null). Gives keys and n_read. A row enters the running top k when fewer than k
    earlier rows are as good; batches with such a row change it.

    The running top k is a cascade: the largest so far is a running maximum, and what it displaces, the smaller of a row
    and the largest before it, is offered to the next place, and so on. Each place is a pass by ranges, so a group of any
    size lies in many tasks.
    """
    rows = ranked.select(*keys, "rn", F.col("second").alias("_d"), F.col("second").alias("_second"))
    for _ in range(k):
        met = prefix_max(rows.select(*keys, "rn", "_second", "_d"), keys, ["rn"], {"_top": F.col("_d")}, before=True)
        # least passes nulls over: where a place is empty nothing is displaced
        displaced = F.when(F.col("_top").isNotNull(), F.least("_d", "_top"))
        rows = met.select(*keys, "rn", "_second", displaced.alias("_d"), F.col("_top").alias("_last"))
    enters = F.col("_last").isNull() | (F.col("_second") > F.col("_last"))
    at = F.floor((F.col("rn") - 1) / batch)
    batches = rows.groupBy(*keys, at.alias("_b")).agg(F.max(F.when(enters, at)).alias("_changed"), F.count(F.lit(1)).alias("_n"))
    quiet = prefix_max(batches, keys, ["_b"], {"_change": F.col("_changed")}).withColumn("_quiet", F.col("_b") - F.col("_change"))
    ends = quiet.groupBy(*keys).agg(F.min(F.when(F.col("_quiet") >= patience, F.col("_b"))).alias("_stop"), F.sum("_n").alias("_all"))
    return ends.select(*keys, F.least("_all", (F.col("_stop") + 1) * batch).cast("long").alias("n_read"))


def consecutive_pairs(df: DataFrame, key: str, target: str, order: str) -> DataFrame:
    """Greedy pairs of neighbours in a key's order with different targets: a row belongs to one pair at most.

    Rows whose targets differ from one to the next are an island, and inside one the greedy rule takes the first with the
    second, the third with the fourth, and so on; a row left over at its end has the same target as the next. Rows are
    numbered and islands counted by ranges, so a key of any size lies in many tasks. order must not repeat in a key.
    """
    rows = numbered(df.select(key, target, order), [key], [order], "_r")
    after = rows.select(key, (F.col("_r") - 1).alias("_r"), F.col(target).alias("_t"), F.col(order).alias("_next"))
    met = cut(rows.join(after, [key, "_r"], "left").withColumn("_same", (F.col("_next").isNotNull() & F.col(target).eqNullSafe(F.col("_t"))).cast("int")), "neighbours")
    # an island ends with a row that is like the next one
    counted = prefix_sums(met, [key], ["_r"], {"_ends": F.col("_same")}).withColumn("_island", F.col("_ends") - F.col("_same"))
    first = counted.groupBy(key, "_island").agg(F.min("_r").alias("_first"))
    pair = (F.col("_same") == 0) & F.col("_next").isNotNull() & ((F.col("_r") - F.col("_first")) % 2 == 0)
    return counted.join(first, [key, "_island"]).where(pair).select(key, F.col(order).alias("first"), F.col("_next").alias("second"))


def last_known(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Forward fill."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time: one union, one window."""
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")
