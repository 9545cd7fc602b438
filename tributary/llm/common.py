"""What the training-data operators share: shared folders, table access, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where they share the driver's file system (local mode, tests)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    # texts are long: Arrow batches of so many rows and bytes (one row at least) bound the memory of both sides
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


_held: dict[str, object] = {}


def worker_cache(name: str, make):
    """What a Python worker keeps from task to task: one operator's cache at a time, so caches do not add up."""
    if name not in _held:
        if _held:
            _held.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # give the freed memory back, where the C library can
                ctypes.CDLL(None).malloc_trim(0)
        _held[name] = make()
    return _held[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a
    temporary folder; a cluster's executors could not see that, so there it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    top = top or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def stored(df: DataFrame, name: str, codec: str | None = None, **options) -> DataFrame:
    """Writes df as Parquet (options: the writer's) to the shared folder and reads it back: cuts lineage and survives lost
    executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    writer.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored() frame that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_stored_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: With more links than this a node may be hot: one with more than HOT_SHARE of them, of which there are 1 / HOT_SHARE
#: at most. With fewer, a task reads all links of a node in a second.
HOT_LINKS, HOT_SHARE = 1_000_000, 1 / 1000


def _to_lowest(rows: DataFrame, low: DataFrame, links: int) -> DataFrame:
    """rows (a, b) with m, the smallest node that low (a, m, n) has for a; n counts a's links.

    The sides, of a row for each link or node, are merged, whatever the planner's limit for broadcasts, so neither passes
    through the driver. Where a node is hot, low is written first: then the join's shuffles stand alone, and adaptive
    execution can split the hot node's links.
    """
    if links > HOT_LINKS and not low.where(F.col("n") > int(links * HOT_SHARE)).isEmpty():
        low = stored(low, "cc-lowest")
    return rows.join(low.select("a", "m").hint("merge"), "a").select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), as (node, root), root being the smallest node of a component.

    Alternates large-star and small-star steps until nothing moves: every step is a shuffle of at most the number of
    edges, links of each node go to its smallest neighbour, and the edges are written to the shared folder between the
    steps. Only a count and a sum come to the driver. Smallest neighbours are pre-aggregated by min().
    """
    # each undirected edge as (high, low)
    cur = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )

    def state(e: DataFrame) -> tuple[int, str]:
        n, digest = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return n, str(digest)

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))

    def large(e: DataFrame, links: int) -> DataFrame:
        both = e.union(e.select("b", "a"))
        low = lowest(both).select("a", F.least("a", "m").alias("m"), "n")
        return _to_lowest(both.where("b > a"), low, links).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame, links: int) -> DataFrame:
        low = lowest(e)
        moved = _to_lowest(e, low, links).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select("a", F.col("m").alias("b")))

    was = state(cur)
    while True:
        nxt = stored(small(large(cur, 2 * was[0]).where("a <> b"), was[0]).where("a > b").distinct(), "cc")
        drop_stored(cur)
        cur, got = nxt, state(nxt)
        if got == was:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = got
