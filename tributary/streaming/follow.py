"""Following a folder that grows until a flag file says that nothing more comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, by the file system of its path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Failed(RuntimeError):
    """The writer of a followed folder gave up."""


def follow(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, done: str, failed: str | None = None, mode: str = "append",
    every: str = "1 second", until: Callable[[], bool] | None = None,
) -> bool:
    """Processes what arrives, every so often, until the file ``done`` is there and all that came before it is taken.

    stream: a streaming plan over files. State and the files already taken are kept under checkpoint, so a run that was
    stopped, lost its driver, or ended early goes on where it was; sink(rows, epoch) may see the last epoch again and must
    overwrite by epoch. Returns True at the flag; False where until() first says to stop. Raises Failed at ``failed``.
    """
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        while q.isActive:
            if failed and exists(spark, failed):
                raise Failed(failed)
            # the flag is looked for first: files written before it are then there to be listed
            ended = exists(spark, done)
            if ended or until and until():
                q.processAllAvailable()
                return ended
            q.awaitTermination(0.5)
        q.awaitTermination()  # raises what ended the query
        return False
    finally:
        q.stop()


def overwritten_by_epoch(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each epoch's rows in a folder of its own."""
    return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def latest(spark: SparkSession, folder: str, keys: list[str], schema) -> DataFrame:
    """Of updates written by overwritten_by_epoch(), each key's last."""
    from pyspark.sql.types import LongType

    rows = spark.read.schema(schema.add("epoch", LongType()) if "epoch" not in schema.fieldNames() else schema).parquet(folder)
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    last = F.max_by(F.struct(*rest), "epoch").alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")
