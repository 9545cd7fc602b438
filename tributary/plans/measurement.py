"""The measurement table: one row per unit and model, derived from documents and labels.

A unit is a labelled document; gold marks bad ones, grp is its source and cls its language. Models are a small table of
cost, skill and bias; scores come from plain integer arithmetic on ids, so any engine derives the same table. A verdict
is null where the model gave none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: model number, name, cost per unit in seconds, skill, bias.
POOL = [(0, "tiny", 0.02, 0.10, 0.00), (1, "small", 0.05, 0.25, 0.05), (2, "medium", 0.15, 0.40, -0.05), (3, "large", 0.60, 0.55, 0.00)]

POOL_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({m}, '{n}', {c!r}e0, {s!r}e0, {b!r}e0)" for m, n, c, s, b in POOL) + ") AS t(m, model, unit_cost, skill, bias)"

#: The view as SQL that DuckDB and Spark both read.
UNIT_SQL = """SELECT d.doc_id AS unit_id, d.source AS grp, d.lang AS cls, CAST(1 - l.quality AS BIGINT) AS gold, CAST(d.n_chars AS BIGINT) AS size
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL"""

CTE = f"""WITH pool AS ({POOL_SQL}),
unit AS ({UNIT_SQL}),
probe0 AS (
  SELECT u.unit_id, u.grp, u.cls, u.gold, u.size, p.m, p.model, p.unit_cost,
         (u.unit_id * 7919 + p.m * 104729) % 1000003 AS h, p.skill, p.bias
  FROM unit u CROSS JOIN pool p
),
probe AS (
  SELECT unit_id, grp, cls, gold, size, m, model,
         least(greatest(0.5e0 + skill * (gold - 0.5e0) + bias + 0.9e0 * (h / 1000003e0 - 0.5e0), 0e0), 1e0) AS p,
         CASE WHEN (unit_id * 31 + m * 17) % 23 = 0 THEN NULL
              WHEN 0.5e0 + skill * (gold - 0.5e0) + bias + 0.9e0 * (h / 1000003e0 - 0.5e0) >= 0.5e0 THEN 1 ELSE 0 END AS pred,
         unit_cost * (1e0 + (h % 100) / 100e0) AS seconds
  FROM probe0
)
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession) -> DataFrame:
    """The model pool: a dimension of as many rows as there are models."""
    return spark.createDataFrame(POOL, "m int, model string, unit_cost double, skill double, bias double")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = load(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("unit_id"), F.col("source").alias("grp"), F.col("lang").alias("cls"),
        (1 - F.col("quality")).cast("long").alias("gold"), F.col("n_chars").cast("long").alias("size"),
    )


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long measurement table. The pool is broadcast: it has a row for each model."""
    h = (F.col("unit_id") * 7919 + F.col("m") * 104729) % 1000003
    raw = 0.5 + F.col("skill") * (F.col("gold") - 0.5) + F.col("bias") + 0.9 * (F.col("h") / 1000003.0 - 0.5)
    rows = units(spark, sf_dir).crossJoin(F.broadcast(pool(spark))).withColumn("h", h)
    unparsed = (F.col("unit_id") * 31 + F.col("m") * 17) % 23 == 0
    return rows.select(
        "unit_id", "grp", "cls", "gold", "size", "m", "model",
        F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).alias("p"),
        F.when(unparsed, None).when(raw >= 0.5, 1).otherwise(0).alias("pred"),
        (F.col("unit_cost") * (1.0 + (F.col("h") % 100) / 100.0)).alias("seconds"),
    )

