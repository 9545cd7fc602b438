"""Message passing over the bipartite graph of units and models.

A node carries an array of features; in each round it takes the mean of its neighbours' arrays, weighted by the edge, and
moves half of the way there. Only edges marked as seen carry messages, so held-out edges can be scored from what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learned import newton_logistic, predicted
from .sizes import small
from .storage import cut


def _moved(nodes: DataFrame, messages: DataFrame, key: str, width: int) -> DataFrame:
    """nodes (key, x) after the mean of messages (key, w, y) by key; one without messages stays where it is.

    Each place of the arrays is an aggregate of its own, so a node with many edges is summed up before the shuffle.
    """
    sums = [F.avg(F.col("w") * F.get("y", F.lit(k))).alias(f"_m{k}") for k in range(width)]
    mean = messages.groupBy(key).agg(*sums).select(key, F.array(*[f"_m{k}" for k in range(width)]).alias("_mean"))
    half = F.zip_with("x", "_mean", lambda a, b: (a + b) / 2)
    return nodes.join(mean, key, "left").select(key, F.when(F.col("_mean").isNull(), F.col("x")).otherwise(half).alias("x"))


def pass_messages(units: DataFrame, models: DataFrame, edges: DataFrame, width: int, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(units, models) after so many rounds; both sides move at once.

    units: unit_id, x; models: m, x (arrays of one width); edges: unit_id, m, w, seen. An edge counts as often as it
    stands there, and one whose node is missing, or whose w is null, carries nothing. Units and models are written after
    each round. The models' side is broadcast where its counted rows allow.
    """
    kept = cut(edges.where("seen and w is not null").select("unit_id", "m", "w"), "edges")
    for _ in range(rounds):
        to_units = kept.join(small(models.select("m", F.col("x").alias("y"))), "m")
        to_models = kept.join(units.select("unit_id", F.col("x").alias("y")), "unit_id")
        units, models = cut(_moved(units, to_units, "unit_id", width), "units"), cut(_moved(models, to_models, "m", width), "models")
    return units, models


def _met(units: DataFrame, models: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    rows = edges.join(units, "unit_id").join(small(models.select("m", F.col("x").alias("y"))), "m")
    return rows.withColumns({f"f{k}": F.get("x", F.lit(k)) * F.get("y", F.lit(k)) for k in range(width)}).drop("x", "y")


def link_scores(units: DataFrame, models: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """Held-out edges (seen is false) with score, the inner product of their two ends."""
    total = sum((F.col(f"f{k}") for k in range(1, width)), F.col("f0"))
    return _met(units, models, edges.where("not seen"), width).withColumn("score", total).drop(*[f"f{k}" for k in range(width)])


def predicted_links(units: DataFrame, models: DataFrame, edges: DataFrame, width: int, target: str, l2: float = 1e-4) -> DataFrame:
    """Held-out edges with prob, by a logistic fit on the products of the ends' features over the seen edges."""
    columns = [f"f{k}" for k in range(width)]
    rows = cut(_met(units, models, edges, width).withColumns({"_one": F.lit(1), "_l2": F.lit(l2)}), "links")
    fitted = newton_logistic(rows.where(F.col("seen") & F.col(target).isNotNull()), ["_one"], columns, target, "_l2")
    return predicted(rows.where("not seen"), fitted, ["_one"], columns).drop("_one", "_l2", *columns)
