"""Where users bring their own parts: completions, keep rules, row expressions, aggregates, registries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def completed(df: DataFrame, prompt: str, complete: Callable[[list[str]], Iterable[tuple[str, int, int, float]]]) -> DataFrame:
    """df with answer, n_in, n_out and logprob from a completion function, called with a batch of prompts in the workers.

    A null prompt is not completed and has nulls. The function gives one tuple for each prompt, in order.
    """
    fields = "answer string, n_in long, n_out long, logprob double"
    names = [x.split()[0] for x in fields.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            prompts = b.column(prompt).to_pylist()
            given = iter(complete([p for p in prompts if p is not None]))
            rows = [(None,) * 4 if p is None else tuple(next(given)) for p in prompts]
            types = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return df.mapInArrow(run, f"{schema}, {fields}")


def kept(df: DataFrame, keep: Callable[[Column], Column], of: str) -> DataFrame:
    """Rows that a keep rule accepts. The rule is a function of a Column, so it stays in the plan and is pushed down."""
    return df.where(keep(F.col(of)))


def expanded(df: DataFrame, row: Callable[[DataFrame], dict[str, Column]]) -> DataFrame:
    """df with several columns at once from one function of the row."""
    return df.withColumns(row(df))


def aggregated(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Several metrics of each group in one pass, each an aggregate expression."""
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in metrics.items()])


def registered(spark: SparkSession, entries: dict[str, dict], kind: str | None = None) -> DataFrame:
    """A registry as a table: name, type and params; only those of a type where one is given."""
    rows = [(name, e["type"], {k: str(v) for k, v in e.items() if k != "type"}) for name, e in sorted(entries.items()) if kind in (None, e["type"])]
    return spark.createDataFrame(rows, "name string, type string, params map<string, string>")
