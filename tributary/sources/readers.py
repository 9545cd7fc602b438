"""Readers of JSON lines, CSV dialects, nested reports, XML, logs and folders; sinks that can resume.

All go through Spark's readers, so any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import prefix_sums

#: A static-analysis report, as far as it is read (fixed format).
REPORT = """runs array<struct<results: array<struct<
  ruleId: string, message: struct<text: string>,
  codeFlows: array<struct<threadFlows: array<struct<locations: array<struct<location: struct<
    message: struct<text: string>, physicalLocation: struct<
      artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int, startColumn: int>>>>>>>>>>>>>"""


def json_lines(spark: SparkSession, path: str, schema: str, corrupt: bool = False) -> DataFrame:
    """One row for each line; a torn line gives nulls, or with corrupt its text in _corrupt."""
    extra = ", _corrupt string" if corrupt else ""
    reader = spark.read.schema(schema + extra).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def keyed_by_name(df: DataFrame, name: str = "model", pattern: str = r"([^/]+)__[^/]*$") -> DataFrame:
    """A column from the file's name."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, by the first character."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    whole = bool(head) and head[0].value.lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def csv(spark: SparkSession, path: str, sep: str = ",", comment: str | None = None, keep_empty: bool = False) -> DataFrame:
    """All columns as strings. With keep_empty an empty cell is '' and not null."""
    reader = spark.read.option("header", True).option("sep", sep)
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    return df.fillna("") if keep_empty else df


def number(column: str, default: float | None = 0.0) -> Column:
    value = F.expr(f"try_cast(`{column}` as double)")
    return value if default is None else F.coalesce(value, F.lit(default))


def report_steps(spark: SparkSession, path: str, all_runs: bool = False, first_flow_only: bool = False) -> DataFrame:
    """The steps of the reports under path, one report to a file."""
    return steps_of(spark.read.schema(REPORT).option("multiLine", True).json(path), all_runs, first_flow_only)


def steps_of(runs: DataFrame, all_runs: bool = False, first_flow_only: bool = False) -> DataFrame:
    """A row for each step of each flow: result_id, flow_id, step, rule, message, file, line, end_line, step_message.

    A missing end line is the start line. Results without flows give no rows.
    """
    run = F.explode("runs") if all_runs else F.get("runs", F.lit(0))
    results = runs.select(run.alias("run")).select(F.posexplode("run.results").alias("result_id", "r"))
    flows = F.slice("r.codeFlows", 1, 1) if first_flow_only else F.col("r.codeFlows")
    flow = results.select("result_id", F.col("r.ruleId").alias("rule"), F.col("r.message.text").alias("message"), F.posexplode(flows).alias("flow_id", "f"))
    steps = flow.select("result_id", "flow_id", "rule", "message", F.posexplode(F.get("f.threadFlows", F.lit(0))["locations"]).alias("step", "l"))
    region = F.col("l.location.physicalLocation.region")
    return steps.select(
        "result_id", "flow_id", "step", "rule", F.left("message", F.lit(500)).alias("message"),
        F.col("l.location.physicalLocation.artifactLocation.uri").alias("file"), region["startLine"].alias("line"),
        F.coalesce(region["endLine"], region["startLine"]).alias("end_line"), F.col("l.location.message.text").alias("step_message"),
    )


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("rowTag", tag).xml(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stems(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths by canonical stem: parts a, b, ... of one program come together."""
    stem = F.regexp_replace(F.substring_index(F.substring_index(F.col(path), "/", -1), ".", 1), r"(_\d+)[a-g]$", "$1")
    return paths.groupBy(stem.alias("stem")).agg(F.array_sort(F.collect_list(path)).alias("paths"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line number (from 1) and value, from whole files."""
    files = whole_files(spark, path)
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "value")).select("path", (F.col("n") + 1).alias("line"), "value")


def paired(lines: DataFrame, key_pattern: str, value_pattern: str, file: str = "path", order: str = "line") -> DataFrame:
    """Each value line with the nearest key line before it; values without one, and keys passed by, are left out."""
    key, value = F.regexp_extract("value", key_pattern, 1), F.regexp_extract("value", value_pattern, 1)
    w = Window.partitionBy(file).orderBy(order)
    before = F.last(F.when(key != "", key), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return lines.select(file, order, before.alias("key"), value.alias("found")).where("found <> '' and key is not null")


def markers(text: str | Column, marks: list[str]) -> list[Column]:
    """How often each literal mark occurs."""
    c = F.col(text) if isinstance(text, str) else text
    return [((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m)).cast("int").alias(f"n_{k}") for k, m in enumerate(marks)]


def sharded_pairs(lines: DataFrame, key_pattern: str, value_pattern: str, file: str = "path", order: str = "line", shard: str = "shard") -> DataFrame:
    """Values paired with the pending key where exactly one shard of the file has one pending; others are ambiguous.

    A key line makes its first group pending for its shard, in place of an earlier one; a value line takes what is pending
    and clears it. So a value looks back to the value before it: what lies between is one group, numbered by running
    counts of values, and a file of any length lies in many tasks. Gives file, order, key and found.
    """
    text = F.coalesce("value", F.lit(""))
    is_key = text.rlike(key_pattern)
    is_value = ~is_key & text.rlike(value_pattern)
    rows = lines.select(file, F.col(order).cast("long").alias(order), shard, is_key.alias("_k"), is_value.alias("_v"), F.when(is_key, F.regexp_extract(text, key_pattern, 1)).when(is_value, F.regexp_extract(text, value_pattern, 1)).alias("_t"))
    counted = prefix_sums(rows.where("_k or _v"), [file], [order], {"_n": F.col("_v").cast("long")})
    turn = F.col("_n") - F.col("_v").cast("long")
    keys = F.count_distinct(F.when(F.col("_k"), F.coalesce(F.col(shard).cast("string"), F.lit("\0none"))))
    latest = F.max(F.when(F.col("_k"), F.struct(order, "_t")))
    value = F.max(F.when(F.col("_v"), F.struct(order, "_t")))
    met = counted.groupBy(file, turn.alias("_turn")).agg(keys.alias("_shards"), latest.alias("_key"), value.alias("_value"))
    return met.where("_shards = 1 and _value is not null").select(file, F.col(f"_value.{order}").alias(order), F.col("_key._t").alias("key"), F.col("_value._t").alias("found"))


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the folder does not hold yet, as JSON lines: a run can stop and go on."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti").select(df.columns)
    df.write.mode("append").json(path)
    return spark.read.schema(df.schema).json(path)


def memoised(spark: SparkSession, path: str, make) -> DataFrame:
    """The table under path; made and written first where it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of so many rows at most, as it goes to the driver; a last row of … says that there are more."""
    head, rows = df.columns, df.limit(most + 1).collect()
    if len(rows) > most:
        rows[most:] = [["…"] * len(head)]
    cells = [" | ".join("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r) for r in rows]
    return "\n".join([f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {c} |" for c in cells)])


#: What alerts() reads of a report: all runs, the place of each result, and its flows.
ALERTS = REPORT.replace("ruleId: string,", "ruleId: string, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>,")


def alerts(reports: DataFrame) -> DataFrame:
    """A row for each result of all runs that names a file, with the steps of its first flow only; results equal in rule,
    place and steps count once, with the smallest message. Without steps the source is the sink.
    """
    result = reports.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    locations = F.get(F.get("r.codeFlows", F.lit(0))["threadFlows"], F.lit(0))["locations"]
    step = lambda x: F.struct(
        x["location"]["physicalLocation"]["artifactLocation"]["uri"].alias("file"), x["location"]["physicalLocation"]["region"]["startLine"].alias("line")
    )
    rows = result.select(
        F.col("r.ruleId").alias("rule"), F.left("r.message.text", F.lit(500)).alias("message"), place["artifactLocation"]["uri"].alias("sink_file"),
        place["region"]["startLine"].alias("sink_line"), F.coalesce(F.transform(locations, step), F.array().cast("array<struct<file:string,line:int>>")).alias("steps"),
    ).where("sink_file is not null")
    key = ["rule", "sink_file", "sink_line", "steps"]
    one = rows.groupBy(*key).agg(F.min("message").alias("message"))
    first = F.get("steps", F.lit(0))
    return one.select(
        F.sha1(F.to_json(F.struct(*key))).alias("alert_id"), "rule", "message", "sink_file", "sink_line",
        F.coalesce(first["file"], "sink_file").alias("source_file"), F.coalesce(first["line"], "sink_line").alias("source_line"),
        F.size("steps").alias("n_steps"), (F.size(F.array_distinct(F.transform("steps", lambda x: x["file"]))) > 1).alias("cross_file"),
    )


def array_rows(files: DataFrame) -> DataFrame:
    """Rows of array files (path, content), as the binaryFile source gives them: path, name (of the array in an archive,
    else empty), row and values. An array of one axis has one value a row; pickled objects are refused.
    """

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for name, array in ([("", got)] if isinstance(got, np.ndarray) else got.items()):
                    flat = array.reshape(len(array), -1).astype(np.float64)
                    for a in range(0, len(flat), 4096):
                        part = flat[a : a + 4096]
                        ends = np.arange(len(part) + 1, dtype=np.int32) * flat.shape[1]
                        cols = [pa.array([path] * len(part)), pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))]
                        yield pa.RecordBatch.from_arrays(cols, ["path", "name", "row", "values"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, row long, values array<double>")
