"""Queries that write driver tables in a source's format to the shared folder and read them back with its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..sources import readers as rd
from .core import fin
from .measurement import load
from .registry import query


def folder(spark) -> str:
    return f"{shared_dir(spark)}/tributary/format-{uuid.uuid4().hex}"


def jsonl(s, d):
    path = folder(s)
    load(s, d, "labels").write.json(path)
    return path


LABELS = "doc_id bigint, quality bigint, toxic bigint"
query("sc1_json_lines", "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels")(lambda s, d: rd.json_lines(s, jsonl(s, d), LABELS))


@query("sc2_key_from_file_name", "SELECT doc_id, CASE toxic WHEN 1 THEN 'toxic' ELSE 'plain' END AS model FROM labels")
def key_from_file_name(s, d):
    path = folder(s)
    labels = load(s, d, "labels")
    for name, toxic in (("toxic", 1), ("plain", 0)):
        labels.where(F.col("toxic") == toxic).write.json(f"{path}/{name}__labels.jsonl")
    df = s.read.schema("doc_id bigint").json(f"{path}/*__labels.jsonl")
    return rd.keyed_by_name(df, pattern=r"([^/]+)__labels[.]jsonl/[^/]*$").select("doc_id", "model")


@query("sc3_json_array", "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels")
def json_array(s, d):
    path = folder(s)
    rows = load(s, d, "labels").select(F.to_json(F.struct("doc_id", "quality")).alias("j"), (F.col("doc_id") % 4).alias("part"))
    rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).repartition(1, "part").write.partitionBy("part").text(path)
    return rd.json_any(s, path, "doc_id bigint, quality bigint").select("doc_id", "quality")


@query("sc4_sc7_csv_numbers", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0e0 ELSE CAST(n_chars AS DOUBLE) END AS n FROM documents")
def csv_numbers(s, d):
    path = folder(s)
    load(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "N/A").otherwise(F.col("n_chars").cast("string")).alias("n")).write.option("header", True).option("sep", ";").csv(path)
    return rd.csv(s, path, ";").select(F.col("doc_id").cast("long").alias("doc_id"), rd.number("n").alias("n"))


@query("sc5_empty_cells", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS lang FROM documents")
def empty_cells(s, d):
    path = folder(s)
    load(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang")).write.option("header", True).csv(path)
    return rd.csv(s, path, keep_empty=True).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")


@query("sc6_comment_lines", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def comment_lines(s, d):
    path = folder(s)
    load(s, d, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "# ").otherwise(""), F.col("doc_id").cast("string")).alias("doc_id")).write.text(path)
    return s.read.schema("doc_id bigint").option("comment", "#").csv(path)


@query("sc8_whole_files", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE NOT contains(text, chr(13)) GROUP BY source")
def whole_files(s, d):
    """A file is read as one row, so a source's texts go to as many files as hold 500 each, written where they are read."""
    path = folder(s)
    docs = load(s, d, "documents").where(~F.contains("text", F.lit("\r")))
    docs.select("source", F.regexp_replace("text", "\n", " ").alias("value")).write.partitionBy("source").option("lineSep", "\u0001").option("maxRecordsPerFile", 500).text(path)
    files = s.read.schema("value string, source string").text(path, wholetext=True)
    return files.groupBy("source").agg(F.sum(F.length(F.replace("value", F.lit("\u0001"), F.lit("")))).alias("chars"))


query("sc9_stems", "SELECT regexp_replace(split_part(split_part(url, '/', -1), '.', 1), '(_[0-9]+)[a-g]$', '\\1') AS stem, count(*) AS n FROM pages GROUP BY 1")(
    lambda s, d: rd.stems(load(s, d, "pages").select("url"), "url").select("stem", F.size("paths").cast("long").alias("n"))
)


@query("sc10_report_steps", "SELECT conv_id AS rule, turn AS step, role AS file, turn + 1 AS line, text AS step_message FROM conversations")
def report_steps(s, d):
    path = folder(s)
    loc = F.struct(F.struct(F.struct(F.col("text")).alias("message"), F.struct(F.struct(F.col("role").alias("uri")).alias("artifactLocation"), F.struct((F.col("turn") + 1).alias("startLine")).alias("region")).alias("physicalLocation")).alias("location"))
    flows = load(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", loc.alias("l")))), lambda x: x["l"]).alias("locations"))
    results = flows.select((F.col("conv_id") % 8).alias("part"), F.struct(F.col("conv_id").cast("string").alias("ruleId"), F.struct(F.lit("m").alias("text")).alias("message"), F.array(F.struct(F.array(F.struct("locations")).alias("threadFlows"))).alias("codeFlows")).alias("r"))
    results.groupBy("part").agg(F.array(F.struct(F.collect_list("r").alias("results"))).alias("runs")).select("runs").repartition(8, F.rand(1)).write.json(path)
    got = rd.steps_of(s.read.schema(rd.REPORT).json(path))  # reports one to a line
    return got.select(F.col("rule").cast("long").alias("rule"), F.col("step").cast("long").alias("step"), "file", F.col("line").cast("long").alias("line"), "step_message")


@query("sc12_xml", "SELECT p_partkey, p_name FROM part")
def xml(s, d):
    path = folder(s)
    load(s, d, "part").select("p_partkey", "p_name").write.option("rowTag", "Part").option("rootTag", "Parts").xml(path)
    return rd.xml_rows(s, path, "Part", "p_partkey bigint, p_name string")


query("sc13_build_probe", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")(lambda s, d: load(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")))
query("sc14_last_row_wins", "SELECT l_partkey, max_by(l_suppkey, l_orderkey * 10 + l_linenumber) AS kind FROM (SELECT l_partkey, l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3) GROUP BY l_partkey")(
    lambda s, d: load(s, d, "lineitem").groupBy("l_partkey").agg(F.max(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_suppkey"))["l_suppkey"].alias("kind"))
)
EVENT_LINES = "WITH x AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN event_id END AS k, event_type FROM events), y AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS key FROM x)"
query("sc15_log_pairs", EVENT_LINES + " SELECT event_id, key FROM y WHERE event_type = 'purchase' AND key IS NOT NULL")(
    lambda s, d: rd.paired(load(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line"), F.concat_ws(" ", "event_type", "event_id").alias("value")), r"^view (\d+)", r"^purchase (\d+)").select(F.col("found").cast("long").alias("event_id"), F.col("key").cast("long").alias("key"))
)
@query("sc16_sharded_pairs", """WITH x AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS line, event_id % 2 AS shard, event_type AS t FROM events WHERE event_type IN ('view', 'purchase')),
g AS (SELECT *, count(CASE WHEN t = 'purchase' THEN 1 END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM x)
SELECT path, max(CASE WHEN t = 'purchase' THEN line END) AS line, CAST(max(CASE WHEN t = 'view' THEN line END) AS VARCHAR) AS key, CAST(max(CASE WHEN t = 'purchase' THEN line END) AS VARCHAR) AS found
FROM g GROUP BY path, coalesce(g, 0) HAVING count(DISTINCT CASE WHEN t = 'view' THEN shard END) = 1 AND max(CASE WHEN t = 'purchase' THEN line END) IS NOT NULL""")
def sharded(s, d):
    """Purchases paired with the view before them, where all views since the last purchase are of one shard."""
    lines = load(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line"), (F.col("event_id") % 2).cast("string").alias("shard"), F.concat_ws(" ", "event_type", "event_id").alias("value"))
    return rd.sharded_pairs(lines, r"^view (\d+)", r"^purchase (\d+)")


query("sc17_markers", "SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS n_0, CAST((length(html) - length(replace(html, '<li>', ''))) / 4 AS BIGINT) AS n_1 FROM pages")(lambda s, d: fin(load(s, d, "pages").select("page_id", *rd.markers("html", ["<p>", "<li>"]))))
query("sc18_busy_time", "SELECT event_type, 10 * count(*) AS seconds FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND value > 0 GROUP BY 1")(
    lambda s, d: load(s, d, "events").where("ts between timestamp '2024-01-05' and timestamp '2024-01-12' and value > 0").groupBy("event_type").agg((10 * F.count(F.lit(1))).alias("seconds"))
)


@query("sc23_append_and_resume", "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels")
def append_and_resume(s, d):
    path = folder(s)
    rows = load(s, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    rd.append_new(rows.where("doc_id % 2 = 0"), path, "doc_id")
    return rd.append_new(rows, path, "doc_id")


@query("sc24_sinks", "SELECT doc_id, lang FROM documents")
def sinks(s, d):
    path = folder(s)
    load(s, d, "documents").select("doc_id", "lang").write.option("header", True).csv(f"{path}/csv")
    rd.csv(s, f"{path}/csv").withColumn("doc_id", F.col("doc_id").cast("long")).write.json(f"{path}/json")
    s.read.schema("doc_id bigint, lang string").json(f"{path}/json").write.parquet(f"{path}/parquet")
    return s.read.parquet(f"{path}/parquet")


query("sc25_highlight", "SELECT s_suppkey, s_acctbal >= max(s_acctbal) OVER (PARTITION BY s_nationkey) - 0.01 AS best FROM supplier")(
    lambda s, d: load(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") >= F.max("s_acctbal").over(Window.partitionBy("s_nationkey")) - 0.01).alias("best"))
)


@query("sc27_memoised", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def memoised(s, d):
    return rd.memoised(s, f"{folder(s)}/cache", lambda: load(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")))
