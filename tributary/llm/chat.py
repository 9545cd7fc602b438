"""Chat formatting after cumulative snapshots are collapsed.

A log may hold a conversation once for each of its turns, each time from the start. Each turn is hashed with its number,
and a rolling hash of all turns so far is kept beside it, so equal hashes mean equal beginnings. A conversation whose
last hash is another's before its last turn is a prefix of it; an anti-join drops it, and of equal ones the smallest
conv_id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

HASH = ["h1", "h2"]


def _hashed(turns: DataFrame) -> DataFrame:
    """A row for each turn, in order: conv_id, n (from 1), role, text, the rolling hash and whether turns follow.

    A turn's hash is of its number, role and text, each seeding the next one's, so fields cannot run into each other;
    the rolling hash is the exclusive or of two independent 64-bit ones.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"n": F.row_number().over(order), "more": F.lead(F.lit(True), 1, False).over(order)})
    rows = rows.withColumns({h: F.xxhash64(F.lit(k), "n", "role", "text") for k, h in enumerate(HASH)})
    return rows.withColumns({h: F.bit_xor(h).over(upto) for h in HASH}).drop("turn")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations equal to it, itself included) and text of the maximal ones.

    turns: conv_id, turn, role, text. Turns of one number are ordered by role and text, equal ones count each; null
    roles and texts are empty; rows without conv_id are left out; other columns are not read. An empty table gives no
    rows. Prefix hashes are pre-aggregated to one row each, however many conversations begin alike. A conversation's
    turns are sorted in one task and gathered in one row only to be rendered.
    """
    rows = stored(_hashed(turns), "chat")
    inner = rows.where("more").select(*HASH).distinct()
    last = rows.where("not more")
    heads = last.groupBy(*HASH).agg(F.min("conv_id").alias("conv_id"), F.first("n").alias("n_turns"), F.count(F.lit(1)).alias("n_equal"))
    maximal = stored(heads.join(inner, HASH, "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_equal"), "chat-maximal")
    line = F.transform(F.array_sort(F.collect_list(F.struct("n", "role", "text"))), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    return rows.join(maximal, "conv_id").groupBy("conv_id", "n_turns", "n_equal").agg(F.array_join(line, "").alias("text"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    found = collapse(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "n_turns", "n_equal", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


OP5_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'role': role, 'text': text} ORDER BY turn, role, text) AS items,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id
), firsts AS (
  SELECT items, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_equal FROM c GROUP BY items
), prefixes AS (
  SELECT DISTINCT list_slice(items, 1, k) AS items
  FROM (SELECT items, unnest(generate_series(1, n_turns - 1)) AS k FROM firsts)
)
SELECT f.conv_id, f.n_turns, f.n_equal, md5(c.rendered) AS text_md5
FROM firsts f JOIN c USING (conv_id)
WHERE f.items NOT IN (SELECT items FROM prefixes)
"""
