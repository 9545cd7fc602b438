"""Queries that iterate: message passing over units and models, and a log followed while it grows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import messages as mp
from ..operators.storage import shared_dir
from ..streaming import follow as fo
from .core import fin
from .measurement import CTE, load, pool, probe, units
from .registry import query

# ---- message passing ------------------------------------------------------------------------------------------------

WIDTH = 3


def bipartite(s, d):
    """(units, models, edges) with features that any engine can compute; every fifth edge or so is held out."""
    u = units(s, d).select("unit_id", F.array(F.ln(F.col("size") + 1.0) / 10, F.col("unit_id") * 7919 % 1003 / 1003.0, F.lit(1.0)).alias("x"))
    m = pool(s).select("m", F.array("unit_cost", "skill", "bias").alias("x"))
    e = probe(s, d).select("unit_id", "m", F.col("p").alias("w"), (F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("int").alias("right"), "gold", ((F.col("unit_id") * 31 + F.col("m") * 17) % 5 != 0).alias("seen"))
    return u, m, e


def _round_sql(k: int) -> str:
    """One round over both sides, as SQL: means of weighted neighbours, then half of the way."""
    before, after = k - 1, k
    mean = lambda side, key: ", ".join(f"avg(w * n.x{i}) AS m{i}" for i in range(WIDTH))
    moved = ", ".join(f"CASE WHEN g.m{i} IS NULL THEN o.x{i} ELSE (o.x{i} + g.m{i}) / 2 END AS x{i}" for i in range(WIDTH))
    return (
        f", u{after} AS (SELECT o.unit_id, {moved} FROM u{before} o LEFT JOIN (SELECT e.unit_id, {mean('m', 'm')} FROM e JOIN m{before} n ON n.m = e.m WHERE seen GROUP BY 1) g ON g.unit_id = o.unit_id)"
        f", m{after} AS (SELECT o.m, {moved} FROM m{before} o LEFT JOIN (SELECT e.m, {mean('u', 'unit_id')} FROM e JOIN u{before} n ON n.unit_id = e.unit_id WHERE seen GROUP BY 1) g ON g.m = o.m)"
    )


PASSED = (
    CTE
    + ", e AS (SELECT unit_id, m, p AS w, (unit_id * 31 + m * 17) % 5 <> 0 AS seen FROM probe)"
    + ", u0 AS (SELECT unit_id, ln(size + 1e0) / 10 AS x0, unit_id * 7919 % 1003 / 1003e0 AS x1, 1e0 AS x2 FROM unit), m0 AS (SELECT m, unit_cost AS x0, skill AS x1, bias AS x2 FROM pool)"
    + _round_sql(1)
    + _round_sql(2)
)


@query("gx16_message_passing", PASSED + " SELECT 'unit' AS side, unit_id AS id, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM u2 UNION ALL SELECT 'model', m, round(x0, 6), round(x1, 6), round(x2, 6) FROM m2")
def message_passing(s, d):
    """Both sides' features after two rounds over the edges that are not held out."""
    u, m = mp.pass_messages(*bipartite(s, d), WIDTH)
    flat = [F.get("x", F.lit(k)).alias(f"x{k}") for k in range(WIDTH)]
    return fin(u.select(F.lit("unit").alias("side"), F.col("unit_id").alias("id"), *flat).union(m.select(F.lit("model"), "m", *flat)))


@query("gx16_link_scores", PASSED + " SELECT e.unit_id, CAST(e.m AS BIGINT) AS m, round(u.x0 * m.x0 + u.x1 * m.x1 + u.x2 * m.x2, 6) AS score FROM e JOIN u2 u ON u.unit_id = e.unit_id JOIN m2 m ON m.m = e.m WHERE NOT seen")
def link_scores(s, d):
    """The scores of the edges that carried no message."""
    u, m, e = bipartite(s, d)
    u, m = mp.pass_messages(u, m, e, WIDTH)
    return fin(mp.link_scores(u, m, e, WIDTH).select("unit_id", "m", "score"))


# ---- a growing log --------------------------------------------------------------------------------------------------


@query("ux10_follow_log", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last FROM events GROUP BY 1")
def follow_log(s, d):
    """Running totals of a log that comes in three drops, followed by two runs of which the first is cut off, until its
    flag is there."""
    top = f"{shared_dir(s)}/tributary/followed-{uuid.uuid4().hex}"
    events = load(s, d, "events").select("event_id", "event_type", "value")
    drop = lambda k: events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.mode("append").parquet(f"{top}/log")
    totals = lambda: s.readStream.schema(events.schema).parquet(f"{top}/log").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("last")
    )
    run = lambda until=None: fo.follow(totals(), fo.overwritten_by_epoch(f"{top}/out"), f"{top}/checkpoint", f"{top}/done", mode="update", until=until)
    drop(0)
    run(until=lambda: True)
    drop(1)
    drop(2)
    s.range(1).write.csv(f"{top}/done")
    run()
    return fin(fo.latest(s, f"{top}/out", ["event_type"], totals().schema), 4)
