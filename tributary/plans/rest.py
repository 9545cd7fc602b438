"""Queries for what is left of filters, joins, windows, metrics, resampling, routing, text and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as gr
from ..operators import ranking as rk
from ..operators import resampling as rs
from ..operators import routing as ro
from ..operators import topk as tk
from ..operators.ranges import numbered, prefix_sums
from ..operators.sizes import quantiles
from ..operators.storage import cut
from .core import RANK, fin, flows
from .measurement import CTE, load, pool, probe, units
from .more import LOSS, QUALITY, U, geography, trade
from .registry import query

# ---- filters, joins, aggregates -------------------------------------------------------------------------------------

query("pf5_parameter_predicate", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%test%' AND len(list_filter(string_split(p_type, ' '), lambda x: x NOT IN ('SMALL', 'LARGE', 'STANDARD'))) > 0")(
    lambda s, d: load(s, d, "part").where(~F.col("p_name").like("%test%") & F.exists(F.split("p_type", " "), lambda x: ~x.isin("SMALL", "LARGE", "STANDARD"))).select("p_partkey")
)
query("pf17_type_guard", "SELECT p_partkey, p_size < 10 OR p_brand IN ('Brand#11', 'Brand#12') AS guarded FROM part")(lambda s, d: load(s, d, "part").select("p_partkey", ((F.col("p_size") < 10) | F.col("p_brand").isin("Brand#11", "Brand#12")).alias("guarded")))
query("jn12_composite_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')")(
    lambda s, d: (lambda li: li.join(li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey"))(load(s, d, "lineitem"))
)
query("jn24_pairs_won", CTE + "SELECT a.model, round(sum(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END), 3) AS num FROM probe a JOIN probe b ON a.model = b.model AND a.gold = 1 AND b.gold = 0 GROUP BY a.model")(
    lambda s, d: rk.auc_parts(probe(s, d), ["model"]).select("model", F.round("num", 3).alias("num"))
)
query("jn27_argument_position", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN (VALUES ('R', 1), ('A', 2), ('N', 0)) AS spec(flag, pos) ON l_returnflag = flag AND (pos = 0 OR l_linenumber = pos)")(
    lambda s, d: load(s, d, "lineitem").join(F.broadcast(s.createDataFrame([("R", 1), ("A", 2), ("N", 0)], "l_returnflag string, pos int")), "l_returnflag").where("pos = 0 or l_linenumber = pos").select("l_orderkey", "l_linenumber")
)
query("ag17_loss", CTE + f"SELECT grp, round(sum({LOSS}), 6) AS loss FROM probe WHERE m = 1 GROUP BY grp")(lambda s, d: fin(probe(s, d).where("m = 1").groupBy("grp").agg(F.sum(ro.loss()).alias("loss"))))
query("ag20_utility_target", CTE + "SELECT model, round(avg(CASE WHEN gold = 1 THEN p ELSE 1 - p / 10e0 END), 6) AS utility FROM probe GROUP BY model")(lambda s, d: fin(probe(s, d).groupBy("model").agg(F.avg(F.when(F.col("gold") == 1, F.col("p")).otherwise(1 - F.col("p") / 10.0)).alias("utility"))))
query("ag31_stable_mode", CTE + f", x AS (SELECT draw, cls, avg(p) AS a FROM (SELECT draw, cls, p, {U.format(a='unit_id', b='draw')} AS u FROM probe CROSS JOIN (SELECT range AS draw FROM range(12)) WHERE m = 3) WHERE u < 500000 GROUP BY 1, 2), t AS (SELECT draw, cls, row_number() OVER (PARTITION BY draw ORDER BY round(a, 9) DESC, cls) AS r FROM x) SELECT cls, count(*) AS n FROM t WHERE r = 1 GROUP BY cls")(
    lambda s, d: tk.ranked(probe(s, d).where("m = 3").crossJoin(F.broadcast(rs.draws(s, 12))).where(rs.stream("unit_id", "draw") < 500000).groupBy("draw", "cls").agg(F.round(F.avg("p"), 9).alias("a")), ["draw"], "a", "cls").where("rn = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
)
query("ag33_linear_cost", "SELECT doc_id, round(n_chars / 4e0 * 0.0005e0 + 120 * 0.0015e0, 6) AS cost FROM documents")(lambda s, d: fin(load(s, d, "documents").select("doc_id", (F.col("n_chars") / 4.0 * 0.0005 + 120 * 0.0015).alias("cost"))))
query("ag35_best_duplicate", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")(
    lambda s, d: load(s, d, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey"))).where("r = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
)
query("ag38_share_of_wins", CTE + ", r AS (SELECT unit_id, model, row_number() OVER (PARTITION BY unit_id ORDER BY p DESC, m) AS r FROM probe) SELECT model, round(count(*) * 100e0 / (SELECT count(*) FROM unit), 6) AS percent FROM r WHERE r = 1 GROUP BY model")(
    lambda s, d: (lambda p, n: fin(tk.arg_best(p, ["unit_id"], "p", "m", ["m", "model"], largest=True).groupBy("model").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).select("model", (F.col("c") * 100.0 / F.col("n")).alias("percent"))))(probe(s, d), units(s, d).agg(F.count(F.lit(1)).alias("n")))
)
query("ag43_mean_cost", CTE + "SELECT model, round(sum(seconds) / count(*), 6) AS cost FROM probe WHERE pred IS NOT NULL GROUP BY model")(lambda s, d: fin(probe(s, d).where("pred is not null").groupBy("model").agg(F.avg("seconds").alias("cost"))))

# ---- top-k, windows -------------------------------------------------------------------------------------------------

query("tk4_random_ties", CTE + f", x AS (SELECT draw, grp, gold, row_number() OVER (PARTITION BY draw, grp ORDER BY coalesce(pred, 0) DESC, {U.format(a='unit_id', b='draw')}, unit_id) AS r FROM probe CROSS JOIN (SELECT range AS draw FROM range(20)) WHERE m = 1) SELECT grp, round(sum(CASE WHEN r <= 5 THEN gold ELSE 0 END) / 20e0, 6) AS hits FROM x GROUP BY grp")(
    lambda s, d: fin(probe(s, d).where("m = 1").crossJoin(F.broadcast(rs.draws(s, 20))).withColumn("u", rs.stream("unit_id", "draw")).withColumn("r", F.row_number().over(Window.partitionBy("draw", "grp").orderBy(F.desc(F.coalesce("pred", F.lit(0))), "u", "unit_id"))).groupBy("grp").agg((F.sum(F.when(F.col("r") <= 5, F.col("gold")).otherwise(0)) / 20.0).alias("hits")))
)
query("tk6_best_first_once", "SELECT text_key, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_key, doc_id FROM documents) GROUP BY text_key")(lambda s, d: load(s, d, "documents").groupBy(F.md5(F.encode("text", "UTF-8")).alias("text_key")).agg(F.min("doc_id").alias("doc_id")))
query("wn2_last_within_budget", CTE + ", w AS (SELECT model, p, sum(1 - gold) OVER (PARTITION BY model ORDER BY p DESC, unit_id ROWS UNBOUNDED PRECEDING) AS fp, sum(1 - gold) OVER (PARTITION BY model) AS neg FROM probe) SELECT model, round(coalesce(min(CASE WHEN fp <= 0.1 * neg THEN p END), 1e0), 6) AS threshold FROM w GROUP BY model")(
    lambda s, d: (lambda p: fin(tk.running_counts(p, ["model"], "p").join(p.groupBy("model").agg(F.sum(1 - F.col("gold")).alias("neg")), "model").groupBy("model").agg(F.coalesce(F.min(F.when(F.col("cum_fp") <= 0.1 * F.col("neg"), F.col("p"))), F.lit(1.0)).alias("threshold"))))(probe(s, d))
)
@query("wn4_rk5_plain_rank_auc", CTE + ", r AS (SELECT model, gold, row_number() OVER (PARTITION BY model ORDER BY p, unit_id) AS r FROM probe) SELECT model, round((sum(CASE WHEN gold = 1 THEN r END) - sum(gold) * (sum(gold) + 1) / 2e0) / (sum(gold) * sum(1 - gold)), 6) AS auc FROM r GROUP BY model")
def plain_rank_auc(s, d):
    """The AUC from ranks that break ties by id."""
    rows = numbered(probe(s, d), ["model"], ["p", "unit_id"])
    pos, neg = F.sum("gold"), F.sum(1 - F.col("gold"))
    won = F.sum(F.when(F.col("gold") == 1, F.col("rn"))) - pos * (pos + 1) / 2.0
    return fin(rows.groupBy("model").agg((won / (pos * neg)).alias("auc")))


query("wn6_histogram", CTE + "SELECT model, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM probe GROUP BY 1, 2")(lambda s, d: probe(s, d).groupBy("model", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
query("wn7_first_positive", CTE + f", r AS (SELECT model, grp, gold, {RANK} AS rn FROM probe) SELECT model, grp, min(rn) - 1 AS ifa FROM r WHERE gold = 1 GROUP BY 1, 2")(lambda s, d: rk.first_hit(probe(s, d), ["model", "grp"], []).where("ifa is not null").select("model", "grp", F.col("ifa").cast("long").alias("ifa")))
def prefix_hits(s, d):
    """For each size as the cut: units up to it judged by one model, the others by another, from prefix sums by size."""
    right = probe(s, d).where("m in (1, 3)").withColumn("ok", (F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("int"))
    by_unit = right.groupBy("unit_id", "size").agg(*[F.sum(F.when(F.col("m") == m, F.col("ok"))).alias(n) for m, n in ((1, "a"), (3, "b"))])
    by_size = by_unit.groupBy("size").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = prefix_sums(by_size, [], ["size"], {"a_upto": F.col("a"), "b_upto": F.col("b")}).withColumnRenamed("size", "cut")
    total = by_size.agg(F.sum("b").alias("b_all"))
    return sums.crossJoin(F.broadcast(total)).select("cut", (F.col("a_upto") + F.col("b_all") - F.col("b_upto")).cast("long").alias("hits"))


query("wn12_ro20_prefix_sums", CTE + ", x AS (SELECT size, sum(CASE WHEN m = 1 THEN ok END) AS a, sum(CASE WHEN m = 3 THEN ok END) AS b FROM (SELECT m, size, CASE WHEN coalesce(pred, 0) = gold THEN 1 ELSE 0 END AS ok FROM probe WHERE m IN (1, 3)) GROUP BY size) SELECT size AS cut, CAST(sum(a) OVER (ORDER BY size) + (SELECT sum(b) FROM x) - sum(b) OVER (ORDER BY size) AS BIGINT) AS hits FROM x")(prefix_hits)


@query("wn16_smallest_share", CTE + f", r AS (SELECT grp, gold, {RANK} AS rn, count(*) OVER (PARTITION BY model, grp) AS n FROM probe WHERE m = 3), g AS (SELECT (range + 1) / 10e0 AS f FROM range(10)), x AS (SELECT f, sum(CASE WHEN rn <= round_even(f * n, 0) THEN gold ELSE 0 END) * 1e0 / sum(gold) AS rec FROM r CROSS JOIN g GROUP BY f) SELECT round(coalesce(min(CASE WHEN rec >= 0.8 THEN f END), 1e0), 6) AS share FROM x")
def smallest_share(s, d):
    """The smallest tenth of each group's ranking that holds four fifths of all positives."""
    r = tk.ranked(probe(s, d).where("m = 3"), ["model", "grp"], "p")
    tenths = s.range(10).select(((F.col("id") + 1) / 10.0).alias("f"))
    rows = r.join(r.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp").crossJoin(F.broadcast(tenths))
    read = F.when(F.col("rn") <= F.bround(F.col("f") * F.col("n")), F.col("gold")).otherwise(0)
    recall = rows.groupBy("f").agg((F.sum(read) / F.sum("gold")).alias("rec"))
    return fin(recall.agg(F.coalesce(F.min(F.when(F.col("rec") >= 0.8, F.col("f"))), F.lit(1.0)).alias("share")))



# ---- metrics, resampling --------------------------------------------------------------------------------------------

query("rk7_binding_recall", CTE + f", r AS (SELECT grp, gold, {RANK} AS rn FROM probe WHERE m = 2), g AS (SELECT grp, sum(gold) AS pos, sum(CASE WHEN rn <= 3 THEN gold ELSE 0 END) AS hit, count(*) AS n FROM r GROUP BY grp) SELECT round(avg(hit * 1e0 / pos), 6) AS recall_at_k FROM g WHERE pos > 0 AND n > 9")(
    lambda s, d: fin(rk.recall_at_k(probe(s, d).where("m = 2").withColumn("k", F.lit(1)), ["k"], 3).select(F.col("recall_binding").alias("recall_at_k")))
)
query("rk14_pair_rank", CTE + ", t AS (SELECT grp, model, max(CASE WHEN gold = 1 THEN p END) AS b, max(CASE WHEN gold = 0 THEN p END) AS f FROM probe GROUP BY 1, 2) SELECT model, round(avg(CASE WHEN b > f THEN 1e0 WHEN b = f THEN 0.5e0 ELSE 0 END), 6) AS pair_rank FROM t WHERE b IS NOT NULL AND f IS NOT NULL GROUP BY model")(
    lambda s, d: fin(probe(s, d).groupBy("grp", "model").agg(F.max(F.when(F.col("gold") == 1, F.col("p"))).alias("b"), F.max(F.when(F.col("gold") == 0, F.col("p"))).alias("f")).where("b is not null and f is not null").groupBy("model").agg(F.avg(F.when(F.col("b") > F.col("f"), 1.0).when(F.col("b") == F.col("f"), 0.5).otherwise(0.0)).alias("pair_rank")))
)
query("rk17_wrong_order_gap", CTE + ", q AS (SELECT grp, avg(gold) AS g, avg(p) AS e FROM probe WHERE m = 3 GROUP BY grp) SELECT count(*) AS n FROM q a JOIN q b ON a.g - b.g >= 0.1e0 AND a.e < b.e")(
    lambda s, d: (lambda q: q.join(q.select(F.col("g").alias("g2"), F.col("e").alias("e2")), (F.col("g") - F.col("g2") >= 0.1) & (F.col("e") < F.col("e2"))).agg(F.count(F.lit(1)).alias("n")))(probe(s, d).where("m = 3").groupBy("grp").agg(F.avg("gold").alias("g"), F.avg("p").alias("e")))
)
query("rs4_stratified_bootstrap", CTE + f", w AS (SELECT draw, gold, p, {U.format(a='unit_id', b='draw')} AS u FROM probe CROSS JOIN (SELECT range AS draw FROM range(10)) WHERE m = 3), x AS (SELECT draw, gold, sum(CASE WHEN u < 1288490188 THEN p END) / count(CASE WHEN u < 1288490188 THEN 1 END) AS a FROM w GROUP BY 1, 2) SELECT gold, round(avg(a), 6) AS mean FROM x GROUP BY gold")(
    lambda s, d: fin(probe(s, d).where("m = 3").crossJoin(F.broadcast(rs.draws(s, 10))).where(rs.stream("unit_id", "draw") < 1288490188).groupBy("draw", "gold").agg(F.avg("p").alias("a")).groupBy("gold").agg(F.avg("a").alias("mean")))
)
query("rs7_shuffled_oracle", CTE + f", o AS (SELECT unit_id, grp, m, CASE WHEN coalesce(pred, 0) = gold THEN 1 ELSE 0 END AS ok FROM probe), a AS (SELECT *, row_number() OVER (PARTITION BY grp, m ORDER BY unit_id) AS r FROM o), b AS (SELECT grp, m, ok AS shuffled, row_number() OVER (PARTITION BY grp, m ORDER BY {U.format(a='unit_id', b='m')}, unit_id) AS r FROM o) SELECT round(avg(best), 6) AS oracle FROM (SELECT unit_id, max(b.shuffled) AS best FROM a JOIN b USING (grp, m, r) GROUP BY unit_id)")(
    lambda s, d: fin(rs.permuted(probe(s, d).withColumn("ok", (F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("int")), "ok", ["grp", "m"], "unit_id", F.col("m")).groupBy("unit_id").agg(F.max("shuffled").alias("best")).agg(F.avg("best").alias("oracle")))
)
query("rs9_heterogeneity", CTE + f", a AS (SELECT unit_id, cls, row_number() OVER (ORDER BY unit_id) AS r FROM unit), b AS (SELECT gold, row_number() OVER (ORDER BY {U.format(a='unit_id', b='5')}, unit_id) AS r FROM unit), x AS (SELECT cls, avg(gold) AS m FROM a JOIN b USING (r) GROUP BY cls) SELECT round(stddev_samp(m), 6) AS spread FROM x")(
    lambda s, d: fin(rs.permuted(units(s, d).withColumn("k", F.lit(1)), "gold", ["k"], "unit_id", 5).groupBy("cls").agg(F.avg("shuffled").alias("m")).agg(F.stddev_samp("m").alias("spread")))
)
@query("rs10_reversed_rule", CTE + f", c AS (SELECT quantile_cont(p, 0.7) AS cut FROM probe WHERE m = 0), t AS (SELECT unit_id, CASE WHEN p >= cut THEN 0 ELSE 3 END AS m FROM probe CROSS JOIN c WHERE m = 0) SELECT round(avg({QUALITY}), 6) AS quality FROM probe JOIN t USING (unit_id, m)")
def reversed_rule(s, d):
    p = probe(s, d)
    (cut,) = quantiles(p.where("m = 0"), "p", [0.7])
    to = p.where("m = 0").select("unit_id", F.when(F.col("p") >= cut, 0).otherwise(3).alias("m"))
    return fin(p.join(to, ["unit_id", "m"], "left_semi").agg(F.avg(ro.quality()).alias("quality")))


query("rs12_leave_group_out", CTE + f", g AS (SELECT grp, m, sum({QUALITY}) AS q, count(*) AS n FROM probe GROUP BY 1, 2), o AS (SELECT a.grp, b.m, sum(b.q) / sum(b.n) AS r FROM (SELECT DISTINCT grp FROM g) a JOIN g b ON a.grp <> b.grp GROUP BY 1, 2) SELECT grp, CAST(m AS BIGINT) AS m FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(r, 9) DESC, m) AS k FROM o) WHERE k = 1")(
    lambda s, d: (lambda g: fin(tk.arg_best(g.select("grp").distinct().join(g.withColumnRenamed("grp", "g2"), F.col("grp") != F.col("g2")).groupBy("grp", "m").agg(F.round(F.sum("q") / F.sum("n"), 9).alias("r")), ["grp"], "r", "m", ["m"], largest=True)))(probe(s, d).groupBy("grp", "m").agg(F.sum(ro.quality()).alias("q"), F.count(F.lit(1)).alias("n")))
)
query("rs13_grouped_holdout", CTE + f", g AS (SELECT DISTINCT grp, CAST(replace(grp, 'src', '') AS BIGINT) AS gid FROM unit), h AS (SELECT grp FROM g ORDER BY {U.format(a='gid', b='7')}, grp LIMIT 6) SELECT unit_id FROM unit WHERE grp IN (SELECT grp FROM h)")(
    lambda s, d: (lambda u: u.join(F.broadcast(u.select("grp", F.replace("grp", F.lit("src"), F.lit("")).cast("long").alias("gid")).distinct().orderBy(rs.stream("gid", 7), "grp").limit(6).select("grp")), "grp", "left_semi").select("unit_id"))(units(s, d))
)
query("rs14_stratified_sample", CTE + f", x AS (SELECT unit_id, row_number() OVER (PARTITION BY cls, gold ORDER BY {U.format(a='unit_id', b='3')}, unit_id) AS r FROM unit) SELECT unit_id FROM x WHERE r <= 8")(lambda s, d: rs.stratified(units(s, d), ["cls", "gold"], 8, seed=3).select("unit_id"))
query("rs17_specs_by_type", f"WITH x AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {U.format(a='p_partkey', b='9')}, p_partkey) AS r FROM part) SELECT p_partkey, p_type FROM x WHERE r <= 2")(lambda s, d: rs.stratified(load(s, d, "part"), ["p_type"], 2, "p_partkey", 9).select("p_partkey", "p_type"))

# ---- routing --------------------------------------------------------------------------------------------------------

query("ro3_predictive_defer", CTE + ", t AS (SELECT cls, m, avg(CASE WHEN coalesce(pred, 0) = gold THEN 0e0 ELSE 1e0 END) AS l, avg(seconds) AS c FROM probe WHERE unit_id % 2 = 0 GROUP BY 1, 2) SELECT unit_id, CAST(m AS BIGINT) AS m FROM (SELECT p.unit_id, t.m, row_number() OVER (PARTITION BY p.unit_id ORDER BY round(l + 0.3e0 * c, 9), t.m) AS r FROM (SELECT * FROM unit WHERE unit_id % 2 = 1) p JOIN t USING (cls)) WHERE r = 1")(
    lambda s, d: (lambda t: fin(tk.arg_best(units(s, d).where("unit_id % 2 = 1").join(t, "cls").withColumn("v", F.round(F.col("l") + 0.3 * F.col("c"), 9)), ["unit_id"], "v", "m", ["m"])))(probe(s, d).where("unit_id % 2 = 0").groupBy("cls", "m").agg(F.avg((F.coalesce("pred", F.lit(0)) != F.col("gold")).cast("double")).alias("l"), F.avg("seconds").alias("c")))
)
query("ro6_absolute_cut", CTE + ", n AS (SELECT grp, count(*) AS n FROM unit GROUP BY grp) SELECT unit_id, CASE WHEN n < 15 THEN size >= 2000 ELSE size >= 1000 END AS escalate FROM unit JOIN n USING (grp)")(
    lambda s, d: (lambda u: u.join(u.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp").select("unit_id", F.when(F.col("n") < 15, F.col("size") >= 2000).otherwise(F.col("size") >= 1000).alias("escalate")))(units(s, d))
)
query("ro12_preflight", CTE + f", x AS (SELECT model, count(pred) AS n, avg({QUALITY}) AS q FROM probe GROUP BY model) SELECT count(*) AS models, round(max(q) - min(q), 6) AS dispersion, max(q) - min(q) >= 0.05 AS go FROM x WHERE n >= 30")(
    lambda s, d: fin(probe(s, d).groupBy("model").agg(F.count("pred").alias("n"), F.avg(ro.quality()).alias("q")).where("n >= 30").agg(F.count(F.lit(1)).alias("models"), (F.max("q") - F.min("q")).alias("dispersion"), (F.max("q") - F.min("q") >= 0.05).alias("go")))
)
query("ro17_two_tiers", CTE + ", c AS (SELECT a.unit_id, a.grp, CASE WHEN abs(a.p - 0.5e0) < 0.2e0 THEN 1 + b.p ELSE a.p END AS sc FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m = 1 AND b.m = 3) SELECT unit_id, row_number() OVER (PARTITION BY grp ORDER BY sc DESC, unit_id) AS rn FROM c")(
    lambda s, d: (lambda p: fin(tk.ranked(p.where("m = 1").select("unit_id", "grp", "p").join(p.where("m = 3").select("unit_id", F.col("p").alias("pl")), "unit_id").withColumn("sc", F.when(F.abs(F.col("p") - 0.5) < 0.2, 1 + F.col("pl")).otherwise(F.col("p"))), ["grp"], "sc").select("unit_id", "rn")))(probe(s, d))
)
query("ro21_skill_gate", CTE + f", q AS (SELECT model, m, avg({QUALITY}) AS q, avg(seconds) AS c FROM probe GROUP BY 1, 2) SELECT (SELECT model FROM q WHERE q >= 0.5 ORDER BY c, m LIMIT 1) AS cheap, (SELECT model FROM q ORDER BY round(q, 9) DESC, m LIMIT 1) AS best")(
    lambda s, d: (lambda q: q.where("q >= 0.5").agg(F.min(F.struct("c", "m", "model"))["model"].alias("cheap")).crossJoin(q.agg(F.min(F.struct((-F.round("q", 9)).alias("v"), "m", "model"))["model"].alias("best"))))(probe(s, d).groupBy("model", "m").agg(F.avg(ro.quality()).alias("q"), F.avg("seconds").alias("c")))
)
@query("ro22_cost_guard", CTE + """, c AS (SELECT model, avg(seconds) AS c, avg(CASE WHEN pred IS NULL OR abs(p - 0.5e0) < 0.1e0 THEN 1e0 ELSE 0 END) AS f FROM probe GROUP BY model)
SELECT a.model AS small, b.model AS large, round(a.c + a.f * b.c, 6) AS cost, a.c + a.f * b.c >= b.c AS strong_alone FROM c a JOIN c b ON a.c < b.c""")
def cost_guard(s, d):
    """Whether a cascade that passes on what its cheap model leaves unsure costs as much as the dear model alone."""
    unsure = F.col("pred").isNull() | (F.abs(F.col("p") - 0.5) < 0.1)
    # written, as a mean summed anew in another order could be below itself
    c = cut(probe(s, d).groupBy("model").agg(F.avg("seconds").alias("c"), F.avg(unsure.cast("double")).alias("f")))
    large = c.select(F.col("model").alias("large"), F.col("c").alias("k"))
    cost = F.col("c") + F.col("f") * F.col("k")
    return fin(c.withColumnRenamed("model", "small").join(F.broadcast(large), F.col("c") < F.col("k")).select("small", "large", cost.alias("cost"), (cost >= F.col("k")).alias("strong_alone")))


query("ro24_floor", CTE + f", r AS (SELECT unit_id, {RANK} AS rn FROM probe WHERE m = 0) SELECT round(avg(CASE WHEN CASE WHEN r.rn <= 4 THEN coalesce(b.pred, 0) ELSE coalesce(a.pred, 0) END = a.gold THEN 1e0 ELSE 0 END), 6) AS accuracy FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m = 0 AND b.m = 3 JOIN r ON r.unit_id = a.unit_id")(
    lambda s, d: (lambda p: fin(tk.ranked(p.where("m = 0"), ["model", "grp"], "p").select("unit_id", "gold", "rn", F.coalesce("pred", F.lit(0)).alias("a")).join(p.where("m = 3").select("unit_id", F.coalesce("pred", F.lit(0)).alias("b")), "unit_id").agg(F.avg((F.when(F.col("rn") <= 4, F.col("b")).otherwise(F.col("a")) == F.col("gold")).cast("double")).alias("accuracy"))))(probe(s, d))
)
query("ro30_label_following", CTE + "SELECT round(avg(CASE WHEN CASE WHEN coalesce(a.pred, 0) = a.gold THEN coalesce(a.pred, 0) ELSE coalesce(b.pred, 0) END = a.gold THEN 1e0 ELSE 0 END), 6) AS ceiling FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m = 0 AND b.m = 3")(
    lambda s, d: fin(probe(s, d).where("m in (0, 3)").groupBy("unit_id").agg(F.max((F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double")).alias("ok")).agg(F.avg("ok").alias("ceiling")))
)
query("ro31_same_count", CTE + f", k AS (SELECT grp, sum(coalesce(pred, 0)) AS k FROM probe WHERE m = 1 GROUP BY grp), x AS (SELECT unit_id, grp, gold, row_number() OVER (PARTITION BY grp ORDER BY {U.format(a='unit_id', b='0')}, unit_id) AS r FROM probe WHERE m = 1) SELECT grp, CAST(coalesce(sum(gold), 0) AS BIGINT) AS random_hits FROM x JOIN k USING (grp) WHERE r <= k GROUP BY grp")(
    lambda s, d: rs.matched_selection(probe(s, d).where("m = 1").withColumn("picked", F.coalesce("pred", F.lit(0))), "picked", 1, ["grp"]).groupBy("grp").agg(F.sum("gold").alias("random_hits"))
)
query("ro32_score_map", CTE + "SELECT unit_id, round(max(CASE WHEN m = 0 THEN p - 0.1e0 * seconds END), 6) AS tiny, round(max(CASE WHEN m = 3 THEN p - 0.1e0 * seconds END), 6) AS large FROM probe GROUP BY unit_id")(
    lambda s, d: fin(probe(s, d).groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("model", (F.col("p") - 0.1 * F.col("seconds")).alias("v")))).alias("w")).select("unit_id", F.col("w")["tiny"].alias("tiny"), F.col("w")["large"].alias("large")))
)

# ---- text -----------------------------------------------------------------------------------------------------------

query("sf2_condition_text", "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS conditions FROM pages")(lambda s, d: load(s, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), " ").alias("conditions")))
query("sf3_structure", "SELECT page_id, length(html) AS chars, len(regexp_extract_all(html, '<div')) AS n_div, len(regexp_extract_all(html, '<a ')) AS n_link FROM pages")(lambda s, d: fin(load(s, d, "pages").select("page_id", F.length("html").alias("chars"), tx.count("html", "<div").alias("n_div"), tx.count("html", "<a ").alias("n_link"))))
query("sf8_json_array", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")(
    lambda s, d: load(s, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("Sure: ["), F.array_join(F.collect_list(F.to_json(F.struct("turn"))), ", "), F.lit("] done // end")).alias("t")).select("conv_id", F.size(tx.json_array("t")).cast("long").alias("n"))
)
query("sf9_bool_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")(
    lambda s, d: load(s, d, "events").withColumn("t", F.concat(F.lit("x {"), F.when(F.get_json_object("props", "$.k").cast("long") % 2 == 0, '"v": "Yes"').otherwise('"v": " no "'), F.lit("} y"))).select("event_id", tx.truth(tx.last_json("t", "v string")["v"]).alias("even"))
)
query("sf11_verdict", "SELECT doc_id, CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS BIGINT) AS v FROM labels")(
    lambda s, d: load(s, d, "labels").withColumn("t", F.when(F.col("toxic") == 1, "verdict: safe ... Verdict = Vulnerable").otherwise("it is not vulnerable")).select("doc_id", tx.verdict("t").cast("long").alias("v"))
)
query("sf12_rewrites", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[^a-z0-9]+', '_', 'g') AS slug FROM pages")(lambda s, d: load(s, d, "pages").select("page_id", tx.chain(F.lower("url"), [("^https?://", ""), ("[^a-z0-9]+", "_")]).alias("slug")))
query("sf14_alias_coalesce", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source, 'none') AS name FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "source", F.lit("none")).alias("name")))
query("sf18_line_lookup", "SELECT doc_id, string_split(text, chr(10))[2] AS line2 FROM documents WHERE len(string_split(text, chr(10))) >= 2")(lambda s, d: load(s, d, "documents").withColumn("ls", F.split("text", "\n")).where(F.size("ls") >= 2).select("doc_id", F.col("ls")[1].alias("line2")))
query("sf24_platt_apply", CTE + "SELECT unit_id, model, round(1 / (1 + exp(-(3e0 * ln((p + 0.01e0) / (1.01e0 - p)) - 0.5e0))), 6) AS q FROM probe")(lambda s, d: fin(probe(s, d).select("unit_id", "model", tx.logistic(3.0 * F.ln((F.col("p") + 0.01) / (1.01 - F.col("p"))) - 0.5).alias("q"))))
query("sf27_guards", "SELECT c_custkey, round(1000 / greatest(c_acctbal, 1e-9), 4) AS x, c_acctbal / nullif(c_nationkey, 0) IS NULL AS undefined FROM customer WHERE c_acctbal > 1")(lambda s, d: load(s, d, "customer").where("c_acctbal > 1").select("c_custkey", F.round(1000 / F.greatest("c_acctbal", F.lit(1e-9)), 4).alias("x"), F.try_divide("c_acctbal", "c_nationkey").isNull().alias("undefined")))
query("sf28_half_even", "SELECT p_partkey, CAST(round_even(p_size / 2e0, 0) AS BIGINT) AS half FROM part")(lambda s, d: load(s, d, "part").select("p_partkey", F.bround(F.col("p_size") / 2.0).cast("long").alias("half")))
query("sf30_literal", "SELECT doc_id, CAST(quality AS BIGINT) AS q FROM labels")(lambda s, d: load(s, d, "labels").withColumn("t", F.concat(F.lit("{'q': "), F.col("quality").cast("string"), F.lit(", 'z': 1}"))).select("doc_id", tx.literal_dict("t", "q bigint, z int")["q"].alias("q")))
query("sf32_prompt", "SELECT conv_id, printf('[%d] %s: %s', turn, role, left(text, 20)) AS prompt FROM conversations")(lambda s, d: load(s, d, "conversations").select("conv_id", F.format_string("[%d] %s: %s", "turn", "role", F.left("text", F.lit(20))).alias("prompt")))
query("sf35_after_marker", "SELECT doc_id, lang AS answer FROM documents")(lambda s, d: load(s, d, "documents").withColumn("t", F.concat(F.lit("<think>a</think>b</think>"), "lang")).select("doc_id", tx.after_thinking("t").alias("answer")))

# ---- graphs, plug-ins -----------------------------------------------------------------------------------------------

query("gx2_is_ancestor", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s, d: gr.closure(geography(s, d)).where("node like 'n:%' and ancestor like 'r:%'").select(F.substring("node", 3, 100).alias("n_name"), F.substring("ancestor", 3, 100).alias("r_name")))
query("gx4_first_parent", "SELECT p_brand AS src, arg_min(p_type, p_partkey) AS dst FROM part GROUP BY p_brand")(lambda s, d: gr.first_parent(load(s, d, "part"), "p_brand", "p_type", "p_partkey"))
query("gx6_sources_only", "WITH o AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders) SELECT src AS source, count(*) AS n FROM o GROUP BY src")(lambda s, d: trade(s, d).where("src like 'c%'").groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n")))
@query("gx9_edge_kinds", "WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'N' UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'N'), r AS (SELECT DISTINCT src AS source, src AS node FROM e WHERE src LIKE 'o%' UNION SELECT source, dst FROM r JOIN e ON e.src = r.node) SELECT source, node FROM r WHERE node LIKE 's%'")
def edge_kinds(s, d):
    """Suppliers of orders along the edges of one kind of line."""
    li = load(s, d, "lineitem").where("l_returnflag = 'N'")
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    edges = li.select(tag("o", "l_orderkey").alias("src"), tag("p", "l_partkey").alias("dst")).union(li.select(tag("p", "l_partkey"), tag("s", "l_suppkey")))
    orders, suppliers = (li.select(tag(t, c).alias("node")) for t, c in (("o", "l_orderkey"), ("s", "l_suppkey")))
    return gr.reach_sets(edges, orders, sinks=suppliers)


query("gx10_nested_reach", "WITH x AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), safe AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') SELECT DISTINCT l_suppkey FROM x WHERE o_custkey NOT IN (SELECT o_custkey FROM safe)")(
    lambda s, d: (lambda o: o.join(load(s, d, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey")).join(o.where("o_orderpriority = '5-LOW'").select("o_custkey").distinct(), "o_custkey", "left_anti").select("l_suppkey").distinct())(load(s, d, "orders"))
)
query("gx14_facts", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40")(lambda s, d: load(s, d, "lineitem").where("l_linenumber = 1 and l_quantity > 40").select("l_orderkey", "l_partkey"))
query("ux1_strategy", CTE + "SELECT unit_id, model FROM probe WHERE m = 1")(lambda s, d: (lambda strategy: strategy(probe(s, d), 0.5).select("unit_id", "model"))(lambda df, lam: ro.fixed(df, 1)))
query("ux5_generator", "SELECT conv_id, CAST(unnest(generate_series(0, len(list(turn)) - 1)) AS BIGINT) AS pos FROM conversations GROUP BY conv_id")(lambda s, d: fin(flows(s, d).select("conv_id", F.posexplode("flow").alias("pos", "x")).select("conv_id", "pos")))
query("ux7_retries", "SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS first_ok, count(*) AS attempts FROM events GROUP BY user_id")(lambda s, d: load(s, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("first_ok"), F.count(F.lit(1)).alias("attempts")))
query("sf16_description", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[\\p{L}]'))[1:11], chr(10)) AS head FROM documents")(
    lambda s, d: load(s, d, "documents").select("doc_id", tx.description("text").alias("head"))
)
