"""Queries: routing, resampling, text functions, graphs, growing inputs, and what other tables need."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as gr
from ..operators import resampling as rs
from ..operators import routing as ro
from ..operators import topk as tk
from ..operators.ranges import numbered
from ..operators.storage import shared_dir
from ..streaming import incremental as inc
from .core import fin
from .measurement import CTE, load, probe, units
from .registry import query

LOSS = "CASE WHEN gold = 1 AND coalesce(pred, 0) = 0 THEN 5e0 WHEN gold = 0 AND coalesce(pred, 0) = 1 THEN 1e0 ELSE 0e0 END"
QUALITY = "CASE WHEN coalesce(pred, 0) = gold THEN 1e0 WHEN gold = 1 THEN 0e0 ELSE 0.9e0 END"

# ---- routing --------------------------------------------------------------------------------------------------------

query("ro1_fixed", CTE + f"SELECT round(avg({LOSS}), 6) AS loss, round(avg(seconds), 6) AS cost FROM probe WHERE m = 2")(
    lambda s, d: fin(ro.fixed(probe(s, d), 2).agg(F.avg(ro.loss()).alias("loss"), F.avg("seconds").alias("cost")))
)
query("ro1_random", CTE + "SELECT unit_id, model FROM probe WHERE m = (unit_id * 48271 + 7) % 1000003 % 4")(lambda s, d: ro.random_choice(probe(s, d), 4).select("unit_id", "model"))
query("ro2_oracle", CTE + f", x AS (SELECT *, {LOSS} AS loss FROM probe), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY loss + 0.5e0 * seconds, m) AS rn FROM x) SELECT unit_id, model, round(loss, 6) AS loss FROM r WHERE rn = 1")(
    lambda s, d: fin(ro.oracle(probe(s, d), 0.5).select("unit_id", "model", "loss"))
)
query("ro4_threshold", CTE + ", c AS (SELECT quantile_cont(p, 0.7) AS cut FROM probe WHERE m = 0), t AS (SELECT unit_id, CASE WHEN p >= cut THEN 3 ELSE 0 END AS m FROM probe CROSS JOIN c WHERE m = 0) SELECT unit_id, model FROM probe JOIN t USING (unit_id, m)")(
    lambda s, d: ro.threshold(probe(s, d), 0, 3, 0.7).select("unit_id", "model")
)
query("ro5_relative_cut", CTE + ", b AS (SELECT DISTINCT size AS v FROM unit), x AS (SELECT v, (SELECT count(*) FROM unit WHERE size >= v) AS picked, (SELECT count(*) FROM unit) AS n FROM b) SELECT v AS cut, picked FROM x ORDER BY abs(picked - 0.3e0 * n), v DESC LIMIT 1")(
    lambda s, d: ro.relative_cut(units(s, d), "size", 0.3)
)
LAMS = [0.0, 0.1, 0.5, 1.0, 2.0, 5.0, 20.0]
FRONT = CTE + f", g AS (SELECT unnest({LAMS}::DOUBLE[]) AS lam), x AS (SELECT *, {LOSS} AS loss, {QUALITY} AS quality FROM probe CROSS JOIN g), r AS (SELECT *, row_number() OVER (PARTITION BY lam, unit_id ORDER BY loss + lam * seconds, m) AS rn FROM x), f AS (SELECT lam, avg(quality) AS quality, avg(seconds) AS cost, avg(loss) AS loss FROM r WHERE rn = 1 GROUP BY lam)"
query("ro8_frontier", FRONT + " SELECT lam, round(quality, 6) AS quality, round(cost, 6) AS cost, round(loss, 6) AS loss FROM f")(lambda s, d: fin(ro.frontier(probe(s, d), LAMS)))
query("ro9_aiq", FRONT + ", p AS (SELECT cost, max(quality) AS q FROM f GROUP BY cost), s AS (SELECT (cost - lag(cost) OVER w) * (q + lag(q) OVER w) / 2 AS a, cost FROM p WINDOW w AS (ORDER BY cost)) SELECT round(sum(a) / nullif(max(cost) - min(cost), 0), 5) AS aiq FROM s")(
    lambda s, d: fin(ro.area(ro.frontier(probe(s, d), LAMS)), 5)
)
query("ro10_reference_table", CTE + f", x AS (SELECT *, {LOSS} AS loss, {QUALITY} AS quality FROM probe), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY loss, m) AS rn FROM x) SELECT model AS name, round(avg(quality), 6) AS quality, round(avg(seconds), 6) AS cost FROM x GROUP BY model UNION ALL SELECT 'oracle', round(avg(quality), 6), round(avg(seconds), 6) FROM r WHERE rn = 1")(
    lambda s, d: fin(probe(s, d).groupBy(F.col("model").alias("name")).agg(F.avg(ro.quality()).alias("quality"), F.avg("seconds").alias("cost")).union(ro.oracle(probe(s, d)).agg(F.lit("oracle").alias("name"), F.avg(ro.quality()).alias("quality"), F.avg("seconds").alias("cost"))))
)


@query("ro11_pair_lift", CTE + ", x AS (SELECT a.model AS a, b.model AS b, a.unit_id, CASE WHEN coalesce(a.pred, 0) = a.gold THEN 1e0 ELSE 0 END AS ra, CASE WHEN coalesce(b.pred, 0) = b.gold THEN 1e0 ELSE 0 END AS rb FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m < b.m) SELECT a, b, round(avg(greatest(ra, rb)) - greatest(avg(ra), avg(rb)), 6) AS lift FROM x GROUP BY a, b")
def pair_lift(s, d):
    """For each pair of models, what choosing right for each unit would add to the better of the two."""
    p = probe(s, d).withColumn("ok", (F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double"))
    one = lambda m, model, ok: p.select("unit_id", F.col("m").alias(m), F.col("model").alias(model), F.col("ok").alias(ok))
    pairs = one("m1", "a", "ra").join(one("m2", "b", "rb"), "unit_id").where("m1 < m2")
    lift = F.avg(F.greatest("ra", "rb")) - F.greatest(F.avg("ra"), F.avg("rb"))
    return fin(pairs.groupBy("a", "b").agg(lift.alias("lift")))


REWARD = "CASE WHEN coalesce(pred, 0) = gold THEN 1e0 ELSE 0 END - 0.2e0 * seconds"


def rewarded(s, d):
    return probe(s, d).withColumn("reward", (F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double") - 0.2 * F.col("seconds"))


query("ro13_lookup_router", CTE + f", x AS (SELECT *, {REWARD} AS reward FROM probe), c AS (SELECT cls, m, row_number() OVER (PARTITION BY cls ORDER BY avg(reward) DESC, m) AS r FROM x WHERE unit_id % 2 = 0 GROUP BY cls, m), g AS (SELECT m FROM x WHERE unit_id % 2 = 0 GROUP BY m ORDER BY avg(reward) DESC, m LIMIT 1) SELECT unit_id, model FROM x LEFT JOIN (SELECT cls, m AS cm FROM c WHERE r = 1) USING (cls) CROSS JOIN (SELECT m AS gm FROM g) WHERE unit_id % 2 = 1 AND m = coalesce(cm, gm)")(
    lambda s, d: (lambda x: ro.lookup_router(x.where("unit_id % 2 = 0"), x.where("unit_id % 2 = 1"), "cls").select("unit_id", "model"))(rewarded(s, d))
)
query("ro14_knn_router", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.id AS qid, c.id AS cid, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS sim FROM v q JOIN v c ON q.id % 100 = 0 AND q.id <> c.id),
n AS (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS r FROM s), w AS (SELECT qid, m, avg((cid * 7919 + m * 104729) % 1000003) AS a FROM n CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS m) WHERE r <= 10 GROUP BY qid, m) SELECT qid, CAST(m AS BIGINT) AS m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a DESC, m) AS r FROM w) WHERE r = 1""")(
    lambda s, d: (lambda v: fin(ro.knn_router(v.where("id % 100 = 0"), v, v.select("id").crossJoin(F.broadcast(s.range(4).select(F.col("id").cast("int").alias("m")))).withColumn("reward", ((F.col("id") * 7919 + F.col("m") * 104729) % 1000003).cast("double")), 10)))(load(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
)
query("ro15_cascade_grid", CTE + ", w AS (SELECT range / 20e0 AS w FROM range(11)), x AS (SELECT a.m AS cheap, b.m AS dear, w, CASE WHEN abs(a.p - 0.5e0) < w THEN coalesce(b.pred, 0) ELSE coalesce(a.pred, 0) END AS pred, a.gold, a.seconds + CASE WHEN abs(a.p - 0.5e0) < w THEN b.seconds ELSE 0 END AS cost FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m < b.m CROSS JOIN w), g AS (SELECT cheap, dear, w, avg(CASE WHEN pred = gold THEN 1e0 ELSE 0 END) - 0.2e0 * avg(cost) AS reward FROM x GROUP BY ALL) SELECT CAST(cheap AS BIGINT) AS cheap, CAST(dear AS BIGINT) AS dear, round(w, 6) AS w, round(reward, 6) AS reward FROM g ORDER BY round(reward, 9) DESC, cheap, dear, w LIMIT 1")(
    lambda s, d: (lambda p: fin(
        p.select("unit_id", "gold", F.col("m").alias("cheap"), F.col("p").alias("pc"), F.coalesce("pred", F.lit(0)).alias("vc"), F.col("seconds").alias("sc"))
        .join(p.select("unit_id", F.col("m").alias("dear"), F.coalesce("pred", F.lit(0)).alias("vd"), F.col("seconds").alias("sd")), "unit_id").where("cheap < dear")
        .crossJoin(F.broadcast(s.range(11).select((F.col("id") / 20.0).alias("w")))).withColumn("up", F.abs(F.col("pc") - 0.5) < F.col("w"))
        .groupBy("cheap", "dear", "w").agg((F.avg((F.when(F.col("up"), F.col("vd")).otherwise(F.col("vc")) == F.col("gold")).cast("double")) - 0.2 * F.avg(F.col("sc") + F.when(F.col("up"), F.col("sd")).otherwise(0.0))).alias("reward"))
        .orderBy(F.desc(F.round("reward", 9)), "cheap", "dear", "w").limit(1)
    ))(probe(s, d))
)
query("ro16_suspicion_cascade", CTE + ", c AS (SELECT unit_id, grp, p, seconds, row_number() OVER (PARTITION BY grp ORDER BY p DESC, unit_id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM probe WHERE m = 1), d AS (SELECT unit_id, p AS pd, seconds AS sd FROM probe WHERE m = 3) SELECT unit_id, CAST(rn <= round_even(0.3 * n, 0) AS BIGINT) AS escalated, round(CASE WHEN rn <= round_even(0.3 * n, 0) THEN 1 + pd ELSE p END, 6) AS order_score, round(seconds + CASE WHEN rn <= round_even(0.3 * n, 0) THEN sd ELSE 0 END, 6) AS seconds FROM c JOIN d USING (unit_id)")(
    lambda s, d: fin(ro.suspicion_cascade(probe(s, d), 1, 3, 0.3).select("unit_id", "escalated", "order_score", "seconds"))
)
query("ro18_trigger_cascade", CTE + "SELECT round(avg(CASE WHEN CASE WHEN abs(a.p - 0.5e0) < 0.15e0 THEN coalesce(b.pred, 0) ELSE coalesce(a.pred, 0) END = a.gold THEN 1e0 ELSE 0 END), 6) AS accuracy, round(sum(a.seconds + CASE WHEN abs(a.p - 0.5e0) < 0.15e0 THEN b.seconds ELSE 0 END), 4) AS cost FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m = 0 AND b.m = 3")(
    lambda s, d: ro.cascade(probe(s, d), 0, 3, 0.15).agg(F.round(F.avg((F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double")), 6).alias("accuracy"), F.round(F.sum("seconds"), 4).alias("cost"))
)
query("ro19_cheapest_within", CTE + ", x AS (SELECT model, avg(CASE WHEN coalesce(pred, 0) = gold THEN 1e0 ELSE 0 END) AS q, avg(seconds) AS c FROM probe GROUP BY model) SELECT round(c, 6) AS c, model, round(q, 6) AS q FROM x WHERE q >= (SELECT max(q) FROM x) - 0.1e0 ORDER BY c, model LIMIT 1")(
    lambda s, d: fin(ro.cheapest_within(probe(s, d).groupBy("model").agg(F.avg((F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double")).alias("q"), F.avg("seconds").alias("c")), "q", "c", "model", 0.1))
)
query("ro23_small_suffices", CTE + "SELECT a.unit_id, CAST(a.p >= b.p - 0.1e0 AS BIGINT) AS small FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m = 0 AND b.m = 3")(
    lambda s, d: (lambda p: p.where("m = 0").select("unit_id", "p").join(p.where("m = 3").select("unit_id", F.col("p").alias("pl")), "unit_id").select("unit_id", (F.col("p") >= F.col("pl") - 0.1).cast("long").alias("small")))(probe(s, d))
)
query("ro25_rank_confirm", CTE + ", r AS (SELECT unit_id, row_number() OVER (PARTITION BY grp ORDER BY p DESC, unit_id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM probe WHERE m = 1) SELECT unit_id FROM r JOIN (SELECT unit_id FROM probe WHERE m = 3 AND pred = 1) USING (unit_id) WHERE rn <= greatest(1, round_even(0.25 * n, 0))")(
    lambda s, d: (lambda p: tk.top_share(p.where("m = 1"), ["grp"], "p", 0.25, 1).join(p.where("m = 3 and pred = 1"), "unit_id", "left_semi").select("unit_id"))(probe(s, d))
)
query("ro26_consensus", CTE + "SELECT unit_id, CAST(coalesce(sum(pred), 0) = 4 AS BIGINT) AS all4, CAST(coalesce(sum(pred), 0) >= 3 AS BIGINT) AS three, round(avg(p), 6) AS mean_p FROM probe GROUP BY unit_id")(
    lambda s, d: fin(probe(s, d).groupBy("unit_id").agg(F.sum("pred").alias("y"), F.avg("p").alias("mean_p")).select("unit_id", (F.coalesce("y", F.lit(0)) == 4).cast("long").alias("all4"), (F.coalesce("y", F.lit(0)) >= 3).cast("long").alias("three"), "mean_p"))
)


@query("ro27_scenarios", CTE + ", b AS (SELECT cls, min(seconds) AS lo, max(seconds) AS hi FROM probe GROUP BY cls), w AS (SELECT unnest([1.0, 0.5, 0.2]::DOUBLE[]) AS we), x AS (SELECT unit_id, m, we, we * p - (1 - we) * (seconds - lo) / (hi - lo) AS score FROM probe JOIN b USING (cls) CROSS JOIN w) SELECT we, unit_id, CAST(m AS BIGINT) AS m FROM (SELECT *, row_number() OVER (PARTITION BY we, unit_id ORDER BY score DESC, m) AS r FROM x) WHERE r = 1")
def scenarios(s, d):
    """The model chosen for each unit as score and scaled cost are weighed in three ways."""
    p = probe(s, d)
    weights = s.createDataFrame([(1.0,), (0.5,), (0.2,)], "we double")
    rows = p.join(p.groupBy("cls").agg(F.min("seconds").alias("lo"), F.max("seconds").alias("hi")), "cls").crossJoin(F.broadcast(weights))
    cost = (F.col("seconds") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    scored = rows.withColumn("score", F.col("we") * F.col("p") - (1 - F.col("we")) * cost)
    return fin(tk.arg_best(scored, ["we", "unit_id"], "score", "m", ["m"], largest=True))


query("ro28_budget_oracle", CTE + "SELECT unit_id, CAST(coalesce(min(CASE WHEN pred = gold THEN m END), max(m)) AS BIGINT) AS budget FROM probe GROUP BY unit_id")(
    lambda s, d: fin(probe(s, d).groupBy("unit_id").agg(F.coalesce(F.min(F.when(F.col("pred") == F.col("gold"), F.col("m"))), F.max("m")).alias("budget")))
)


@query("ro29_threshold_sweep", CTE + ", t AS (SELECT range / 10e0 AS tau FROM range(11)) SELECT tau, round(avg(CASE WHEN a.p >= tau THEN 1e0 ELSE 0 END), 6) AS small_share, round(avg(CASE WHEN CASE WHEN a.p >= tau THEN coalesce(a.pred, 0) ELSE coalesce(b.pred, 0) END = a.gold THEN 1e0 ELSE 0 END), 6) AS accuracy FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m = 0 AND b.m = 3 CROSS JOIN t GROUP BY tau")
def threshold_sweep(s, d):
    """Accuracy and the small model's share as the score at which it is trusted rises."""
    p, pred = probe(s, d), F.coalesce("pred", F.lit(0))
    both = p.where("m = 0").select("unit_id", "gold", "p", pred.alias("a")).join(p.where("m = 3").select("unit_id", pred.alias("b")), "unit_id")
    rows = both.crossJoin(F.broadcast(s.range(11).select((F.col("id") / 10.0).alias("tau"))))
    trusted = F.col("p") >= F.col("tau")
    right = F.when(trusted, F.col("a")).otherwise(F.col("b")) == F.col("gold")
    return fin(rows.groupBy("tau").agg(F.avg(trusted.cast("double")).alias("small_share"), F.avg(right.cast("double")).alias("accuracy")))


query("ro7_dual_ascent")(
    lambda s, d: fin(ro.dual_ascent(probe(s, d).withColumns({"loss": ro.loss(), "cost": F.col("seconds")}), F.col("n") * 0.1).select("grp", "n", "lam", "spent", "lost"))
)
query("wn11_marginal_gain", FRONT + " SELECT lam, round((round(quality, 6) - lag(round(quality, 6)) OVER (ORDER BY lam)) / nullif(round(cost, 6) - lag(round(cost, 6)) OVER (ORDER BY lam), 0), 4) AS gain FROM f")(
    lambda s, d: (lambda rk: fin(rk.marginal_gain(fin(ro.frontier(probe(s, d), LAMS)).withColumn("one", F.lit(1)), ["one"], "lam", "quality", "cost").select("lam", "gain"), 4))(__import__("tributary.operators.ranking", fromlist=["x"]))
)

# ---- resampling -----------------------------------------------------------------------------------------------------

T = "(({a} * 7919 + {b} * 104729 + 11) % 2147483647)"
U = f"(({T} * {T} % 2147483647) * ({T} * {T} % 2147483647) % 2147483647 * {T} % 2147483647)"
POIS = " + ".join(f"CASE WHEN u >= {x}e0 THEN 1 ELSE 0 END" for x in ("0.36787944", "0.73575888", "0.91969860", "0.98101184", "0.99634015", "0.99940582", "0.99991676"))
query("rs1_bootstrap", CTE + f", q AS (SELECT unit_id, avg({QUALITY}) AS q FROM probe WHERE m = 2 GROUP BY unit_id), w AS (SELECT draw, q, {U.format(a='unit_id', b='draw')} / 2147483647e0 AS u FROM q CROSS JOIN (SELECT range AS draw FROM range(50))), b AS (SELECT draw, sum(q * ({POIS})) / sum({POIS}) AS v FROM w GROUP BY draw) SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high FROM b")(
    lambda s, d: fin(rs.interval(rs.poisson_weights(probe(s, d).where("m = 2").groupBy("unit_id").agg(F.avg(ro.quality()).alias("q")), 50, "unit_id").groupBy("draw").agg((F.sum(F.col("q") * F.col("weight")) / F.sum("weight")).alias("v")).withColumn("k", F.lit(1)), ["k"], "v").drop("k"))
)
query("rs2_paired_bootstrap", CTE + f", q AS (SELECT unit_id, sum(CASE WHEN m = 3 THEN {QUALITY} ELSE -({QUALITY}) END) AS q FROM probe WHERE m IN (0, 3) GROUP BY unit_id), w AS (SELECT draw, q, {U.format(a='unit_id', b='draw')} / 2147483647e0 AS u FROM q CROSS JOIN (SELECT range AS draw FROM range(50))), b AS (SELECT draw, sum(q * ({POIS})) / sum({POIS}) AS v FROM w GROUP BY draw) SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high FROM b")(
    lambda s, d: fin(rs.interval(rs.poisson_weights(probe(s, d).where("m in (0, 3)").groupBy("unit_id").agg(F.sum(F.when(F.col("m") == 3, ro.quality()).otherwise(-ro.quality())).alias("q")), 50, "unit_id").groupBy("draw").agg((F.sum(F.col("q") * F.col("weight")) / F.sum("weight")).alias("v")).withColumn("k", F.lit(1)), ["k"], "v").drop("k"))
)
query("rs3_cluster_bootstrap", CTE + f", g AS (SELECT grp, CAST(replace(grp, 'src', '') AS BIGINT) AS gid, sum({QUALITY}) AS q, count(*) AS n FROM probe WHERE m = 2 GROUP BY grp), w AS (SELECT draw, q, n, {U.format(a='gid', b='draw')} / 2147483647e0 AS u FROM g CROSS JOIN (SELECT range AS draw FROM range(50))), b AS (SELECT draw, sum(q * ({POIS})) / nullif(sum(n * ({POIS})), 0) AS v FROM w GROUP BY draw) SELECT round(avg(v), 6) AS mean FROM b")(
    lambda s, d: fin(rs.poisson_weights(probe(s, d).where("m = 2").groupBy("grp").agg(F.sum(ro.quality()).alias("q"), F.count(F.lit(1)).alias("n")).withColumn("gid", F.replace("grp", F.lit("src"), F.lit("")).cast("long")), 50, "gid").groupBy("draw").agg(F.try_divide(F.sum(F.col("q") * F.col("weight")), F.sum(F.col("n") * F.col("weight")).cast("double")).alias("v")).agg(F.avg("v").alias("mean")))
)
query("rs5_matched_selection", CTE + f", k AS (SELECT grp, sum(coalesce(pred, 0)) AS k FROM probe WHERE m = 3 GROUP BY grp), x AS (SELECT unit_id, grp, gold, draw, row_number() OVER (PARTITION BY draw, grp ORDER BY {U.format(a='unit_id', b='draw')}, unit_id) AS r FROM probe CROSS JOIN (SELECT range AS draw FROM range(20)) WHERE m = 3) SELECT draw, CAST(sum(gold) AS BIGINT) AS hits FROM x JOIN k USING (grp) WHERE r <= k GROUP BY draw")(
    lambda s, d: rs.matched_selection(probe(s, d).where("m = 3").withColumn("picked", F.coalesce("pred", F.lit(0))), "picked", 20, ["grp"]).groupBy("draw").agg(F.sum("gold").alias("hits"))
)
query("rs6_permuted", CTE + f", a AS (SELECT unit_id, grp, row_number() OVER (PARTITION BY grp ORDER BY unit_id) AS r FROM unit), b AS (SELECT grp, gold, row_number() OVER (PARTITION BY grp ORDER BY {U.format(a='unit_id', b='0')}, unit_id) AS r FROM unit) SELECT unit_id, b.gold AS shuffled FROM a JOIN b USING (grp, r)")(
    lambda s, d: rs.permuted(units(s, d), "gold", ["grp"], "unit_id").select("unit_id", "shuffled")
)
query("rs8_z_and_p", CTE + f", k AS (SELECT grp, sum(coalesce(pred, 0)) AS k FROM probe WHERE m = 3 GROUP BY grp), x AS (SELECT unit_id, grp, gold, draw, row_number() OVER (PARTITION BY draw, grp ORDER BY {U.format(a='unit_id', b='draw')}, unit_id) AS r FROM probe CROSS JOIN (SELECT range AS draw FROM range(20)) WHERE m = 3), h AS (SELECT draw, sum(gold) AS hits FROM x JOIN k USING (grp) WHERE r <= k GROUP BY draw) SELECT round((20 - avg(hits)) / nullif(stddev_pop(hits), 0), 6) AS z, round(avg(CASE WHEN hits >= 20 THEN 1e0 ELSE 0 END), 6) AS p_value FROM h")(
    lambda s, d: fin(rs.z_and_p(rs.matched_selection(probe(s, d).where("m = 3").withColumn("picked", F.coalesce("pred", F.lit(0))), "picked", 20, ["grp"]).groupBy("draw").agg(F.sum("gold").alias("hits")), "hits", 20.0))
)
query("rs11_folds", CTE + f" SELECT unit_id, CAST((row_number() OVER (ORDER BY {U.format(a='unit_id', b='0')}, unit_id) - 1) % 5 AS BIGINT) AS fold FROM unit")(lambda s, d: fin(rs.folds(units(s, d), 5).select("unit_id", "fold")))
query("rs15_random_per_group", CTE + f", x AS (SELECT unit_id, grp, row_number() OVER (PARTITION BY grp ORDER BY {U.format(a='unit_id', b='0')}, unit_id) AS r FROM unit) SELECT unit_id, grp FROM x WHERE r <= 3")(
    lambda s, d: rs.stratified(units(s, d), ["grp"], 3).select("unit_id", "grp")
)
query("rs16_expand_share", CTE + "SELECT unit_id, CAST(least(greatest(round_even(p * 10, 0), 0), 10) AS BIGINT) AS ones FROM probe WHERE m = 1")(
    lambda s, d: probe(s, d).where("m = 1").select("unit_id", F.aggregate(rs.expand_share("p", 10), F.lit(0), lambda a, x: a + x).cast("long").alias("ones"))
)

# ---- text functions -------------------------------------------------------------------------------------------------

query("sf1_regex_counts", "SELECT page_id, len(regexp_extract_all(html, '<[a-z]+')) AS tags, len(regexp_extract_all(html, '=\"[^\"]*\"')) AS attributes, len(regexp_extract_all(html, '[0-9]+')) AS numbers FROM pages")(
    lambda s, d: fin(load(s, d, "pages").select("page_id", tx.count("html", "<[a-z]+").alias("tags"), tx.count("html", '="[^"]*"').alias("attributes"), tx.count("html", "[0-9]+").alias("numbers")))
)
query("sf4_nesting", "WITH x AS (SELECT page_id, string_split(regexp_replace(html, '[^<>]', '', 'g'), '') AS c FROM pages), y AS (SELECT page_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM x), z AS (SELECT page_id, sum(CASE c WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS s, i FROM y), w AS (SELECT page_id, s - least(min(s) OVER (PARTITION BY page_id ORDER BY i), 0) AS depth FROM z) SELECT p.page_id, CAST(coalesce(max(depth), 0) AS BIGINT) AS nest FROM pages p LEFT JOIN w USING (page_id) GROUP BY p.page_id")(
    lambda s, d: fin(load(s, d, "pages").select("page_id", tx.nesting("html", "<", ">").alias("nest")))
)
query("sf5_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS loc FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", tx.loc("text").alias("loc")))
query("sf6_normalise_id", "SELECT page_id, CASE WHEN regexp_extract(url, '([0-9]+)', 1) = '' THEN 'CWE-UNKNOWN' ELSE 'CWE-' || regexp_extract(url, '([0-9]+)', 1) END AS id FROM pages")(lambda s, d: load(s, d, "pages").select("page_id", tx.cwe("url").alias("id")))
query("sf7_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda s, d: load(s, d, "events").select("event_id", tx.last_json("props", "k bigint")["k"].alias("k"))
)
query("sf13_alias_match", "SELECT doc_id FROM documents WHERE len(list_filter(string_split('MIT License|Apache', '|'), lambda x: contains(lower(text), lower(x)))) > 0")(
    lambda s, d: load(s, d, "documents").withColumn("names", F.lit("MIT License|Apache")).where(tx.named("text", "names")).select("doc_id")
)
query("sf15_clip", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", tx.clipped("text", 50).alias("short")))
query("sf17_split", "SELECT page_id, split_part(url, '/', -1) AS last_part, split_part(url, '://', 1) AS scheme FROM pages")(
    lambda s, d: load(s, d, "pages").select("page_id", F.substring_index("url", "/", -1).alias("last_part"), F.substring_index("url", "://", 1).alias("scheme"))
)
query("sf19_elided", """WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), y AS (SELECT *, len(ls) AS n, greatest(1, least(20 - 6, len(ls) - 11)) AS a FROM x)
SELECT doc_id, md5(CASE WHEN n <= 12 THEN text ELSE array_to_string(list_concat(list_concat(CASE WHEN a > 1 THEN ['// ...'] ELSE [] END, ls[a : a + 11]), CASE WHEN a + 11 < n THEN ['// ...'] ELSE [] END), chr(10)) END) AS digest FROM y""")(
    lambda s, d: load(s, d, "documents").withColumn("at", F.lit(20)).select("doc_id", F.md5(F.encode(tx.window_of("text", "at", 12), "UTF-8")).alias("digest"))
)
query("sf20_anonymise", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 'EMAIL', 'g'), '[0-9]+', '0', 'g')) AS digest FROM documents")(
    lambda s, d: load(s, d, "documents").select("doc_id", F.md5(F.encode(tx.chain(F.col("text"), [tx.ANONYMOUS[0], tx.ANONYMOUS[4]]), "UTF-8")).alias("digest"))
)
query("sf22_content_key", "SELECT doc_id, left(sha1(text), 20) AS key FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", F.left(F.sha1("text"), F.lit(20)).alias("key")))
query("sf23_logit", CTE + "SELECT unit_id, model, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS logit, round(1 / (1 + exp(-(2 * p - 1))), 6) AS platt FROM probe")(
    lambda s, d: fin(probe(s, d).select("unit_id", "model", tx.logit(F.col("p")).alias("logit"), tx.logistic(2 * F.col("p") - 1).alias("platt")))
)
query("sf25_softmax", CTE + "SELECT unit_id, model, round(exp(p) / (exp(p) + exp(1 - p)), 6) AS soft FROM probe")(lambda s, d: fin(probe(s, d).select("unit_id", "model", tx.softmax2(F.col("p"), 1 - F.col("p")).alias("soft"))))
query("sf26_vector_norm", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")(
    lambda s, d: fin(load(s, d, "embeddings").select("vec_id", F.sqrt(tx.dot("embedding", "embedding")).alias("norm")))
)
query("sf29_timestamps", "SELECT event_id, strftime(ts, '%m-%d %H:%M:%S') AS shown, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute FROM events")(
    lambda s, d: load(s, d, "events").select("event_id", F.date_format("ts", "MM-dd HH:mm:ss").alias("shown"), F.unix_timestamp(F.date_trunc("minute", "ts")).alias("minute"))
)
query("sf31_composite_key", "SELECT lang || ':' || source || ':' || doc_id AS key FROM documents")(lambda s, d: load(s, d, "documents").select(F.concat_ws(":", "lang", "source", "doc_id").alias("key")))
query("sf33_batches", "WITH x AS (SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS b, source FROM documents) SELECT source, b AS batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM x GROUP BY source, b")(
    lambda s, d: load(s, d, "documents").withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1) / 10)).groupBy("source", "batch").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("ids"))
)
query("sf34_nested_filter", "SELECT conv_id, list(turn ORDER BY turn) FILTER (turn % 2 = 0) AS kept FROM conversations GROUP BY conv_id")(
    lambda s, d: load(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select("conv_id", F.filter("turns", lambda t: t % 2 == 0).alias("kept"))
)
query("sf36_guarded_cast", "SELECT page_id, try_cast(split_part(url, '/', -1) AS BIGINT) AS n FROM pages WHERE try_cast(split_part(url, '/', -1) AS BIGINT) IS NOT NULL")(
    lambda s, d: load(s, d, "pages").select("page_id", F.expr("try_cast(substring_index(url, '/', -1) as bigint)").alias("n")).where("n is not null")
)

# ---- graphs ---------------------------------------------------------------------------------------------------------


def geography(s, d):
    n = load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n:"), "n_name").alias("src"), F.concat(F.lit("r:"), "r_name").alias("dst"))
    return n.union(load(s, d, "region").select(F.concat(F.lit("r:"), "r_name"), F.lit("ROOT")))


GEO = "WITH RECURSIVE e AS (SELECT 'n:' || n_name AS src, 'r:' || r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r:' || r_name, 'ROOT' FROM region), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
query("gx1_ancestors", GEO + ", c AS (SELECT node, node AS ancestor, 0 AS depth FROM v UNION SELECT c.node, e.dst, depth + 1 FROM c JOIN e ON e.src = c.ancestor) SELECT node, ancestor, CAST(depth AS BIGINT) AS depth FROM c")(lambda s, d: fin(gr.closure(geography(s, d))))
query("gx3_used_closure", GEO + ", u AS (SELECT DISTINCT 'n:' || n_name AS node FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900), c AS (SELECT node FROM u UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c")(
    lambda s, d: gr.reach(geography(s, d), load(s, d, "nation").join(load(s, d, "customer").where("c_acctbal > 9900"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("n:"), "n_name").alias("node")).distinct()).select("node").distinct()
)


#: What a node of the flow of goods stands for: customer, order, part, supplier.
NODES = ["c", "o", "p", "s"]


KEYS = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"]}


def by_name(s, d):
    """Whether any key needs more than 62 bits, so that nodes cannot be numbers."""
    wide = lambda c: ~F.col(c).between(-(1 << 61), (1 << 61) - 1)
    return any(any(load(s, d, t).agg(*[F.bool_or(wide(c)) for c in keys]).first()) for t, keys in KEYS.items())


def goods(kind, column, named):
    """A node as its name or as a number, which takes less room."""
    return F.concat(F.lit(kind), F.col(column).cast("string")) if named else F.col(column).cast("long") * 4 + NODES.index(kind)


def name_of(node):
    """The name of a numbered node: its kind's letter and its key."""
    return F.concat(F.element_at(F.array(*map(F.lit, NODES)), (F.pmod(node, F.lit(4)) + 1).cast("int")), F.shiftright(node, 2).cast("string"))


def flows_of_goods(s, d, named):
    """customer -> order -> part -> supplier, as it flows; edges may repeat."""
    o, li = load(s, d, "orders"), load(s, d, "lineitem")
    edges = o.select(goods("c", "o_custkey", named).alias("src"), goods("o", "o_orderkey", named).alias("dst")).union(li.select(goods("o", "l_orderkey", named), goods("p", "l_partkey", named)))
    return edges.union(li.select(goods("p", "l_partkey", named), goods("s", "l_suppkey", named)))


def trade(s, d):
    return flows_of_goods(s, d, True).distinct()


TRADE = "WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem), s0 AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING')"


def buyers(s, d, named):
    return load(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(goods("c", "c_custkey", named).alias("node"))


def suppliers(s, d, named):
    return load(s, d, "lineitem").select(goods("s", "l_suppkey", named).alias("node")).distinct()


def names_of(reached, named):
    return reached if named else reached.withColumns({c: name_of(F.col(c)) for c in ("source", "node")})


@query("gx5_reach_barrier", TRADE + ", b AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT node AS source, node FROM s0 UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node WHERE e.dst NOT IN (SELECT node FROM b)) SELECT source, node FROM r WHERE node LIKE 's%'")
def reach_barrier(s, d):
    """Suppliers that goods of a buyer came from, past orders that are not closed."""
    named = by_name(s, d)
    closed = load(s, d, "orders").where("o_orderstatus = 'F'").select(goods("o", "o_orderkey", named).alias("node"))
    return names_of(gr.reach_sets(flows_of_goods(s, d, named), buyers(s, d, named), closed, sinks=suppliers(s, d, named)), named)


@query("gx7_barrier_out", TRADE + ", b AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size < 25), r AS (SELECT node AS source, node FROM s0 UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node WHERE r.node NOT IN (SELECT node FROM b)) SELECT source, node FROM r")
def barrier_out(s, d):
    named = by_name(s, d)
    stop = load(s, d, "part").where("p_size < 25").select(goods("p", "p_partkey", named).alias("node"))
    return names_of(gr.reach_sets(flows_of_goods(s, d, named), buyers(s, d, named), barrier_out=stop), named)


@query("gx8_states", TRADE + ", r AS (SELECT node AS source, node, 'raw' AS state FROM s0 UNION SELECT r.source, e.dst, CASE WHEN e.dst LIKE 'p%' THEN 'seen' ELSE r.state END FROM r JOIN e ON e.src = r.node) SELECT source, node, state FROM r WHERE node LIKE 's%'")
def reach_states(s, d):
    named = by_name(s, d)
    part = F.col("dst").like("p%") if named else F.pmod("dst", F.lit(4)) == NODES.index("p")
    edges = flows_of_goods(s, d, named).withColumns({"from_state": F.lit(None).cast("string"), "to_state": F.when(part, "seen")})
    return names_of(gr.reach_sets(edges, buyers(s, d, named).withColumn("state", F.lit("raw")), states=True, sinks=suppliers(s, d, named)), named)


query("gx11_fixpoint", GEO + ", c AS (SELECT 'n:FRANCE' AS node UNION SELECT x FROM (SELECT e.dst AS x FROM c JOIN e ON e.src = c.node UNION ALL SELECT e.src FROM c JOIN e ON e.dst = c.node WHERE e.dst <> 'ROOT')) SELECT node FROM c")(
    lambda s, d: (lambda e: gr.fixpoint(s.createDataFrame([("n:FRANCE",)], "node string"), lambda k: k.join(e, k.node == e.src).select(F.col("dst").alias("node")).union(k.where("node <> 'ROOT'").join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("node")))))(geography(s, d))
)
query("gx15_spec_match", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size = 1 AND l_linenumber = 1) OR p_size = 2")(
    lambda s, d: gr.spec_match(
        load(s, d, "lineitem").join(load(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.lit("p").alias("package"), F.lit("c").alias("clazz"), F.col("p_size").cast("string").alias("method"), F.col("l_linenumber").alias("arg"), "l_orderkey", "l_partkey"),
        s.createDataFrame([("source", "p", "c", "1", 1), ("source", "p", "c", "2", None), ("sink", "p", "c", "3", None)], "kind string, package string, clazz string, method string, arg int"), "source").select("l_orderkey", "l_partkey").distinct()
)

# ---- growing inputs -------------------------------------------------------------------------------------------------


def streamed(s, d, build, mode="append"):
    """Runs a streaming plan over the events files to its end and gives what it wrote. The sink and the checkpoint lie
    in the shared folder."""
    out = f"{shared_dir(s)}/tributary/stream-{__import__('uuid').uuid4().hex}"
    stream = s.readStream.schema(load(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    plan = build(stream)
    schema = plan.schema
    inc.run_to_end(plan, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}"), f"{out}/checkpoint", mode)
    return s.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/data")


query("ux8_stream_once", "SELECT event_id, event_type FROM events")(
    lambda s, d: streamed(s, d, lambda e: inc.once_each(e.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", "1 hour").select("event_id", "event_type"))
)
query("ux8_stream_complete_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: streamed(s, d, lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")
)
query("ext_tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda s, d: inc.tumbling(load(s, d, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))
)
query("ext_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, k")(
    lambda s, d: inc.sessions(load(s, d, "events"), "ts", "30 minutes", "user_id")
)
query("ext_as_of", "SELECT e.event_id, round(v.value, 6) AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON e.user_id = v.user_id AND e.ts >= v.ts")(
    lambda s, d: (lambda e: fin(inc.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), "user_id", "ts", "value", "last_view").select("event_id", "last_view")))(load(s, d, "events"))
)
ALARM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity"]


@query("ux9_cached_verdicts", f"""WITH RECURSIVE a AS (SELECT l_orderkey // 1000 AS project, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY {', '.join(ALARM)}) AS ord, CAST(l_partkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS sink,
  CAST(l_returnflag = 'R' AS INT) AS verdict, CASE WHEN l_linestatus = 'F' THEN 'source' WHEN l_quantity > 45 THEN 'sink' END AS blame FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ord) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY project, source, sink ORDER BY ord) AS nth FROM a) WHERE nth = 1),
r AS (SELECT project, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS sink, CAST(NULL AS INT) AS final, CAST(NULL AS VARCHAR) AS why, CAST([] AS VARCHAR[]) AS bs, CAST([] AS VARCHAR[]) AS bk FROM (SELECT DISTINCT project FROM f)
  UNION ALL SELECT project, rn, source, sink, CASE WHEN why = 'own' THEN verdict ELSE 0 END, why, CASE WHEN why = 'own' AND verdict = 0 AND blame = 'source' THEN list_append(bs, source) ELSE bs END, CASE WHEN why = 'own' AND verdict = 0 AND blame = 'sink' THEN list_append(bk, sink) ELSE bk END
  FROM (SELECT f.*, r.bs, r.bk, CASE WHEN list_contains(r.bs, f.source) THEN 'source' WHEN list_contains(r.bk, f.sink) THEN 'sink' ELSE 'own' END AS why FROM r JOIN f ON f.project = r.project AND f.rn = r.rn + 1))
SELECT a.project, a.ord, a.source, a.sink, CAST(r.final AS BIGINT) AS final, CASE WHEN a.ord = f.ord THEN r.why ELSE 'flow' END AS why
FROM a JOIN f ON f.project = a.project AND f.source = a.source AND f.sink = a.sink JOIN r ON r.project = f.project AND r.rn = f.rn""")
def cached_verdicts(s, d):
    """Lines as alarms of projects of a thousand orders."""
    lines = numbered(load(s, d, "lineitem").select(*ALARM).withColumn("project", F.expr("l_orderkey div 1000")), ["project"], ALARM, "ord")
    blame = F.when(F.col("l_linestatus") == "F", "source").when(F.col("l_quantity") > 45, "sink")
    alarms = lines.select("project", "ord", F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("sink"), (F.col("l_returnflag") == "R").cast("int").alias("verdict"), blame.alias("blame"))
    return fin(inc.cached_verdicts(alarms))


query("wn15_stop_early")(
    lambda s, d: inc.stop_early((lambda p: tk.ranked(p.where("m = 1"), ["grp"], "p").join(p.where("m = 3").select("unit_id", F.col("p").alias("second")), "unit_id").select("grp", "rn", "second"))(probe(s, d)), ["grp"], 5, 3, 2)
)
query("jn20_consecutive_pairs")(lambda s, d: inc.consecutive_pairs(load(s, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id"))

# ---- other tables ---------------------------------------------------------------------------------------------------

query("ext_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")(
    lambda s, d: load(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
)
query("ext_pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")(
    lambda s, d: load(s, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))
)
query("ext_shipping_priority", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10")(
    lambda s, d: load(s, d, "customer").where("c_mktsegment = 'BUILDING'").join(load(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(load(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)
)


@query("ext_local_suppliers", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def local_suppliers(s, d):
    """Revenue by nation of goods whose buyer and supplier are of one nation."""
    rows = load(s, d, "lineitem").join(load(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(load(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(load(s, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    rows = rows.join(F.broadcast(load(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("n_name").agg(F.round(revenue, 1).alias("revenue"))


