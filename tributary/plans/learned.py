"""Queries over learned components."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import learned as ml
from ..operators import ranking as rk
from .core import AVG_RANK, fin
from .measurement import CTE, load, probe, units
from .newton import RECURSIVE, newton_sql
from .registry import query


def numbers(s, d):
    return load(s, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"), "l_orderkey")


query("ml1_least_squares", "SELECT 'q' AS term, round(regr_slope(l_extendedprice / 1000, l_quantity / 50), 4) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice / 1000, l_quantity / 50), 4) FROM lineitem")(
    lambda s, d: fin(ml.least_squares(numbers(s, d), ["q"], "price"), 4)
)
query("rk20_held_out_r2", "WITH x AS (SELECT l_quantity / 50 AS q, l_extendedprice / 1000 AS y, l_orderkey % 2 AS h FROM lineitem), m AS (SELECT regr_slope(y, q) AS a, regr_intercept(y, q) AS b, avg(y) AS mu FROM x WHERE h = 0) SELECT round(1 - sum((y - a * q - b) ** 2) / sum((y - mu) ** 2), 6) AS r2 FROM x CROSS JOIN m WHERE h = 1")(
    lambda s, d: fin(ml.held_out_r2(numbers(s, d).where("l_orderkey % 2 = 0"), numbers(s, d).where("l_orderkey % 2 = 1"), ["q"], "price"))
)
SOFT = RECURSIVE + ", x AS (SELECT m, p, ln(size) AS f1, gold + unit_id * 7919 % 1003 / 500e0 AS f2 FROM probe)" + newton_sql("x", ["m"], ["f1", "f2"], "p")


@query("ml2_soft_logistic", SOFT + " SELECT CAST(m AS BIGINT) AS m, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, true AS converged FROM fitted")
def soft_logistic(s, d):
    """The coefficients of an unpenalised fit of each model's score, a target between 0 and 1."""
    rows = probe(s, d).withColumns({"f1": F.ln("size"), "f2": F.col("gold") + (F.col("unit_id") * 7919 % 1003) / 500.0, "l2": F.lit(0.0)})
    found = ml.newton_logistic(rows, ["m"], ["f1", "f2"], "p", "l2")
    return fin(found.select("m", *[F.col("beta")[i].alias(f"b{i}") for i in range(3)], "converged"), 4)


@query("ml4_platt", RECURSIVE + newton_sql("probe", ["m"], ["p"], "gold", "1e-3") + " SELECT CAST(m AS BIGINT) AS m, unit_id, round(1 / (1 + exp(-(b0 + b1 * p))), 5) AS prob FROM probe JOIN fitted USING (m)")
def platt(s, d):
    """Every unit's score, calibrated for its model; a small weight, so that separable scores have an optimum too."""
    rows = probe(s, d).select("m", "unit_id", "p", "gold").withColumn("l2", F.lit(1e-3))
    fitted = ml.newton_logistic(rows, ["m"], ["p"], "gold", "l2")
    return fin(ml.predicted(rows, fitted, ["m"], ["p"]).select("m", "unit_id", "prob"), 5)


GRAMS = r"""WITH w AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(length(w) - n + 2, 2)), lambda i: substr(w, i, n))) AS gram FROM w, range(3, 6) t(n) WHERE n = 3 OR length(w) >= n) GROUP BY 1, 2),
t AS (SELECT gram, count(*) AS df, sum(tf) AS a FROM g WHERE doc_id % 2 = 0 GROUP BY gram HAVING count(*) >= 3 ORDER BY a DESC, gram LIMIT 20000),
v AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 2 = 0)) / (1e0 + df)) + 1 AS idf FROM t),
x AS (SELECT doc_id, (1 + ln(tf)) * idf AS w FROM g JOIN v USING (gram)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1)"""


@query("ml5_tfidf", GRAMS + " SELECT doc_id, count(w) AS n_features, round(coalesce(max(w / l), 0), 6) AS top, round(coalesce(sum(w / l), 0), 5) AS total FROM documents LEFT JOIN x USING (doc_id) LEFT JOIN l USING (doc_id) GROUP BY doc_id")
def char_tfidf(s, d):
    """Of each document's weights, fitted on those of even doc_id: how many, the largest and their sum."""
    docs = load(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = ml.tfidf(docs, "doc_id", "text", ml.vocabulary(docs.where("doc_id % 2 = 0"), "doc_id", "text"))
    per = weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_features"), F.max("weight").alias("top"), F.sum("weight").alias("total"))
    found = docs.select("doc_id").join(per, "doc_id", "left").fillna(0)
    return found.select("doc_id", "n_features", F.round("top", 6).alias("top"), F.round("total", 5).alias("total"))


@query("ml6_standardised", CTE + ", t AS (SELECT avg(size) AS m, stddev_samp(size) AS sd FROM unit WHERE unit_id % 2 = 0) SELECT unit_id, round((size - m) / sd, 6) AS z, CASE WHEN cls IN (SELECT cls FROM unit WHERE unit_id % 2 = 0) THEN 1e0 ELSE 0e0 END AS n_hot FROM unit CROSS JOIN t")
def standardised(s, d):
    """The scaled size, and how many places of the one-hot category are set."""
    u = units(s, d)
    v = vector_to_array("features")
    got = ml.standardised(u.where("unit_id % 2 = 0"), ["size"], "cls").transform(u).select("unit_id", v.alias("v"))
    return fin(got.select("unit_id", F.get("v", F.lit(0)).alias("z"), F.aggregate(F.slice("v", 2, F.size("v")), F.lit(0.0), lambda a, x: a + x).alias("n_hot")))


@query("ml7_boosted")
def boosted(s, d):
    """The AUC of 200 rounds of boosted trees on rows that they were not fitted on, and of the raw score there."""
    p = probe(s, d).where("m = 3")
    model = bo.fit(p.where("unit_id % 2 = 0"), ["size", "p"], "gold")
    return fin(ml.auc_scan(model.transform(p.where("unit_id % 2 = 1"), "boosted"), ["boosted", "p"]))


PARTS = bo.bins_for(2) - 1


@query("ml7_first_splits", CTE + f""", r AS (SELECT gold, CAST(size AS DOUBLE) AS size, p FROM probe WHERE m = 3),
x AS (SELECT 'size' AS feature, size AS v, gold FROM r UNION ALL SELECT 'p', p, gold FROM r),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {[k / PARTS for k in range(1, PARTS)]}))) AS edges FROM x GROUP BY feature),
b AS (SELECT feature, 1 + len(list_filter(edges, lambda q: q < v)) AS bin, gold FROM x JOIN e USING (feature)),
c AS (SELECT feature, bin, sum(count(*)) OVER w AS n_left, sum(sum(gold)) OVER w AS pos_left FROM b GROUP BY feature, bin WINDOW w AS (PARTITION BY feature ORDER BY bin)),
t AS (SELECT count(*) AS n, sum(gold) * 1e0 / count(*) AS s FROM r), g AS (SELECT feature, bin, n_left, n, s, s * n_left - pos_left AS gl FROM c CROSS JOIN t WHERE n_left < n)
SELECT feature, CAST(bin AS BIGINT) AS bin, CAST(n_left AS BIGINT) AS n_left, round(gl * gl / (s * (1 - s) * n_left) + gl * gl / (s * (1 - s) * (n - n_left)), 6) AS gain FROM g""")
def first_splits(s, d):
    """What every cut of two columns would gain as the first split."""
    p = probe(s, d).where("m = 3")
    columns = ["size", "p"]
    return fin(bo.first_gains(bo.counted(p, bo.cuts(p, columns), "gold"), columns))


query("ml9_auc_scan", CTE + f", x AS (SELECT 'p' AS model, gold, p FROM probe UNION ALL SELECT 'size', gold, CAST(size AS DOUBLE) FROM probe), r AS (SELECT model, gold, {AVG_RANK.format(k='model')} AS r FROM x) SELECT model AS feature, round((sum(CASE WHEN gold = 1 THEN r END) - sum(gold) * (sum(gold) + 1) / 2e0) / (sum(gold) * sum(1 - gold)), 6) AS auc FROM r GROUP BY model")(
    lambda s, d: fin(ml.auc_scan(probe(s, d), ["p", "size"]))
)
query("ml11_best_threshold", CTE + ", c AS (SELECT DISTINCT model, p AS cut FROM probe), x AS (SELECT c.model, c.cut, avg(CASE WHEN (q.p >= c.cut) = (q.gold = 1) THEN 1e0 ELSE 0 END) AS accuracy FROM c JOIN probe q ON q.model = c.model GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(accuracy, 9) DESC, cut DESC) AS r FROM x) SELECT model, round(cut, 6) AS cut, round(accuracy, 6) AS accuracy FROM r WHERE r = 1")(
    lambda s, d: fin(ml.best_threshold(probe(s, d), ["model"]))
)
