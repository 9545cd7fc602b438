"""Queries over the measurement table: filters, joins, aggregates, rankings, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import ranking as rk
from ..operators import topk as tk
from ..operators.ranges import numbered, quantiles_by
from .measurement import CTE, load, pool, probe, units
from .registry import query


def fin(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as long and doubles rounded, so that engines agree."""
    kinds = dict(df.dtypes)
    return df.select([
        F.col(c).cast("long").alias(c) if k in ("int", "smallint", "tinyint") or k.startswith("decimal") else F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c)
        for c, k in kinds.items()
    ])


def kept(spark, sf_dir) -> DataFrame:
    return probe(spark, sf_dir).withColumn("kept", F.coalesce("pred", F.lit(1)))


def dim(spark, sf_dir) -> DataFrame:
    """Every source of documents with every model: the denominators."""
    groups = load(spark, sf_dir, "documents").select(F.col("source").alias("grp")).distinct()
    return groups.crossJoin(F.broadcast(pool(spark).select("model")))


MACRO_SQL = CTE + """, dim AS (SELECT g.grp, p.model FROM (SELECT DISTINCT source AS grp FROM documents) g CROSS JOIN pool p),
per AS (SELECT model, grp, sum(coalesce(pred, 1)) AS n, sum(coalesce(pred, 1) * gold) AS tp FROM probe GROUP BY model, grp),
full_ AS (SELECT d.model, d.grp, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM dim d LEFT JOIN per USING (model, grp)),
x AS (SELECT model, CASE WHEN n > 0 THEN tp * 1e0 / n END AS prec, CASE WHEN tp > 0 THEN 1 ELSE 0 END AS hit FROM full_)
SELECT model, CAST(sum(hit) AS BIGINT) AS detected, count(*) AS groups, round(avg(1 - prec), 6) AS avg_fdr,
       round(avg(CASE WHEN prec + hit > 0 THEN 2 * prec * hit / (prec + hit) ELSE 0 END), 6) AS avg_f1
FROM x GROUP BY model"""


@query("ag15_macro_detection", MACRO_SQL)
def macro_detection(spark, sf_dir):
    return fin(ag.macro_detection(kept(spark, sf_dir), dim(spark, sf_dir), ["model"]))


# ---- projections and filters ----------------------------------------------------------------------------------------

query("pf1_distinct_columns", "SELECT DISTINCT p_brand, p_type, p_size FROM part")(
    lambda s, d: load(s, d, "part").select("p_brand", "p_type", "p_size").dropDuplicates()
)
query("pf2_host_of_url", "SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(split_part(url, '://', 2), '/', 1) ELSE '' END AS host FROM pages")(
    lambda s, d: load(s, d, "pages").select("page_id", F.when(F.contains("url", F.lit("://")), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))).otherwise("").alias("host"))
)
query("pf3_in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")(
    lambda s, d: load(s, d, "orders").join(load(s, d, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
)
query("pf4_candidate_predicate", "SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1') AND (lang = 'en' OR n_chars > 2000) AND len(list_filter(string_split(text, ' '), lambda x: x NOT IN ('the', 'of', 'and', ''))) > 0")(
    lambda s, d: load(s, d, "documents").where(~F.col("source").isin("src0", "src1") & ((F.col("lang") == "en") | (F.col("n_chars") > 2000)) & F.exists(F.split("text", " "), lambda x: ~x.isin("the", "of", "and", ""))).select("doc_id")
)
query("pf6_any_of_prefixes", "SELECT page_id FROM pages WHERE len(list_filter(['news', 'shop', 'site1'], lambda m: contains(url, m))) > 0")(
    lambda s, d: load(s, d, "pages").where(F.exists(F.array(*map(F.lit, ["news", "shop", "site1"])), lambda m: F.contains("url", m))).select("page_id")
)
query("pf7_like", "SELECT doc_id FROM documents WHERE text LIKE 'The%' AND strpos(text, 'ing') >= 1")(
    lambda s, d: load(s, d, "documents").where(F.col("text").like("The%") & (F.instr("text", "ing") >= 1)).select("doc_id")
)
query("pf8_whole_regex", "SELECT doc_id FROM documents WHERE regexp_full_match(lang, '(?i)(EN|fr)')")(
    lambda s, d: load(s, d, "documents").where(F.rlike("lang", F.lit("^(?:(?i)(EN|fr))$"))).select("doc_id")
)
CONV = "SELECT conv_id, list(text ORDER BY turn) AS flow FROM conversations GROUP BY conv_id"


def flows(s, d):
    return load(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("flow"))


query("pf9_endpoint_filter", f"WITH c AS ({CONV}) SELECT conv_id FROM c WHERE NOT (regexp_matches(flow[1], 'the|que') OR regexp_matches(flow[len(flow)], 'the|que'))")(
    lambda s, d: flows(s, d).where(~(F.rlike(F.element_at("flow", 1), F.lit("the|que")) | F.rlike(F.element_at("flow", -1), F.lit("the|que")))).select("conv_id")
)
query("pf10_endpoint_filter_wide", f"WITH c AS ({CONV}) SELECT conv_id FROM c WHERE NOT (regexp_matches(flow[1], 'the|que|der|und|con|ing|tion') OR regexp_matches(flow[len(flow)], 'the|que|der|und|con|ing|tion'))")(
    lambda s, d: flows(s, d).where(~(F.rlike(F.element_at("flow", 1), F.lit("the|que|der|und|con|ing|tion")) | F.rlike(F.element_at("flow", -1), F.lit("the|que|der|und|con|ing|tion")))).select("conv_id")
)
query("pf11_no_step_matches", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT bool_or(contains(text, 'heit'))")(
    lambda s, d: flows(s, d).where(~F.exists("flow", lambda x: F.contains(x, F.lit("heit")))).select("conv_id")
)
query("pf12_drop_emptied_groups", "SELECT source, count(*) AS n FROM documents WHERE n_chars > 4000 AND lang = 'fr' GROUP BY source")(
    lambda s, d: load(s, d, "documents").groupBy("source").agg(F.count_if((F.col("n_chars") > 4000) & (F.col("lang") == "fr")).alias("n")).where("n > 0")
)
query("pf13_required_keys", "SELECT conv_id, turn FROM conversations WHERE coalesce(role, '') <> '' AND coalesce(text, '') <> ''")(
    lambda s, d: load(s, d, "conversations").where(F.nullif("role", F.lit("")).isNotNull() & F.nullif("text", F.lit("")).isNotNull()).select("conv_id", "turn")
)
query("pf14_top_classes_head", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5) ORDER BY doc_id LIMIT 50")(
    lambda s, d: (lambda x: x.join(F.broadcast(x.groupBy("source").count().orderBy(F.desc("count"), "source").limit(5).select("source")), "source", "left_semi").select("doc_id", "source").orderBy("doc_id").limit(50))(load(s, d, "documents"))
)
query("pf15_mask", CTE + "SELECT unit_id, model FROM probe WHERE gold = 1 AND cls = 'en'")(
    lambda s, d: probe(s, d).where("gold = 1 and cls = 'en'").select("unit_id", "model")
)
query("pf16_null_report", CTE + "SELECT model, count(*) AS rows_, CAST(sum(CASE WHEN pred IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM probe GROUP BY model")(
    lambda s, d: probe(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("rows_"), F.count_if(F.col("pred").isNull()).alias("nulls"))
)
query("pf18_if_exists", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'buyer' ELSE 'visitor' END AS kind FROM customer")(
    lambda s, d: load(s, d, "customer").join(load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_x", F.lit(1)), "c_custkey", "left").select("c_custkey", F.when(F.col("_x") == 1, "buyer").otherwise("visitor").alias("kind"))
)

# ---- joins ----------------------------------------------------------------------------------------------------------

query("jn1_inner", "SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")(
    lambda s, d: load(s, d, "documents").join(load(s, d, "labels"), "doc_id").select("doc_id", "source", "quality")
)
query("jn2_one_to_one", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(
    lambda s, d: jn.one_to_one(load(s, d, "documents").select("doc_id"), load(s, d, "labels").select("doc_id", "toxic"), "doc_id")
)
query("jn3_suffix", "SELECT a.conv_id, a.text AS text, b.text AS text_s FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn = 0")(
    lambda s, d: (lambda c: c.where("turn = 0").select("conv_id", "text").join(c.where("turn = 1").select("conv_id", F.col("text").alias("text_s")), "conv_id", "left"))(load(s, d, "conversations"))
)
query("jn4_aligned", "SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")(
    lambda s, d: jn.aligned(load(s, d, "labels").select("doc_id"), load(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
)
query("jn5_group_dimension", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_name")(
    lambda s, d: load(s, d, "nation").join(load(s, d, "supplier").where("s_acctbal > 9000").groupBy("s_nationkey").count(), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("count", F.lit(0)).alias("n"))
)
query("jn6_default", "SELECT d.doc_id, coalesce(CAST(quality AS BIGINT), 1) AS keep FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(
    lambda s, d: fin(load(s, d, "documents").join(load(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(1)).alias("keep")))
)
query("jn7_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")(
    lambda s, d: load(s, d, "documents").join(load(s, d, "labels"), "doc_id", "left_semi").select("doc_id")
)
query("jn8_anti", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(
    lambda s, d: load(s, d, "documents").join(load(s, d, "labels"), "doc_id", "left_anti").select("doc_id").distinct()
)


@query("jn9_new_over_cache", "SELECT o.o_orderkey, coalesce(n.q, c.q) AS q FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) n ON n.l_orderkey = o.o_orderkey LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) c ON c.l_orderkey = o.o_orderkey WHERE coalesce(n.q, c.q) IS NOT NULL")
def new_over_cache(s, d):
    """The returned quantity of an order where there is one, else the unreturned one."""
    li = load(s, d, "lineitem")
    most = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias(name))
    both = load(s, d, "orders").select("o_orderkey").join(most("R", "qn"), "o_orderkey", "left").join(most("N", "qc"), "o_orderkey", "left")
    return both.select("o_orderkey", F.coalesce("qn", "qc").alias("q")).where("q is not null")


query("jn10_upsert", "SELECT doc_id, coalesce(b.kind, a.kind, 'none') AS kind FROM (SELECT doc_id, lang AS kind FROM documents WHERE doc_id % 3 = 0) a FULL JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' END AS kind FROM labels) b USING (doc_id)")(
    lambda s, d: jn.upsert(load(s, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("kind")), load(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("kind")), ["doc_id"], "kind", "none")
)
query("jn11_three_keys", "SELECT a.l_orderkey, count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') b USING (l_orderkey, l_partkey, l_suppkey) GROUP BY a.l_orderkey")(
    lambda s, d: (lambda li: li.join(li.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey").distinct(), ["l_orderkey", "l_partkey", "l_suppkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")))(load(s, d, "lineitem"))
)
SPANS = "SELECT o_custkey AS k, CAST(o_orderkey % 500 AS BIGINT) AS a, CAST(o_orderkey % 500 + 40 + o_orderkey % 7 AS BIGINT) AS z, o_orderkey AS name FROM orders"
POINTS = "SELECT DISTINCT o_custkey AS k, CAST(o_orderkey * 13 % 500 AS BIGINT) AS x FROM orders"


def spans(s, d):
    k = F.col("o_orderkey")
    return load(s, d, "orders").select(F.col("o_custkey").alias("k"), (k % 500).cast("long").alias("a"), (k % 500 + 40 + k % 7).cast("long").alias("z"), k.alias("name"))


def points(s, d):
    return load(s, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") * 13 % 500).cast("long").alias("x")).distinct()


query("jn13_innermost_latest", f"WITH s AS ({SPANS}), p AS ({POINTS}), j AS (SELECT p.k, p.x, s.a, s.z, s.name, row_number() OVER (PARTITION BY p.k, p.x ORDER BY s.a DESC, s.z, s.name) AS r FROM p JOIN s ON p.k = s.k AND p.x BETWEEN s.a AND s.z) SELECT k, x, a, z, name FROM j WHERE r = 1")(
    lambda s, d: jn.enclosing(points(s, d).withColumn("pid", F.col("x")), spans(s, d), "k", "x", "a", "z", "pid").drop("pid")
)
query("jn14_innermost_shortest", f"WITH s AS ({SPANS}), p AS ({POINTS}), j AS (SELECT p.k, p.x, s.a, s.z, s.name, row_number() OVER (PARTITION BY p.k, p.x ORDER BY s.z - s.a, s.a, s.z, s.name) AS r FROM p JOIN s ON p.k = s.k AND p.x BETWEEN s.a AND s.z) SELECT k, x, a, z, name FROM j WHERE r = 1")(
    lambda s, d: jn.enclosing(points(s, d).withColumn("pid", F.col("x")), spans(s, d), "k", "x", "a", "z", "pid", "shortest").drop("pid")
)
query("jn15_any_hit", f"WITH s AS ({SPANS}), p AS ({POINTS}) SELECT k, x FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.k = p.k AND p.x BETWEEN s.a AND s.z)")(
    lambda s, d: jn.hits_any(points(s, d), spans(s, d), "k", "x", "a", "z").select("k", "x")
)
query("jn16_suffix_path", "WITH a AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS u FROM pages), b AS (SELECT DISTINCT split_part(regexp_replace(url, '^https?://', ''), '/', -1) AS v FROM pages) SELECT u, v FROM a JOIN b ON u = v OR ends_with(u, '/' || v) OR ends_with(v, '/' || u)")(
    lambda s, d: (lambda u: jn.suffix_join(u, u.select(F.substring_index("u", "/", -1).alias("v")).distinct(), "u", "v"))(load(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("u")).distinct())
)
query("jn17_set_overlap", "SELECT DISTINCT a.o_custkey FROM (SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') a JOIN (SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'N') b USING (o_custkey, l_partkey)")(
    lambda s, d: (lambda x: x.where("l_returnflag = 'R'").select("o_custkey", "l_partkey").join(x.where("l_returnflag = 'N'"), ["o_custkey", "l_partkey"], "left_semi").select("o_custkey").distinct())(load(s, d, "orders").join(load(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", "l_returnflag"))
)
query("jn18_dedup_apply", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM documents")(
    lambda s, d: jn.dedup_apply(load(s, d, "documents").select("doc_id", "text"), "text", lambda u: u.withColumns({"n": F.length("text").cast("long"), "digest": F.md5(F.encode("text", "UTF-8"))})).select("doc_id", "n", "digest")
)
query("jn19_stem_fallback", "SELECT p.page_id, coalesce(a.n, b.n) AS n FROM pages p LEFT JOIN (SELECT page_id % 50 AS k, count(*) AS n FROM pages WHERE page_id % 2 = 0 GROUP BY 1) a ON a.k = p.page_id LEFT JOIN (SELECT page_id % 20 AS k, count(*) AS n FROM pages GROUP BY 1) b ON b.k = p.page_id % 20")(
    lambda s, d: (lambda p: p.select("page_id").join(p.where("page_id % 2 = 0").groupBy((F.col("page_id") % 50).alias("page_id")).agg(F.count(F.lit(1)).alias("na")), "page_id", "left").withColumn("k", F.col("page_id") % 20).join(p.groupBy((F.col("page_id") % 20).alias("k")).agg(F.count(F.lit(1)).alias("nb")), "k", "left").select("page_id", F.coalesce("na", "nb").alias("n")))(load(s, d, "pages"))
)
query("jn21_pair_pivot", CTE + "SELECT unit_id, max(CASE WHEN m = 0 THEN pred END) AS weak, max(CASE WHEN m = 3 THEN pred END) AS strong FROM probe GROUP BY unit_id HAVING weak IS NOT NULL AND strong IS NOT NULL")(
    lambda s, d: probe(s, d).groupBy("unit_id").pivot("m", [0, 3]).agg(F.max("pred")).toDF("unit_id", "weak", "strong").where("weak is not null and strong is not null")
)
query("jn22_model_pairs", CTE + "SELECT a.model AS a, b.model AS b, count(*) AS n, CAST(sum(CASE WHEN a.pred = b.pred THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m < b.m GROUP BY 1, 2")(
    lambda s, d: (lambda p: p.select("unit_id", "m", F.col("model").alias("a"), F.col("pred").alias("pa")).join(p.select("unit_id", F.col("m").alias("m2"), F.col("model").alias("b"), F.col("pred").alias("pb")), "unit_id").where("m < m2").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pa") == F.col("pb")).alias("agree")))(probe(s, d))
)
@query("jn23_cheaper_pairs", CTE + ", c AS (SELECT model, avg(seconds) AS c FROM probe GROUP BY model) SELECT a.model AS small, b.model AS large, round(b.c / a.c, 6) AS times FROM c a JOIN c b ON a.c < b.c")
def cheaper_pairs(s, d):
    """All ordered pairs of models of which the first was measured to be cheaper; a row for each model meets the others."""
    cost = probe(s, d).groupBy("model").agg(F.avg("seconds").alias("c"))
    large = cost.select(F.col("model").alias("large"), F.col("c").alias("k"))
    return fin(cost.withColumnRenamed("model", "small").join(F.broadcast(large), F.col("c") < F.col("k")).select("small", "large", (F.col("k") / F.col("c")).alias("times")))
query("jn25_exists_not_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')")(
    lambda s, d: (lambda c, o: c.join(o.where("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_semi").join(o.where("o_orderpriority = '5-LOW'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))(load(s, d, "customer"), load(s, d, "orders"))
)
query("jn26_forall", "SELECT l_orderkey, bool_and(l_quantity > 5) AS holds FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: jn.for_all(load(s, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 5, True)
)
query("jn28_first_right_else_first", CTE + "SELECT unit_id, CAST(coalesce(min(CASE WHEN coalesce(pred, 1) = gold THEN m END), 0) AS BIGINT) AS m FROM probe GROUP BY unit_id")(
    lambda s, d: fin(probe(s, d).groupBy("unit_id").agg(F.coalesce(F.min(F.when(F.coalesce("pred", F.lit(1)) == F.col("gold"), F.col("m"))), F.lit(0)).alias("m")))
)
query("jn29_reconcile", "SELECT CAST(0 AS BIGINT) AS differences")(
    lambda s, d: (lambda a, b: jn.reconcile(a, b, ["grp"], ["n", "pos"]).agg(F.count(F.lit(1)).alias("differences")))(units(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("pos")), units(s, d).groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("pos")).groupBy("grp").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
)
query("jn30_other_groups", CTE + "SELECT a.grp, count(*) AS n, CAST(sum(b.pos) AS BIGINT) AS pos FROM (SELECT DISTINCT grp FROM unit) a JOIN (SELECT grp, sum(gold) AS pos FROM unit GROUP BY grp) b ON a.grp <> b.grp GROUP BY a.grp")(
    lambda s, d: (lambda g: g.select("grp").join(g.select(F.col("grp").alias("g2"), "pos"), F.col("grp") != F.col("g2")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos")))(units(s, d).groupBy("grp").agg(F.sum("gold").alias("pos")))
)
query("jn31_dimension_lookup", CTE + "SELECT model, round(sum(size * unit_cost), 6) AS cost FROM probe0 GROUP BY model")(
    lambda s, d: fin(probe(s, d).select("model", "size").join(F.broadcast(pool(s).select("model", "unit_cost")), "model").groupBy("model").agg(F.sum(F.col("size") * F.col("unit_cost")).alias("cost")))
)

# ---- aggregates -----------------------------------------------------------------------------------------------------

query("ag1_count_distinct", "SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts FROM documents GROUP BY source")(
    lambda s, d: load(s, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("text").alias("texts"))
)
query("ag2_complete_case", CTE + "SELECT unit_id, model FROM probe WHERE pred IS NOT NULL AND unit_id IN (SELECT unit_id FROM probe WHERE pred IS NOT NULL GROUP BY unit_id HAVING count(DISTINCT model) = 4)")(
    lambda s, d: ag.complete_case(probe(s, d).where("pred is not null")).select("unit_id", "model")
)
query("ag3_group_sums", CTE + "SELECT grp, count(*) AS n, CAST(sum(gold) AS BIGINT) AS pos, CAST(sum(size) AS BIGINT) AS size FROM unit GROUP BY grp")(
    lambda s, d: units(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("pos"), F.sum("size").alias("size"))
)
query("ag4_group_max", CTE + "SELECT grp, max(gold) AS gold, bool_or(coalesce(pred, 0) = 1) AS flagged FROM probe GROUP BY grp")(
    lambda s, d: probe(s, d).groupBy("grp").agg(F.max("gold").alias("gold"), F.bool_or(F.coalesce("pred", F.lit(0)) == 1).alias("flagged"))
)
query("ag5_mean_having", "SELECT source, round(avg(n_chars), 6) AS mean_size FROM documents GROUP BY source HAVING count(*) >= 30")(
    lambda s, d: fin(load(s, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean_size"), F.count(F.lit(1)).alias("n")).where("n >= 30").drop("n"))
)
query("ag6_group_mean_column", CTE + "SELECT unit_id, round(avg(gold) OVER (PARTITION BY grp), 6) AS base_rate FROM unit")(
    lambda s, d: (lambda u: fin(u.join(u.groupBy("grp").agg(F.avg("gold").alias("base_rate")), "grp").select("unit_id", "base_rate")))(units(s, d))
)
query("ag7_group_shape", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = 2 AND sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = 1)")(
    lambda s, d: (lambda c: c.join(c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("u")).where("n = 2 and u = 1"), "conv_id", "left_semi").select("conv_id", "turn"))(load(s, d, "conversations"))
)
CONF = "count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn, count(*) FILTER (gold = 0 AND pred = 0) AS tn"
query("ag8_confusion", CTE + f"SELECT model, {CONF} FROM probe GROUP BY model")(lambda s, d: ag.confusion(probe(s, d), ["model"]))
query("ag9_confusion_matrix", CTE + "SELECT cls, CAST(sum(CASE WHEN pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_, CAST(sum(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS yes_ FROM probe GROUP BY cls")(
    lambda s, d: probe(s, d).groupBy("cls").pivot("pred", [0, 1]).agg(F.count(F.lit(1))).toDF("cls", "no_", "yes_").fillna(0)
)
query("ag10_one_vs_rest", CTE + """, x AS (SELECT cls AS t, CASE WHEN h % 5 = 0 THEN 'en' ELSE cls END AS g FROM probe0), c AS (SELECT DISTINCT t AS class FROM x)
SELECT class, round(sum(CASE WHEN t = class AND g = class THEN 1 ELSE 0 END) * 1e0 / nullif(sum(CASE WHEN g = class THEN 1 ELSE 0 END), 0), 6) AS precision,
round(sum(CASE WHEN t = class AND g = class THEN 1 ELSE 0 END) * 1e0 / nullif(sum(CASE WHEN t = class THEN 1 ELSE 0 END), 0), 6) AS recall,
round(sum(CASE WHEN (t = class) = (g = class) THEN 1 ELSE 0 END) * 1e0 / count(*), 6) AS accuracy FROM x CROSS JOIN c GROUP BY class""")(
    lambda s, d: (lambda x: fin(ag.one_vs_rest(x, "t", "g", x.select(F.col("t").alias("class")).distinct())))(probe(s, d).select(F.col("cls").alias("t"), F.when((F.col("unit_id") * 7919 + F.col("m") * 104729) % 1000003 % 5 == 0, "en").otherwise(F.col("cls")).alias("g")))
)
PRF = "round({z}tp * 1e0 / nullif(tp + fp, 0){e}, 6) AS precision, round({z}tp * 1e0 / nullif(tp + fn, 0){e}, 6) AS recall, round({z}2e0 * tp / nullif(2 * tp + fp + fn, 0){e}, 6) AS f1"
query("ag11_prf_zero", CTE + f", c AS (SELECT model, grp, {CONF} FROM probe GROUP BY model, grp) SELECT model, grp, {PRF.format(z='coalesce(', e=', 0)')} FROM c")(
    lambda s, d: fin(ag.prf(ag.confusion(probe(s, d), ["model", "grp"])).select("model", "grp", "precision", "recall", "f1"))
)
query("ag12_prf_null", CTE + f", c AS (SELECT model, grp, {CONF} FROM probe GROUP BY model, grp) SELECT model, grp, {PRF.format(z='', e='')} FROM c")(
    lambda s, d: fin(ag.prf(ag.confusion(probe(s, d), ["model", "grp"]), False).select("model", "grp", "precision", "recall", "f1"))
)


@query("ag13_balanced_accuracy", CTE + f", c AS (SELECT model, {CONF} FROM probe GROUP BY model) SELECT model, round((tp * 1e0 / (tp + fn) + tn * 1e0 / (tn + fp)) / 2, 6) AS balanced, round((2e0 * tp / (2 * tp + fp + fn) * (tp + fn) + 2e0 * tn / (2 * tn + fp + fn) * (tn + fp)) / (tp + fp + fn + tn), 6) AS weighted_f1 FROM c")
def balanced_accuracy(s, d):
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1 = lambda hit: 2 * hit / (2 * hit + fp + fn)
    balanced = (tp / (tp + fn) + tn / (tn + fp)) / 2
    weighted = (f1(tp) * (tp + fn) + f1(tn) * (tn + fp)) / (tp + fp + fn + tn)
    return fin(ag.confusion(probe(s, d), ["model"]).select("model", balanced.alias("balanced"), weighted.alias("weighted_f1")))


query("ag14_capped_tp", "SELECT o_custkey, CAST(sum(least(n, 3)) AS BIGINT) AS tp, CAST(sum(n) - sum(least(n, 3)) AS BIGINT) AS dup FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY o_custkey")(
    lambda s, d: load(s, d, "orders").join(load(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey").agg(F.sum(F.least("n", F.lit(3))).alias("tp"), (F.sum("n") - F.sum(F.least("n", F.lit(3)))).alias("dup"))
)
query("ag16_micro_macro", CTE + f", c AS (SELECT model, grp, {CONF} FROM probe GROUP BY model, grp) SELECT model, round(sum(tp) * 1e0 / nullif(sum(tp + fn), 0), 6) AS micro_recall, round(avg(tp * 1e0 / nullif(tp + fn, 0)), 6) AS macro_recall, round(avg(CASE WHEN tp > 0 THEN 1e0 ELSE 0e0 END), 6) AS binary_recall FROM c GROUP BY model")(
    lambda s, d: fin(ag.confusion(probe(s, d), ["model", "grp"]).groupBy("model").agg(F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("micro_recall"), F.avg(F.try_divide("tp", F.col("tp") + F.col("fn"))).alias("macro_recall"), F.avg((F.col("tp") > 0).cast("double")).alias("binary_recall")))
)
query("ag18_graded_quality", CTE + "SELECT model, round(avg(CASE WHEN coalesce(pred, 0) = gold THEN 1e0 WHEN gold = 1 THEN 0e0 ELSE 0.9e0 END), 6) AS quality, round(avg(CASE WHEN gold = 1 AND coalesce(pred, 0) = 0 THEN 5e0 WHEN gold = 0 AND pred = 1 THEN 1e0 ELSE 0e0 END), 6) AS loss FROM probe GROUP BY model")(
    lambda s, d: (lambda ro: fin(probe(s, d).groupBy("model").agg(F.avg(ro.quality()).alias("quality"), F.avg(ro.loss()).alias("loss"))))(__import__("tributary.operators.routing", fromlist=["x"]))
)
query("ag19_graded_effect", CTE + "SELECT unit_id, model, round(least(exp(ln(greatest(CASE WHEN gold = 1 THEN p ELSE 1 - p END, 1e-6))), 1e0), 6) AS effect, round(CASE WHEN gold = 1 THEN p ELSE 1 - p / 10e0 END, 6) AS utility FROM probe")(
    lambda s, d: fin(probe(s, d).select("unit_id", "model", F.least(F.exp(F.ln(F.greatest(F.when(F.col("gold") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-6)))), F.lit(1.0)).alias("effect"), F.when(F.col("gold") == 1, F.col("p")).otherwise(1 - F.col("p") / 10.0).alias("utility")))
)
query("ag21_tpr_minus_fpr", CTE + f", c AS (SELECT model, cls, {CONF} FROM probe GROUP BY model, cls) SELECT model, round(sum(tp) * 1e0 / nullif(sum(tp + fn), 0) - sum(fp) * 1e0 / nullif(sum(fp + tn), 0), 6) AS overall, round(avg(tp * 1e0 / nullif(tp + fn, 0) - fp * 1e0 / nullif(fp + tn, 0)), 6) AS mean_of_classes FROM c GROUP BY model")(
    lambda s, d: fin(ag.confusion(probe(s, d), ["model", "cls"]).groupBy("model").agg((F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))) - F.try_divide(F.sum("fp"), F.sum(F.col("fp") + F.col("tn")))).alias("overall"), F.avg(F.try_divide("tp", F.col("tp") + F.col("fn")) - F.try_divide("fp", F.col("fp") + F.col("tn"))).alias("mean_of_classes")))
)
query("ag22_min_max", CTE + ", b AS (SELECT grp, min(size) AS lo, max(size) AS hi FROM unit GROUP BY grp) SELECT unit_id, round(CASE WHEN hi > lo THEN (size - lo) * 1e0 / (hi - lo) ELSE 0 END, 6) AS scaled FROM unit JOIN b USING (grp)")(
    lambda s, d: fin(ag.min_max(units(s, d), "size", ["grp"]).select("unit_id", "scaled"))
)
@query("ag23_quantiles", CTE + "SELECT model, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.9), 6) AS p90 FROM probe GROUP BY model")
def quantiles(s, d):
    return fin(quantiles_by(probe(s, d), ["model"], "p", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))
query("ag24_nearest_rank", CTE + ", x AS (SELECT model, p, row_number() OVER (PARTITION BY model ORDER BY p) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM probe) SELECT model, round(p, 6) AS p FROM x WHERE r = least(CAST(floor(0.75 * n) AS BIGINT), n - 1)")(
    lambda s, d: fin(ag.nearest_rank(probe(s, d), ["model"], "p", 0.75))
)
@query("ag25_moments", CTE + "SELECT model, round(avg(seconds), 6) AS mean, round(median(seconds), 6) AS median, round(stddev_pop(seconds), 6) AS pstdev, round(stddev_samp(seconds), 6) AS sstdev FROM probe GROUP BY model")
def moments(s, d):
    p = probe(s, d)
    rest = p.groupBy("model").agg(F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("pstdev"), F.stddev_samp("seconds").alias("sstdev"))
    return fin(quantiles_by(p, ["model"], "seconds", {"median": 0.5}).join(rest, "model").select("model", "mean", "median", "pstdev", "sstdev"))
@query("ag26_spread", CTE + "SELECT model, round(stddev_samp(seconds) / avg(seconds), 6) AS cv, round(quantile_cont(seconds, 0.9) / quantile_cont(seconds, 0.1), 6) AS tail, round(corr(size, seconds), 6) AS corr FROM probe GROUP BY model")
def spread(s, d):
    p = probe(s, d)
    rest = p.groupBy("model").agg((F.stddev_samp("seconds") / F.avg("seconds")).alias("cv"), F.corr("size", "seconds").alias("corr"))
    tail = quantiles_by(p, ["model"], "seconds", {"low": 0.1, "high": 0.9}).select("model", (F.col("high") / F.col("low")).alias("tail"))
    return fin(rest.join(tail, "model").select("model", "cv", "tail", "corr"))
query("ag27_votes", CTE + "SELECT unit_id, CAST(coalesce(sum(pred), 0) AS BIGINT) AS yes, count(pred) AS n, CAST(2 * coalesce(sum(pred), 0) > count(pred) AS BIGINT) AS majority, CAST(count(pred) > 0 AND coalesce(sum(pred), 0) = count(pred) AS BIGINT) AS unanimous FROM probe GROUP BY unit_id")(
    lambda s, d: fin(ag.votes(probe(s, d)).fillna(0))
)
query("ag28_ordered_concat", "SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")(
    lambda s, d: load(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ", ").alias("roles"))
)
query("ag29_top_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")(
    lambda s, d: load(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)
)
query("ag30_counter_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")(
    lambda s, d: load(s, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))
)
query("ag32_min_over_runs", "SELECT l_orderkey, l_linenumber, CAST(floor(min(l_extendedprice / l_quantity) * 1000) AS BIGINT) AS unit_cost FROM lineitem GROUP BY 1, 2")(
    lambda s, d: fin(load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.min(F.col("l_extendedprice") / F.col("l_quantity")) * 1000).alias("unit_cost")))
)
query("ag34_array_summary", "SELECT vec_id, round(list_avg(embedding), 5) AS mean, round(list_min(embedding), 5) AS low, round(len(list_filter(embedding, lambda x: x < 0)) * 1e0 / len(embedding), 6) AS negative FROM embeddings")(
    lambda s, d: load(s, d, "embeddings").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding"), 5).alias("mean"), F.round(F.array_min("embedding").cast("double"), 5).alias("low"), F.round(F.size(F.filter("embedding", lambda x: x < 0)) / F.size("embedding"), 6).alias("negative"))
)
query("ag36_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")(
    lambda s, d: jn.last_wins(load(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")
)
query("ag37_bands", CTE + "SELECT CASE WHEN size < 800 THEN 'short' WHEN size < 3000 THEN 'middle' ELSE 'long' END AS band, round(avg(CASE WHEN m = 0 THEN coalesce(pred, 0) END), 6) AS tiny, round(avg(CASE WHEN m = 3 THEN coalesce(pred, 0) END), 6) AS large FROM probe GROUP BY 1")(
    lambda s, d: fin(probe(s, d).withColumn("band", F.when(F.col("size") < 800, "short").when(F.col("size") < 3000, "middle").otherwise("long")).groupBy("band").pivot("model", ["tiny", "large"]).agg(F.avg(F.coalesce("pred", F.lit(0)))))
)


@query("ag39_gain_loss", CTE + "SELECT round(avg(CASE WHEN coalesce(a.pred, 0) <> a.gold AND coalesce(b.pred, 0) = a.gold THEN 1e0 ELSE 0 END), 6) AS fixes, round(avg(CASE WHEN coalesce(a.pred, 0) = a.gold AND coalesce(b.pred, 0) <> a.gold THEN 1e0 ELSE 0 END), 6) AS breaks, round(avg(CASE WHEN coalesce(a.pred, 0) = coalesce(b.pred, 0) THEN 1e0 ELSE 0 END), 6) AS agree FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND a.m = 0 AND b.m = 3")
def gain_loss(s, d):
    """How often the largest model mends the smallest one's verdict, spoils it, and agrees with it."""
    p, pred = probe(s, d), F.coalesce("pred", F.lit(0))
    both = p.where("m = 0").select("unit_id", "gold", pred.alias("a")).join(p.where("m = 3").select("unit_id", pred.alias("b")), "unit_id")
    a, b = (F.col(c) == F.col("gold") for c in "ab")
    share = lambda x, name: F.avg(x.cast("double")).alias(name)
    return fin(both.agg(share(~a & b, "fixes"), share(a & ~b, "breaks"), share(F.col("a") == F.col("b"), "agree")))


query("ag40_cheapest_correct", CTE + "SELECT unit_id, round(min(CASE WHEN pred = gold THEN seconds END), 6) AS cost FROM probe GROUP BY unit_id")(lambda s, d: fin(ag.cheapest_correct(probe(s, d))))
query("ag41_unanimity", CTE + ", x AS (SELECT unit_id, min(pred) AS lo, max(pred) AS hi, min(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS ar, max(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS sr FROM probe WHERE pred IS NOT NULL GROUP BY unit_id) SELECT round(avg(CASE WHEN lo = hi THEN 1e0 ELSE 0 END), 6) AS unanimous, round(avg(ar), 6) AS all_right, round(avg(1 - sr), 6) AS all_wrong, round(avg(CASE WHEN lo <> hi THEN 1e0 ELSE 0 END), 6) AS live FROM x")(
    lambda s, d: fin(ag.unanimity(probe(s, d)))
)
query("ag42_cardinalities", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")(
    lambda s, d: __import__("functools").reduce(lambda a, b: a.union(b), [load(s, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("documents", "labels", "pages")])
)

# ---- top-k and windows ----------------------------------------------------------------------------------------------

RANK = "row_number() OVER (PARTITION BY model, grp ORDER BY p DESC, unit_id)"
query("tk1_top_k", CTE + f", r AS (SELECT unit_id, model, {RANK} AS rn FROM probe) SELECT unit_id, model, rn FROM r WHERE rn <= 3")(
    lambda s, d: fin(tk.top_k(probe(s, d), ["model", "grp"], "p", 3).select("unit_id", "model", "rn"))
)
query("tk2_top_share", CTE + f", r AS (SELECT unit_id, model, grp, {RANK} AS rn, count(*) OVER (PARTITION BY model, grp) AS n FROM probe) SELECT unit_id, model FROM r WHERE rn <= round_even(0.15 * n, 0)")(
    lambda s, d: tk.top_share(probe(s, d), ["model", "grp"], "p", 0.15).select("unit_id", "model")
)
query("tk3_top_share_one", CTE + f", r AS (SELECT unit_id, model, grp, {RANK} AS rn, count(*) OVER (PARTITION BY model, grp) AS n FROM probe) SELECT unit_id, model FROM r WHERE rn <= greatest(1, round_even(0.02 * n, 0))")(
    lambda s, d: tk.top_share(probe(s, d), ["model", "grp"], "p", 0.02, 1).select("unit_id", "model")
)
query("tk5_floor_flag", CTE + f", r AS (SELECT unit_id, grp, {RANK} AS rn FROM probe WHERE m = 1) SELECT unit_id, rn <= 5 AS forced FROM r")(
    lambda s, d: tk.ranked(probe(s, d).where("m = 1"), ["model", "grp"], "p").select("unit_id", (F.col("rn") <= 5).alias("forced"))
)
query("tk7_head", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")(
    lambda s, d: load(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
)
query("tk8_argmin_first", CTE + ", r AS (SELECT unit_id, m, row_number() OVER (PARTITION BY unit_id ORDER BY abs(coalesce(pred, 0) - gold), m) AS rn FROM probe) SELECT unit_id, CAST(m AS BIGINT) AS m FROM r WHERE rn = 1")(
    lambda s, d: fin(tk.arg_best(probe(s, d).withColumn("v", F.abs(F.coalesce("pred", F.lit(0)) - F.col("gold"))), ["unit_id"], "v", "m", ["m"]))
)
query("tk9_ends", f"WITH c AS ({CONV}) SELECT conv_id, CASE WHEN len(flow) > 4 THEN flow[1:2] || flow[len(flow)-1:] ELSE flow END AS ends FROM c")(
    lambda s, d: flows(s, d).select("conv_id", tk.ends_of("flow", 2).alias("ends"))
)
query("tk10_strided", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x, i: i > 1 AND i < len(embedding) AND (i - 2) % greatest(1, len(embedding) // 10) = 0)) AS BIGINT) AS n FROM embeddings")(
    lambda s, d: load(s, d, "embeddings").select("vec_id", F.size(tk.strided("embedding")).cast("long").alias("n"))
)
query("tk11_budget_prefix", "WITH x AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn FROM x WHERE s <= 1200 OR r = 1")(
    lambda s, d: tk.budget_prefix(load(s, d, "conversations").withColumn("n", F.length("text")), ["conv_id"], "turn", "n", 1200).select("conv_id", "turn")
)
query("wn1_running_counts", CTE + "SELECT unit_id, model, CAST(sum(gold) OVER w AS BIGINT) AS cum_tp, CAST(sum(1 - gold) OVER w AS BIGINT) AS cum_fp FROM probe WINDOW w AS (PARTITION BY model ORDER BY p DESC, unit_id ROWS UNBOUNDED PRECEDING)")(
    lambda s, d: tk.running_counts(probe(s, d), ["model"], "p").select("unit_id", "model", "cum_tp", "cum_fp")
)
query("wn3_percentile_rank", CTE + "SELECT unit_id, model, round(CASE WHEN count(*) OVER g > 1 THEN (rank() OVER o + (count(*) OVER t - 1) / 2e0 - 1) / (count(*) OVER g - 1) ELSE 0.5e0 END, 6) AS pct FROM probe WINDOW g AS (PARTITION BY model, grp), o AS (PARTITION BY model, grp ORDER BY p), t AS (PARTITION BY model, grp, p)")(
    lambda s, d: fin(tk.percentile_rank(probe(s, d), ["model", "grp"], "p").select("unit_id", "model", "pct"))
)
query("wn5_quartile_bins", CTE + ", q AS (SELECT quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.5) AS b, quantile_cont(size, 0.75) AS c FROM unit) SELECT unit_id, CAST(CASE WHEN size <= a THEN 0 WHEN size <= b THEN 1 WHEN size <= c THEN 2 ELSE 3 END AS BIGINT) AS bin FROM unit CROSS JOIN q")(
    lambda s, d: fin(tk.quartile_bins(units(s, d), "size").select("unit_id", "bin"))
)
@query("wn8_increments", CTE + ", c AS (SELECT DISTINCT seconds AS x FROM probe WHERE m = 0) SELECT round(x, 6) AS x, round(x - lag(x) OVER (ORDER BY x), 6) AS dx FROM c")
def increments(s, d):
    """Neighbours among the distinct values, met by their numbers."""
    x = numbered(probe(s, d).where("m = 0").select(F.col("seconds").alias("x")).distinct(), [], ["x"])
    before = x.select((F.col("rn") + 1).alias("rn"), F.col("x").alias("before"))
    return fin(x.join(before, "rn", "left").select("x", (F.col("x") - F.col("before")).alias("dx")))
query("wn9_trapezoid", CTE + ", c AS (SELECT model, size AS x, avg(p) AS y FROM probe GROUP BY 1, 2), s AS (SELECT model, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM c WINDOW w AS (PARTITION BY model ORDER BY x)) SELECT model, round(coalesce(sum(a), 0), 3) AS area FROM s GROUP BY model")(
    lambda s, d: fin(tk.trapezoid(probe(s, d).groupBy("model", F.col("size").alias("x")).agg(F.avg("p").alias("y")), ["model"], "x", "y"), 3)
)
CURVE = CTE + ", k AS (SELECT size AS x, avg(p) AS y FROM probe WHERE m = 3 GROUP BY size)"


@query("wn10_interpolate", CURVE + """, g AS (SELECT DISTINCT CAST(floor(size / 100) * 100 AS DOUBLE) AS g FROM unit),
e AS (SELECT g, (SELECT max(x) FROM k WHERE x <= g) AS x1, (SELECT min(x) FROM k WHERE x > g) AS x2 FROM g)
SELECT round(g, 6) AS g, round(CASE WHEN x1 IS NULL THEN b.y WHEN x2 IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (g - x1) / (x2 - x1) END, 6) AS value
FROM e LEFT JOIN k a ON a.x = x1 LEFT JOIN k b ON b.x = x2""")
def interpolated(s, d):
    """The mean score by size, as a curve, read at all hundreds."""
    curve = probe(s, d).where("m = 3").groupBy(F.col("size").cast("double").alias("x")).agg(F.avg("p").alias("y"))
    grid = units(s, d).select((F.floor(F.col("size") / 100) * 100).cast("double").alias("g")).distinct()
    return fin(tk.interpolate(curve, grid))
query("wn13_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events")(
    lambda s, d: load(s, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("last_click"))
)
query("wn14_binding", CTE + ", n AS (SELECT grp, count(*) AS n FROM unit GROUP BY grp) SELECT unit_id, n > 30 AS binds FROM unit JOIN n USING (grp)")(
    lambda s, d: (lambda u: u.join(u.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp").select("unit_id", (F.col("n") > 30).alias("binds")))(units(s, d))
)

# ---- sets -----------------------------------------------------------------------------------------------------------

query("st1_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")(
    lambda s, d: load(s, d, "documents").where("lang = 'en'").select("doc_id").intersect(load(s, d, "labels").where("quality = 1").select("doc_id"))
)
query("st2_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")(lambda s, d: load(s, d, "documents").select("doc_id").exceptAll(load(s, d, "labels").select("doc_id")).distinct())
query("st2_venn", "SELECT CASE WHEN a IS NULL THEN 'only_b' WHEN b IS NULL THEN 'only_a' ELSE 'both' END AS part, count(*) AS n FROM (SELECT doc_id, 1 AS a FROM documents WHERE doc_id % 2 = 0) x FULL JOIN (SELECT doc_id, 1 AS b FROM labels) y USING (doc_id) GROUP BY 1")(
    lambda s, d: load(s, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("a")).join(load(s, d, "labels").select("doc_id", F.lit(1).alias("b")), "doc_id", "full_outer").groupBy(F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both").alias("part")).agg(F.count(F.lit(1)).alias("n"))
)
query("st3_union_by_name", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")(
    lambda s, d: load(s, d, "documents").select(F.col("doc_id").alias("id"), "lang").unionByName(load(s, d, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)
)
query("st4_union_set", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 0 UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")(
    lambda s, d: load(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k")).union(load(s, d, "customer").where("c_acctbal < 0").select("c_nationkey")).distinct()
)
query("st5_names_in_many_groups", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 4")(
    lambda s, d: load(s, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n >= 4").select("user_id")
)
query("st6_overlap_first", "WITH x AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS a FROM orders GROUP BY 1) SELECT o_custkey, list_min(list_intersect(a, ['O', 'P'])) AS first_ FROM x WHERE list_has_any(a, ['O', 'P'])")(
    lambda s, d: load(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a")).where(F.arrays_overlap("a", F.array(F.lit("O"), F.lit("P")))).select("o_custkey", F.array_min(F.array_intersect("a", F.array(F.lit("O"), F.lit("P")))).alias("first_"))
)
query("st7_empty", "SELECT doc_id FROM documents WHERE 1 = 0")(lambda s, d: load(s, d, "documents").select("doc_id").where("1 = 0"))

# ---- ranking metrics ------------------------------------------------------------------------------------------------

AVG_RANK = "rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2e0"
PARTS = "SELECT {k}, sum(gold) AS pos, sum(1 - gold) AS neg, coalesce(sum(CASE WHEN gold = 1 THEN r END), 0) - sum(gold) * (sum(gold) + 1) / 2e0 AS num FROM (SELECT {k}, gold, " + AVG_RANK + " AS r FROM probe) GROUP BY {k}"
query("rk1_auc", CTE + f", a AS ({PARTS.format(k='model')}) SELECT model, round(num / nullif(pos * neg, 0), 6) AS auc FROM a")(lambda s, d: fin(rk.auc(probe(s, d), ["model"])))
query("rk2_rk3_group_auc", CTE + f", a AS ({PARTS.format(k='model, grp')}) SELECT model, round(avg(num / (pos * neg)), 6) AS mean_auc, round(sum(num) / sum(pos * neg), 6) AS weighted_auc, count(*) AS groups FROM a WHERE pos > 0 AND neg > 0 GROUP BY model")(
    lambda s, d: fin(rk.group_auc(probe(s, d), ["model"]))
)
query("rk4_auc_default", CTE + f", a AS ({PARTS.format(k='model, grp')}) SELECT model, grp, round(coalesce(num / nullif(pos * neg, 0), 0.5e0), 6) AS auc FROM a")(lambda s, d: fin(rk.auc(probe(s, d), ["model", "grp"], default=0.5)))
query("rk6_recall_at_k", CTE + f", r AS (SELECT model, grp, gold, {RANK} AS rn FROM probe), g AS (SELECT model, grp, sum(gold) AS pos, sum(CASE WHEN rn <= 5 THEN gold ELSE 0 END) AS hit, count(*) AS n FROM r GROUP BY 1, 2) SELECT model, round(avg(hit * 1e0 / pos), 6) AS recall_at_k, round(avg(CASE WHEN hit > 0 THEN 1e0 ELSE 0 END), 6) AS det_at_k, round(avg(CASE WHEN n > 15 THEN hit * 1e0 / pos END), 6) AS recall_binding FROM g WHERE pos > 0 GROUP BY model")(
    lambda s, d: fin(rk.recall_at_k(probe(s, d), ["model"], 5))
)
query("rk8_first_hit", CTE + f", r AS (SELECT model, grp, gold, {RANK} AS rn FROM probe), g AS (SELECT model, grp, min(CASE WHEN gold = 1 THEN rn END) AS f, sum(1 - gold) AS fn FROM r GROUP BY 1, 2) SELECT model, grp, f - 1 AS ifa, round((f - 1) * 1e0 / nullif(fn, 0), 6) AS share_read, CAST(coalesce(f <= 1, false) AS BIGINT) AS found_at_1, CAST(coalesce(f <= 5, false) AS BIGINT) AS found_at_5 FROM g")(
    lambda s, d: fin(rk.first_hit(probe(s, d), ["model", "grp"], [1, 5]))
)
query("rk9_random_expectation", CTE + ", g AS (SELECT grp, sum(gold) AS r, sum(1 - gold) AS f FROM unit GROUP BY grp) SELECT grp, round(f * 1e0 / (r + 1), 6) AS e_ifa, round(CASE WHEN f + r < 3 THEN 1e0 ELSE 1 - (greatest(f, 0) * 1e0 / greatest(f + r, 1)) * (greatest(f - 1, 0) * 1e0 / greatest(f + r - 1, 1)) * (greatest(f - 2, 0) * 1e0 / greatest(f + r - 2, 1)) END, 6) AS p_found FROM g")(
    lambda s, d: fin(rk.random_expectation(units(s, d), ["grp"], 3))
)
query("rk10_f1_at_k", CTE + f", r AS (SELECT model, grp, gold, {RANK} AS rn FROM probe), k AS (SELECT model, grp, CASE WHEN rn <= 5 THEN 1 ELSE 0 END AS kept, gold FROM r), dim AS (SELECT g.grp, p.model FROM (SELECT DISTINCT source AS grp FROM documents) g CROSS JOIN pool p), per AS (SELECT model, grp, sum(kept) AS n, sum(kept * gold) AS tp FROM k GROUP BY 1, 2), x AS (SELECT d.model, CASE WHEN n > 0 THEN tp * 1e0 / n END AS prec, CASE WHEN coalesce(tp, 0) > 0 THEN 1 ELSE 0 END AS hit FROM dim d LEFT JOIN per USING (model, grp)) SELECT model, CAST(sum(hit) AS BIGINT) AS detected, count(*) AS groups, round(avg(1 - prec), 6) AS avg_fdr, round(avg(CASE WHEN prec + hit > 0 THEN 2 * prec * hit / (prec + hit) ELSE 0 END), 6) AS avg_f1 FROM x GROUP BY model")(
    lambda s, d: fin(ag.macro_detection(tk.ranked(probe(s, d), ["model", "grp"], "p").withColumn("kept", (F.col("rn") <= 5).cast("int")), dim(s, d), ["model"]))
)
query("rk11_miss_rate", CTE + ", w AS (SELECT model, sum(gold) OVER o AS tp, sum(1 - gold) OVER o AS fp, sum(gold) OVER a AS pos, sum(1 - gold) OVER a AS neg FROM probe WINDOW o AS (PARTITION BY model ORDER BY p DESC, unit_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY model)) SELECT model, round(coalesce(1 - max(CASE WHEN fp <= 0.05 * neg THEN tp END) * 1e0 / nullif(any_value(pos), 0), 1), 6) AS miss_rate FROM w GROUP BY model")(
    lambda s, d: fin(rk.miss_rate_at(probe(s, d), ["model"], 0.05))
)
query("rk12_ece", CTE + ", b AS (SELECT model, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS c, avg(gold) AS a FROM probe GROUP BY 1, 2) SELECT model, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b GROUP BY model")(lambda s, d: fin(rk.ece(probe(s, d), ["model"])))
query("rk13_pair_both_right", CTE + ", t AS (SELECT grp, model, max(CASE WHEN gold = 1 THEN coalesce(pred, 0) END) AS v, min(CASE WHEN gold = 0 THEN coalesce(pred, 0) END) AS q FROM probe GROUP BY 1, 2) SELECT model, round(avg(CASE WHEN v = 1 AND q = 0 THEN 1e0 ELSE 0 END), 6) AS both_right FROM t WHERE v IS NOT NULL AND q IS NOT NULL GROUP BY model")(
    lambda s, d: fin(probe(s, d).withColumn("pred", F.coalesce("pred", F.lit(0))).groupBy("grp", "model").agg(F.max(F.when(F.col("gold") == 1, F.col("pred"))).alias("v"), F.min(F.when(F.col("gold") == 0, F.col("pred"))).alias("q")).where("v is not null and q is not null").groupBy("model").agg(F.avg(((F.col("v") == 1) & (F.col("q") == 0)).cast("double")).alias("both_right")))
)
query("rk15_same_rate_null", CTE + ", r AS (SELECT model, avg(coalesce(pred, 0)) AS r FROM probe GROUP BY model) SELECT model, round(r * (1 - r), 6) AS both_null, round(r * r + (1 - r) * (1 - r), 6) AS agree_null FROM r")(
    lambda s, d: fin(probe(s, d).groupBy("model").agg(F.avg(F.coalesce("pred", F.lit(0))).alias("r")).select("model", (F.col("r") * (1 - F.col("r"))).alias("both_null"), (F.col("r") * F.col("r") + (1 - F.col("r")) * (1 - F.col("r"))).alias("agree_null")))
)
query("rk16_kendall", "WITH x AS (SELECT s_nationkey AS k, avg(s_acctbal) AS a, count(*) AS b FROM supplier GROUP BY 1) SELECT round(sum(sign((u.a - v.a) * (u.b - v.b))) * 1e0 / greatest(sum(abs(sign((u.a - v.a) * (u.b - v.b)))), 1), 6) AS tau FROM x u JOIN x v ON u.k < v.k")(
    lambda s, d: fin(rk.kendall(load(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("a"), F.count(F.lit(1)).alias("b")), "a", "b"))
)
query("rk18_error_correlation", CTE + ", o AS (SELECT unit_id, model, CASE WHEN pred = gold THEN 1e0 ELSE 0 END AS ok FROM probe WHERE pred IS NOT NULL) SELECT a.model, b.model AS model2, round(corr(a.ok, b.ok), 6) AS correlation FROM o a JOIN o b ON a.unit_id = b.unit_id AND a.model < b.model GROUP BY 1, 2")(
    lambda s, d: fin(rk.error_correlation(probe(s, d)))
)
query("rk19_oracle_null", CTE + ", o AS (SELECT unit_id, grp, model, coalesce(CASE WHEN pred = gold THEN 1 ELSE 0 END, 0) AS ok FROM probe), a AS (SELECT grp, model, avg(ok) AS a FROM o GROUP BY 1, 2), m AS (SELECT grp, list_product(list(1 - a ORDER BY a)) AS miss FROM a GROUP BY grp), u AS (SELECT grp, unit_id, max(ok) AS ok FROM o GROUP BY 1, 2), g AS (SELECT grp, avg(ok) AS oracle, count(*) AS n FROM u GROUP BY grp) SELECT round(sum(n * oracle) / sum(n), 6) AS oracle, round(sum(n * (1 - miss)) / sum(n), 6) AS independent FROM g JOIN m USING (grp)")(
    lambda s, d: fin(rk.oracle_null(probe(s, d)))
)
query("rk21_trigger_lift", CTE + ", x AS (SELECT model, CASE WHEN abs(p - 0.5e0) < 0.1e0 THEN 1 ELSE 0 END AS fired, CASE WHEN coalesce(pred, 0) <> gold THEN 1 ELSE 0 END AS wrong FROM probe) SELECT model, round(avg(fired), 6) AS fire_rate, round(avg(CASE WHEN fired = 1 THEN wrong END) / nullif(avg(wrong), 0), 6) AS lift FROM x GROUP BY model")(
    lambda s, d: fin(rk.trigger_lift(probe(s, d).select("model", (F.abs(F.col("p") - 0.5) < 0.1).cast("int").alias("fired"), (F.coalesce("pred", F.lit(0)) != F.col("gold")).cast("int").alias("wrong")), ["model"], "fired", "wrong"))
)
query("rk22_pareto", CTE + ", q AS (SELECT model, cls, avg(CASE WHEN coalesce(pred, 0) = gold THEN 1e0 ELSE 0 END) AS q, avg(seconds) AS c FROM probe GROUP BY 1, 2), b AS (SELECT x.model FROM q x JOIN q y ON x.cls = y.cls AND x.model <> y.model GROUP BY x.model, y.model HAVING bool_and(y.q >= x.q) AND sum(y.c) <= sum(x.c) AND (bool_or(y.q > x.q) OR sum(y.c) < sum(x.c))) SELECT DISTINCT model FROM q WHERE model NOT IN (SELECT model FROM b)")(
    lambda s, d: rk.pareto(probe(s, d).groupBy("model", "cls").agg(F.avg((F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double")).alias("q"), F.avg("seconds").alias("c")), "model", "cls", "q", "c")
)
