"""Queries over reports, arrays, generated code, plug-ins and cross-validated models; SQL for sequential folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extend as ex
from ..operators import graph as gr
from ..operators import learned as ml
from ..operators import ranking as rk
from ..sources import readers as rd
from .core import AVG_RANK, fin
from .formats import folder
from .measurement import CTE, load, probe
from .newton import RECURSIVE, newton_sql
from .registry import ORACLES, query

# ---- sources and sinks ----------------------------------------------------------------------------------------------


@query("sc11_all_runs_first_flow", """WITH c AS (SELECT conv_id, list({'file': role, 'line': turn + 1} ORDER BY turn) AS steps, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS rule, steps[-1].file AS sink_file, CAST(steps[-1].line AS BIGINT) AS sink_line, steps[1].file AS source_file,
       CAST(steps[1].line AS BIGINT) AS source_line, CAST(len(steps) AS BIGINT) AS n_steps, n > 1 AS cross_file FROM c""")
def all_runs_first_flow(s, d):
    """Reports of two runs each, every result twice and with a second flow that does not count."""
    place = lambda uri, line: F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(line.cast("int").alias("startLine")).alias("region"))
    step = F.struct(F.struct(place(F.col("role"), F.col("turn") + 1).alias("physicalLocation")).alias("location"))
    steps = load(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("l"), "role"))).alias("t"))
    last = F.element_at("t", -1)
    flow = lambda x: F.struct(F.array(F.struct(x.alias("locations"))).alias("threadFlows"))
    located = F.array(F.struct(place(last["role"], last["turn"] + 1).alias("physicalLocation")))
    locations = F.transform("t", lambda x: x["l"])
    result = F.struct(F.col("conv_id").cast("string").alias("ruleId"), F.struct(F.lit("m").alias("text")).alias("message"), located.alias("locations"), F.array(flow(locations), flow(F.slice(locations, 1, 1))).alias("codeFlows"))
    twice = F.array(F.struct(F.array("r").alias("results")), F.struct(F.array("r").alias("results")))
    path = folder(s)
    steps.select(result.alias("r")).select(twice.alias("runs")).write.json(path)
    got = rd.alerts(s.read.schema(rd.ALERTS).json(path))
    return fin(got.select("rule", "sink_file", "sink_line", "source_file", "source_line", "n_steps", "cross_file"))


@query("sc19_array_files", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def array_files(s, d):
    """Array files of an id and its vector to a row, as bytes, and their rows again."""

    def files(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for k, b in enumerate(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            values = np.array(b.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
            out = io.BytesIO()
            np.save(out, np.concatenate([ids, values], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.npy"]), pa.array([out.getvalue()], pa.binary())], ["path", "content"])

    made = load(s, d, "embeddings").select("vec_id", "embedding").mapInArrow(files, "path string, content binary")
    total = F.aggregate(F.slice("values", 2, F.size("values")), F.lit(0.0), lambda a, x: a + x)
    return fin(rd.array_rows(made).select(F.get("values", F.lit(0)).cast("long").alias("vec_id"), total.alias("total")), 4)


@query("sc26_generated_predicates", """WITH n AS (SELECT p_brand, 'n.hasName("' || p_name || '")' AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_brand, CAST(k // 30 AS BIGINT) AS part, md5('predicate is_' || p_brand || '_' || CAST(k // 30 AS VARCHAR) || '(Node n) {' || chr(10) || '  ' || string_agg(c, ' or' || chr(10) || '  ' ORDER BY k) || chr(10) || '}') AS digest FROM n GROUP BY p_brand, k // 30""")
def generated_predicates(s, d):
    made = gr.predicates(load(s, d, "part"), "p_brand", F.concat(F.lit('n.hasName("'), "p_name", F.lit('")')), ["p_partkey"], 30)
    return made.select("p_brand", "part", F.md5(F.encode("body", "UTF-8")).alias("digest"))


# ---- text -----------------------------------------------------------------------------------------------------------


@query("sf10_verdict_probability", CTE + ", q AS (SELECT unit_id, pred, least(greatest(p, 0.01e0), 0.99e0) AS q FROM probe WHERE m = 3) SELECT unit_id, CASE WHEN pred IS NULL THEN NULL ELSE round(q / (q + (1 - q) / 2e0), 6) END AS prob FROM q")
def verdict_probability(s, d):
    """A mark spread over two tokens, a verdict before it that does not count, and one after it, if a model gave one."""
    q = F.least(F.greatest(F.col("p"), F.lit(0.01)), F.lit(0.99))
    word = F.when(F.col("pred").isNull(), F.lit("maybe")).when(F.col("pred") == 1, F.lit(" true")).otherwise(F.lit("false "))
    option = lambda t, p: F.struct(F.lit(t).alias("token"), F.ln(p).alias("logprob"))
    token = lambda t, top: F.struct(t.alias("token"), top.alias("top"))
    none = F.array(option(" true", F.lit(0.9)))
    tokens = F.array(token(F.lit("true"), none), token(F.lit("</thi"), none), token(F.lit("nk>"), none), token(word, F.array(option(" true", q), option("false", (1 - q) / 2), option("true", F.lit(0.5)))), token(F.lit("}"), none))
    return fin(probe(s, d).where("m = 3").withColumn("tokens", tokens).select("unit_id", tx.verdict_probability("tokens").alias("prob")))


@query("sf21_renamed", r"""WITH t AS (SELECT p_partkey, regexp_extract_all('class ' || p_name || ' = MAX_A(' || p_brand || ', ' || p_type || '); ' || p_name, '[A-Za-z_]\w*|[^A-Za-z_"/]+|["/]') AS tk FROM part),
i AS (SELECT *, list_filter(tk, lambda x: regexp_matches(x, '^[A-Za-z_]') AND x <> 'class') AS ids FROM t), f AS (SELECT *, list_filter(ids, lambda x, k: list_position(ids, x) = k) AS names FROM i),
g AS (SELECT *, list_filter(names, lambda x: x = upper(x) AND length(x) > 1 AND regexp_matches(x, '[A-Z]')) AS con, list_filter(names, lambda x: regexp_matches(x, '^[A-Z]') AND NOT (x = upper(x) AND length(x) > 1)) AS cls, list_filter(names, lambda x: NOT regexp_matches(x, '^[A-Z]') AND NOT (x = upper(x) AND length(x) > 1 AND regexp_matches(x, '[A-Z]'))) AS nam FROM f)
SELECT p_partkey, array_to_string(list_transform(tk, lambda x: CASE WHEN list_contains(con, x) THEN 'CONST' || list_position(con, x) WHEN list_contains(cls, x) THEN 'Cls' || list_position(cls, x) WHEN list_contains(nam, x) THEN 'name' || list_position(nam, x) ELSE x END), '') AS renamed FROM g""")
def renamed(s, d):
    code = F.concat(F.lit("class "), "p_name", F.lit(" = MAX_A("), "p_brand", F.lit(", "), "p_type", F.lit("); "), "p_name")
    return tx.renamed(load(s, d, "part").withColumn("code", code), "code", ["class"]).select("p_partkey", "renamed")


# ---- graphs ---------------------------------------------------------------------------------------------------------


@query("gx12_supertypes", """WITH RECURSIVE w AS (SELECT DISTINCT string_split(split_part(url, '://', 2), '/') AS w FROM pages), e AS (SELECT DISTINCT array_to_string(w[1 : k], '/') AS src, array_to_string(w[1 : k - 1], '/') AS dst FROM (SELECT w, unnest(generate_series(2, len(w))) AS k FROM w)),
c AS (SELECT DISTINCT node, node AS ancestor FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) UNION SELECT c.node, e.dst FROM c JOIN e ON e.src = c.ancestor) SELECT node, ancestor FROM c""")
def supertypes(s, d):
    """A path's beginnings are its supertypes; the closure is reflexive."""
    paths = load(s, d, "pages").select(F.split(F.substring_index("url", "://", -1), "/").alias("w")).distinct().where("size(w) > 1")
    steps = paths.select("w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("k"))
    upto = lambda n: F.array_join(F.slice("w", F.lit(1), n), "/")
    return gr.closure(steps.select(upto(F.col("k")).alias("src"), upto(F.col("k") - 1).alias("dst")).distinct()).select("node", "ancestor")


@query("gx13_unsanitised", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size IN (2, 3, 5) AND NOT (p_size = 2 AND l_linenumber = 1) AND p_size <> 5")
def unsanitised(s, d):
    """Sinks of two packs of specs together, without what a sanitizer of either covers."""
    shape = "kind string, package string, clazz string, method string, arg int"
    one = s.createDataFrame([("sink", "p", "c", "2", None), ("sanitizer", "p", "c", "2", 1)], shape)
    two = s.createDataFrame([("sink", "p", "c", "3", None), ("sink", "p", "c", "5", None), ("sanitizer", "p", "c", "5", None), ("source", "p", "c", "1", None)], shape)
    parts = load(s, d, "lineitem").join(load(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    calls = parts.select(F.lit("p").alias("package"), F.lit("c").alias("clazz"), F.col("p_size").cast("string").alias("method"), F.col("l_linenumber").alias("arg"), "l_orderkey", "l_partkey")
    return gr.unsanitised(calls, one.union(two)).select("l_orderkey", "l_partkey").distinct()


# ---- learned --------------------------------------------------------------------------------------------------------

#: Fold numbers of units: by units, which leaks groups across folds, and by whole groups.
FOLDS = {"leaky": "(unit_id * 48271 + 7) % 1000003 % 5", "grouped": "cast(replace(grp, 'src', '') AS bigint) % 5"}


def _judged(s, d):
    """Units with the scores of two models, the logarithm of their size, and the label."""
    wide = probe(s, d).groupBy("unit_id", "grp", "size", "gold").agg(*[F.max(F.when(F.col("m") == m, F.col("p"))).alias(f"p{m}") for m in (1, 2)])
    return wide.withColumn("length", F.ln(F.col("size") + 1.0))


JUDGED = ", w AS (SELECT unit_id, grp, gold, max(CASE WHEN m = 1 THEN p END) AS p1, max(CASE WHEN m = 2 THEN p END) AS p2, ln(max(size) + 1e0) AS length FROM probe GROUP BY 1, 2, 3)"
HELD_OUT = (
    RECURSIVE + JUDGED + f""", s AS (SELECT 'leaky' AS scheme, {FOLDS['leaky']} AS fold, * FROM w UNION ALL SELECT 'grouped', {FOLDS['grouped']}, * FROM w),
t AS (SELECT k.scheme, k.fold AS held, gold, p1, p2, length FROM (SELECT DISTINCT scheme, fold FROM s) k JOIN s ON s.scheme = k.scheme AND s.fold <> k.fold)"""
    + newton_sql("t", ["scheme", "held"], ["p1", "p2", "length"], "gold", "1e-3")
    + f""", x AS (SELECT s.scheme AS model, s.fold, gold, round(b0 + b1 * p1 + b2 * p2 + b3 * length, 9) AS p FROM s JOIN fitted f ON f.scheme = s.scheme AND f.held = s.fold),
r AS (SELECT model, fold, gold, {AVG_RANK.format(k='model, fold')} AS r FROM x)
SELECT model AS scheme, CAST(fold AS BIGINT) AS fold, count(*) AS n, round((sum(CASE WHEN gold = 1 THEN r END) - sum(gold) * (sum(gold) + 1) / 2e0) / nullif(sum(gold) * sum(1 - gold), 0), 6) AS auc FROM r GROUP BY 1, 2"""
)


@query("ml8_grouped_auc", HELD_OUT)
def grouped_auc(s, d):
    """The AUC of a fit on two scores and the length on held-out folds, by units at random (which leaks groups) and by
    whole groups. All folds of both schemes are fitted in the same passes."""
    columns, keys = ["p1", "p2", "length"], ["scheme", "held"]
    rows = _judged(s, d)
    both = [rows.select(F.lit(name).alias("scheme"), F.expr(f).cast("long").alias("fold"), "gold", *columns) for name, f in FOLDS.items()]
    both = both[0].union(both[1]).withColumn("l2", F.lit(1e-3))
    cells = both.select("scheme", F.col("fold").alias("held")).distinct()  # a row for each fold
    fitted = ml.newton_logistic(both.join(F.broadcast(cells), "scheme").where("fold <> held"), keys, columns, "gold", "l2")
    scored = ml.predicted(both.withColumn("held", F.col("fold")), fitted, keys, columns)
    scored = scored.withColumn("score", F.round(F.ln(F.col("prob")) - F.ln(1 - F.col("prob")), 9))
    auc = rk.auc(scored, ["scheme", "fold"], "score")
    return fin(auc.join(scored.groupBy("scheme", "fold").agg(F.count(F.lit(1)).alias("n")), ["scheme", "fold"]).select("scheme", "fold", "n", "auc"))


GRID = [1e-4, 1e-2, 1.0]
PICKED = (
    RECURSIVE + f""", x AS (SELECT model, {FOLDS['leaky']} % 3 AS fold, CASE WHEN coalesce(pred, 0) = gold THEN 1e0 ELSE 0e0 END AS hit, p, ln(size + 1e0) AS length FROM probe),
t AS (SELECT model, held, l2, hit, p, length FROM x JOIN (SELECT DISTINCT fold AS held FROM x) h ON fold <> held CROSS JOIN (SELECT unnest({GRID}::DOUBLE[]) AS l2))"""
    + newton_sql("t", ["model", "held", "l2"], ["p", "length"], "hit", "l2")
    + """, e AS (SELECT x.model, l2, hit, least(greatest(1 / (1 + exp(-(b0 + b1 * p + b2 * length))), 1e-12), 1 - 1e-12) AS q FROM x JOIN fitted f ON f.model = x.model AND f.held = x.fold),
l AS (SELECT model, l2, avg(-(hit * ln(q) + (1 - hit) * ln(1 - q))) AS bce FROM e GROUP BY 1, 2)
SELECT model, round(l2, 6) AS l2, round(bce, 6) AS bce FROM l QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(bce, 9), l2) = 1"""
)


@query("ml3_l2_grid", PICKED)
def l2_grid(s, d):
    """For each model the L2 weight that cross-validation picks, for its verdict's being right from scores and length."""
    rows = probe(s, d).withColumns({"right": (F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double"), "length": F.ln(F.col("size") + 1.0), "fold": F.expr(FOLDS["leaky"]) % 3})
    return fin(ml.l2_grid(rows.select("model", "fold", "right", "p", "length"), "model", ["p", "length"], "right", "fold", GRID))


@query("ml10_stacked", RECURSIVE + JUDGED + ", o AS (SELECT 1 AS one, * FROM w)" + newton_sql("o", ["one"], ["p1", "p2", "length"], "gold", "1e-3") + " SELECT unit_id, round(1 / (1 + exp(-(b0 + b1 * p1 + b2 * p2 + b3 * length))), 5) AS prob FROM o JOIN fitted USING (one)")
def stacked(s, d):
    """Every unit's probability by a fit on two scores and the length."""
    columns = ["p1", "p2", "length"]
    rows = _judged(s, d).withColumns({"one": F.lit(1), "l2": F.lit(1e-3)})
    fitted = ml.newton_logistic(rows, ["one"], columns, "gold", "l2")
    return fin(ml.predicted(rows, fitted, ["one"], columns).select("unit_id", "prob"), 5)


# ---- extension points -----------------------------------------------------------------------------------------------


@query("ux2_completion", "SELECT p_partkey, CASE WHEN length(p_name) % 2 = 1 THEN 'true' ELSE 'false' END AS answer, len(string_split(p_name, ' ')) AS n_in, 1 AS n_out FROM part")
def completion(s, d):
    def stub(prompts: list[str]):
        """A completion that needs no model."""
        return [("true" if len(p) % 2 else "false", len(p.split(" ")), 1, -0.5) for p in prompts]

    return fin(ex.completed(load(s, d, "part").select("p_partkey", "p_name"), "p_name", stub).select("p_partkey", "answer", "n_in", "n_out"))


query("ux3_keep_rule", "SELECT page_id FROM pages WHERE url LIKE '%1%'")(lambda s, d: ex.kept(load(s, d, "pages").select("page_id", "url"), lambda url: url.contains("1"), "url").select("page_id"))


@query("ux4_row_expand", "SELECT p_partkey, split_part(p_brand, '#', 1) AS maker, len(p_name) AS n_name, round(p_retailprice / (p_size + 1), 4) AS per_size FROM part")
def row_expand(s, d):
    row = lambda df: {"maker": F.split_part("p_brand", F.lit("#"), F.lit(1)), "n_name": F.length("p_name"), "per_size": F.col("p_retailprice") / (F.col("p_size") + 1)}
    return fin(ex.expanded(load(s, d, "part"), row).select("p_partkey", "maker", "n_name", "per_size"), 4)


@query("ux6_custom_metrics", CTE + "SELECT model, round(avg(CASE WHEN coalesce(pred, 0) = gold THEN 1e0 ELSE 0 END), 6) AS accuracy, round(avg(power(p - gold, 2)), 6) AS brier, round(corr(p, gold), 6) AS correlation, round(sum(seconds) / nullif(sum(CASE WHEN pred = 1 AND gold = 1 THEN 1 ELSE 0 END), 0), 6) AS seconds_a_hit FROM probe GROUP BY model")
def custom_metrics(s, d):
    hit = F.sum(((F.col("pred") == 1) & (F.col("gold") == 1)).cast("int"))
    return fin(ex.aggregated(probe(s, d), ["model"], {
        "accuracy": F.avg((F.coalesce("pred", F.lit(0)) == F.col("gold")).cast("double")), "brier": F.avg(F.pow(F.col("p") - F.col("gold"), 2)),
        "correlation": F.corr("p", "gold"), "seconds_a_hit": F.try_divide(F.sum("seconds"), hit),
    }))


#: A registry of named searches over parts.
SEARCHES = {
    "path": {"type": "cwe-query", "size": 22}, "command": {"type": "cwe-query", "size": 38}, "script": {"type": "cwe-query", "size": 49},
    "without-source": {"type": "ablation", "size": 22}, "plain": {"type": "codeql-query", "size": 7},
}


@query("ux11_registry", "SELECT name, size, count(p_partkey) AS n FROM (VALUES ('path', 22), ('command', 38), ('script', 49)) AS t(name, size) LEFT JOIN part ON p_size = size GROUP BY 1, 2")
def registry(s, d):
    named = ex.registered(s, SEARCHES, "cwe-query").select("name", F.col("params")["size"].cast("int").alias("size"))
    return fin(F.broadcast(named).join(load(s, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "size", "left").select("name", "size", F.coalesce("n", F.lit(0)).alias("n")))


# ---- SQL of sequential folds ----------------------------------------------------------------------------------------

ORACLES["jn20_consecutive_pairs"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT user_id, rn, event_id, event_type, false AS ends, CAST(NULL AS BIGINT) AS first FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, e.event_id, e.event_type, NOT r.ends AND r.event_type <> e.event_type, CASE WHEN NOT r.ends AND r.event_type <> e.event_type THEN r.event_id END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, first, event_id AS second FROM r WHERE ends"""

ORACLES["wn15_stop_early"] = CTE + """, x AS (SELECT a.grp, row_number() OVER (PARTITION BY a.grp ORDER BY a.p DESC, a.unit_id) AS rn, b.p AS second FROM probe a JOIN probe b ON a.unit_id = b.unit_id AND b.m = 3 WHERE a.m = 1),
y AS (SELECT x.grp, x.rn, count(e.rn) < 3 AS enters FROM x LEFT JOIN x e ON e.grp = x.grp AND e.rn < x.rn AND e.second >= x.second GROUP BY 1, 2),
b AS (SELECT grp, (rn - 1) // 5 AS batch, bool_or(enters) AS changed, max(rn) AS upto FROM y GROUP BY 1, 2),
z AS (SELECT *, NOT changed AND NOT lag(changed) OVER (PARTITION BY grp ORDER BY batch) AS stop FROM b)
SELECT grp, CAST(coalesce(min(upto) FILTER (stop), max(upto)) AS BIGINT) AS n_read FROM z GROUP BY grp"""

ORACLES["ro7_dual_ascent"] = RECURSIVE + """, w AS (SELECT grp, unit_id, list(CASE WHEN gold = 1 AND coalesce(pred, 0) = 0 THEN 5e0 WHEN gold = 0 AND pred = 1 THEN 1e0 ELSE 0e0 END ORDER BY m) AS l, list(seconds ORDER BY m) AS c FROM probe GROUP BY 1, 2),
u AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY unit_id) AS rn, (count(*) OVER (PARTITION BY grp) * 0.1e0) / count(*) OVER (PARTITION BY grp) AS pace FROM w),
r AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS rn, 1e-3 AS lam, 0e0 AS spent, 0e0 AS lost FROM u
UNION ALL SELECT grp, rn, greatest(0e0, lam + 0.05e0 * (spent + c[k] - pace * rn) / greatest(pace, 1e-9)), spent + c[k], lost + l[k]
FROM (SELECT grp, rn, lam, spent, lost, l, c, pace, list_position(v, list_min(v)) AS k FROM (SELECT u.grp, u.rn, r.lam, r.spent, r.lost, u.l, u.c, u.pace, [u.l[1] + r.lam * u.c[1], u.l[2] + r.lam * u.c[2], u.l[3] + r.lam * u.c[3], u.l[4] + r.lam * u.c[4]] AS v FROM r JOIN u ON u.grp = r.grp AND u.rn = r.rn + 1)))
SELECT grp, rn AS n, round(lam, 6) AS lam, round(spent, 6) AS spent, round(lost, 6) AS lost FROM r WHERE (grp, rn) IN (SELECT grp, max(rn) FROM u GROUP BY grp)"""
