"""Readers and sinks on small files."""

import json

from pyspark.sql import functions as F

from tributary.sources import readers as rd


def test_json_lines_with_a_torn_end(spark, tmp_path):
    (tmp_path / "granite__owasp.jsonl").write_text('{"unit_id": "a", "p": 0.5}\n\n{"unit_id": "b"}\n{"unit_')
    df = rd.keyed_by_name(rd.json_lines(spark, str(tmp_path), "unit_id string, p double"))
    got = {(r.unit_id, r.p, r.model) for r in df.collect() if r.unit_id}
    assert got == {("a", 0.5, "granite"), ("b", None, "granite")}


def test_json_array_or_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}\n')
    assert [r.x for r in rd.json_any(spark, str(tmp_path / "a.json"), "x int").orderBy("x").collect()] == [1, 2]
    assert [r.x for r in rd.json_any(spark, str(tmp_path / "b.json"), "x int").collect()] == [3]


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nid;n\n1;2.5\n2;N/A\n3;\n")
    df = rd.csv(spark, str(tmp_path / "a.csv"), ";", "#", keep_empty=True)
    assert [(r.id, r.n, r.v) for r in df.withColumn("v", rd.number("n")).orderBy("id").collect()] == [("1", "2.5", 2.5), ("2", "N/A", 0.0), ("3", "", 0.0)]


def step(uri, line, message, end=None):
    region = {"startLine": line} | ({"endLine": end} if end else {})
    return {"location": {"message": {"text": message}, "physicalLocation": {"artifactLocation": {"uri": uri}, "region": region}}}


def test_report_steps(spark, tmp_path):
    flow = {"threadFlows": [{"locations": [step("A.java", 3, "x : String"), step("B.java", 9, "y", 11)]}]}
    doc = {"runs": [{"results": [{"ruleId": "r1", "message": {"text": "m"}, "codeFlows": [flow, flow]}, {"ruleId": "r2", "message": {"text": "n"}}]}]}
    (tmp_path / "r.sarif").write_text(json.dumps(doc))
    rows = rd.report_steps(spark, str(tmp_path / "r.sarif")).orderBy("result_id", "flow_id", "step").collect()
    assert [(r.flow_id, r.step, r.file, r.line, r.end_line) for r in rows] == [(0, 0, "A.java", 3, 3), (0, 1, "B.java", 9, 11), (1, 0, "A.java", 3, 3), (1, 1, "B.java", 9, 11)]
    assert rd.report_steps(spark, str(tmp_path / "r.sarif"), True, True).count() == 2


def test_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<Cat><Weakness ID="79"><Name>XSS</Name></Weakness><Weakness ID="89"><Name>SQLi</Name></Weakness></Cat>')
    got = rd.xml_rows(spark, str(tmp_path / "c.xml"), "Weakness", "_ID string, Name string").collect()
    assert {(r._ID, r.Name) for r in got} == {("79", "XSS"), ("89", "SQLi")}


def test_log_pairs(spark, tmp_path):
    (tmp_path / "run.log").write_text("{'TPs': 9}\nCase_01.java\nnoise\n{'TPs': 1}\nCase_02.java\nCase_03.java\n{'TPs': 2}\n")
    lines = rd.numbered_lines(spark, str(tmp_path / "run.log"))
    got = rd.paired(lines, r"^(\S+)\.java", r"'TPs': (\d+)").orderBy("line").collect()
    assert [(r.key, r.found) for r in got] == [("Case_01", "1"), ("Case_03", "2")]


def test_sharded_pairs_drop_ambiguous(spark):
    rows = [("f", 1, "s0", "A.java"), ("f", 2, "s0", "{1}"), ("f", 3, "s0", "B.java"), ("f", 4, "s1", "C.java"), ("f", 5, "s1", "{2}"), ("f", 6, "s0", "{3}")]
    df = spark.createDataFrame(rows, "path string, line long, shard string, value string")
    assert [(r.key, r.found) for r in rd.sharded_pairs(df, r"(\w+)\.java", r"\{(\d)\}").collect()] == [("A", "1")]


def test_sharded_pairs_equal_a_walk(spark):
    import random

    r = random.Random(2)
    rows = [(f, k, r.choice(["s0", "s1", None]), r.choice(["A.java", "B.java", "C.java {9}", "{1}", "{2}", "other", None])) for f in "fgh" for k in range(r.randint(0, 80))]
    want = set()
    for f in "fgh":
        pending = {}
        for _, k, shard, value in sorted((x for x in rows if x[0] == f), key=lambda x: x[1]):
            if value and ".java" in value:
                pending[shard] = value[0]
            elif value and "{" in value:
                if len(pending) == 1:
                    want.add((f, k, next(iter(pending.values())), value[1]))
                pending.clear()
    df = spark.createDataFrame(rows, "path string, line long, shard string, value string").repartition(3)
    assert {tuple(x) for x in rd.sharded_pairs(df, r"(\w+)\.java", r"\{(\d)\}").collect()} == want


def test_stems(spark):
    df = spark.createDataFrame([("/x/X_51a.java",), ("/x/X_51b.java",), ("/x/X_01.java",), ("/x/AbstractTestCase.java",)], "path string")
    assert {r.stem: len(r.paths) for r in rd.stems(df).collect()} == {"X_51": 2, "X_01": 1, "AbstractTestCase": 1}


def test_markers_and_markdown(spark):
    df = spark.createDataFrame([("ab[x]cd[x][y]", 1.5)], "t string, v double")
    assert tuple(df.select(*rd.markers("t", ["[x]", "[y]"])).first()) == (2, 1)
    assert "| 1.500 |" in rd.markdown(df)
    long = rd.markdown(spark.range(1500)).splitlines()
    assert len(long) == 1003 and long[-1] == "| … |" and len(rd.markdown(spark.range(1000)).splitlines()) == 1002


def test_append_new_resumes(spark, tmp_path):
    out = str(tmp_path / "out")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    b = spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int")
    rd.append_new(a, out, "id")
    assert {tuple(r) for r in rd.append_new(b, out, "id").select("id", "n").collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    assert rd.whole_files(spark, str(tmp_path)).select(F.length("text")).first()[0] == 3
