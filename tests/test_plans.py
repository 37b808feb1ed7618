import csv
import glob
import json

from pyspark.sql import functions as F

from tracewell.plans import report
from tracewell.plans import responses as rs
from tracewell.streaming import state

FINDING = ("project_id int, file string, line int, vulnerability_type string, description string, "
           "severity string, confidence double, code_snippet string, cwe_id string, "
           "data_flow array<string>, remediation string")


def findings(spark, rows):
    return spark.createDataFrame(
        [(1, f, n, t, "d", s, c, "x", None, ["a"], None) for f, n, t, s, c in rows], FINDING)


def parsed(spark, *texts):
    frame = spark.createDataFrame([(1, f"f{i}", t) for i, t in enumerate(texts)],
                                  "project_id int, path string, response string")
    out = {}
    for r in rs.parse_findings(frame).orderBy("file", "finding_ord").collect():
        out.setdefault(r.file, []).append(r)
    return [out.get(f"f{i}", []) for i in range(len(texts))]


def test_response_ladder(spark):
    clean, obj, block, empty, text, blank, scalar, quoted, tail, cut, none = parsed(
        spark, '[{"vulnerability_type":"xss"}]', '{"line": 1}',
        'Found [ {"line": 3, "vulnerability_type": "csrf"} ] end', "none: [ ]",
        "Vulnerability 1: a\nLine 12 is SQL Injection\nIssue 2: Line x Line 7 .. XSS", "  ",
        '[1, "s", {"line": 4}]', '[{"confidence": "0.9", "line": "5"}]',
        '[{"line": 9}] trailing', '[{"line": 9', "hello")
    assert (clean[0].parse_path, clean[0].line, clean[0].severity, clean[0].confidence,
            clean[0].cwe_id) == ("clean", 0, "Medium", 0.5, "CWE-79")
    assert obj == empty == blank == cut == none == []
    assert (block[0].parse_path, block[0].line, block[0].severity, block[0].cwe_id) == (
        "block", 3, None, None)
    assert [(r.line, r.vulnerability_type, r.cwe_id, r.confidence) for r in text] == [
        (12, "SQL Injection", "CWE-89", 0.5), (7, "XSS", "CWE-79", 0.5)]
    assert [r.line for r in scalar] == [4]
    assert (quoted[0].confidence, quoted[0].line) == (0.9, 5)
    assert tail[0].parse_path == "block"


def test_cross_pattern_and_list_responses(spark):
    cross = spark.createDataFrame([(1, '[{"files_involved":["a","b"],"vulnerability_type":"xss"}]'),
                                   (2, "no json"), (3, '{"a":1}')], "project_id int, response string")
    rows = rs.parse_cross_findings(cross).collect()
    assert [(r.project_id, r.file, r.line, r.cwe_id, r.code_snippet) for r in rows] == [
        (1, "a", 0, "CWE-79", "Cross-file vulnerability between files:\n- a\n- b\n")]
    pattern = spark.createDataFrame([(1, 0, 'x {"custom_functions":{"f":{"potential_security_impact":"i"}},'
                                            '"security_patterns":{"sanitization":["g"]}} y'), (1, 1, "bad")],
                                    "project_id int, file_ord int, response string")
    assert {(r.kind, r.category, r.name, r.impact) for r in rs.parse_patterns(pattern).collect()} == {
        ("custom_function", None, "f", "i"), ("security_pattern", "sanitization", "g", None)}
    chosen = spark.createDataFrame([(1, '["b.py","a.py"]'), (2, '{"a":1}'), (3, 'x ["a"]')],
                                   "project_id int, response string")
    assert [(r.project_id, r.path, r.ord) for r in rs.parse_selection(chosen).orderBy("ord").collect()] == [
        (1, "b.py", 1), (1, "a.py", 2)]


def test_risk_score(spark):
    scanned = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "project_id int, path string")
    found = findings(spark, [("a", 1, "xss", "Critical", 0.9)]).unionByName(
        findings(spark, [("b", 1, "xss", "odd", 0.9), ("b", 2, "xss", None, 0.9)])
        .withColumn("project_id", F.lit(2)))
    got = {r.project_id: r for r in report.with_risk_score(report.totals(found, scanned)).collect()}
    assert got[1].risk_score == 100  # 10 / 1 * 25 + 75
    assert got[2].risk_score == int(2 / 2 * 25 + 1 / 2 * 75) and got[2].severity_weight == 2
    none = report.with_risk_score(report.totals(found.where("false"), scanned)).collect()
    assert [r.risk_score for r in none] == [0, 0]
    summary = {r.project_id: r for r in report.summary(found, scanned).collect()}
    assert summary[1].severity_breakdown.Critical == 1 and summary[2].severity_breakdown.Low == 0
    assert summary[2].critical_files == ["b", "c"] and summary[1].vulnerability_types == ["xss"]


def test_filters_and_tiers(spark):
    found = findings(spark, [("p/a.py", i, "xss", "High", 0.8) for i in range(6)] + [
        ("p/b.py", 1, None, None, None), ("", 1, "x", "Low", 0.2), (None, 1, "x", "Low", 0.7)])
    assert report.confident(found).count() == 7
    assert report.report_filter(found, confidence="medium").count() == 2
    assert report.report_filter(found, severity="Medium", file="b.py").count() == 1
    assert {r.vulnerability_type for r in report.by_type(found).collect()} == {"xss", "Unknown", "x"}
    files = spark.createDataFrame([(1, "p/a.py"), (1, "p/b.py"), (1, "b.py")],
                                  "project_id int, path string")
    assert {r.path: (r.findings, r.tier) for r in report.file_tiers(files, found).collect()} == {
        "p/a.py": (6, "danger"), "p/b.py": (1, "info"), "b.py": (0, "")}
    assert {r.file for r in report.files_with_findings(found).collect()} == {"a.py", "b.py"}


def test_csv_and_json_sinks(spark, tmp_path):
    tricky = findings(spark, [('a "q", b', 1, "x\ny", "Low", 0.5), (None, 2, "t", None, None)])
    report.write_csv(tricky.coalesce(1), str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv/*.csv"))[0], newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["File", "Line", "Vulnerability Type", "Severity", "Confidence",
                       "Description", "CWE", "Code Snippet", "Remediation"]
    assert rows[1] == ['a "q", b', "1", "x\ny", "Low", "0.5", "d", "", "x", ""]
    assert rows[2] == ["", "2", "t", "", "", "d", "", "x", ""]
    report.write_json(tricky, str(tmp_path / "json"))
    lines = [json.loads(x) for p in glob.glob(str(tmp_path / "json/project_id=1/*.json"))
             for x in open(p)]
    assert sorted(x["line"] for x in lines) == [1, 2]
    scanned = spark.createDataFrame([(1, "a")], "project_id int, path string")
    report.write_report_tables(tricky, scanned, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/by_type")).count() == 2


def test_incremental_scan_equals_full_scan(spark, files_of, tmp_path):
    def at(texts, times):
        stamp = F.create_map(*[F.lit(x) for item in times.items() for x in item])
        return files_of(texts).withColumn("mtime", stamp[F.col("path")])

    store = state.ScanState(spark, str(tmp_path / "state"))
    assert store.read("file_scans").count() == 0
    first = at({"a.py": "1", "b.py": "2", "c.py": "3"}, {"a.py": 1.0, "b.py": 1.0, "c.py": 1.0})
    found = findings(spark, [("a.py", 1, "xss", "High", 0.9)])
    store.save_file_results(first, found, 10.0, "r1")
    second = at({"a.py": "1", "b.py": "2!", "c.py": "3", "d.py": "4"},
                {"a.py": 1.0, "b.py": 1.0, "c.py": 2.0, "d.py": 1.0})
    scans = store.read("file_scans")
    todo = {r.path for r in state.to_scan(second, scans, "r1").collect()}
    kept = {r.path: json.loads(r.vulnerabilities) for r in state.reused(second, scans, "r1").collect()}
    assert todo == {"b.py", "c.py", "d.py"} and set(kept) == {"a.py"}
    assert kept["a.py"][0]["vulnerability_type"] == "xss"
    assert state.to_scan(second, scans, "r2").count() == 4  # other rules, nothing to reuse
    store.save_file_results(second.where("path <> 'a.py'"), found.where("false"), 20.0, "r1")
    assert state.to_scan(second, store.read("file_scans"), "r1").count() == 0
    other = second.withColumn("project_id", F.lit(2).cast("bigint")).withColumn("mtime", F.lit(9.0))
    store.save_file_results(other, found.where("false"), 30.0, "r1")  # same paths and texts, other project
    both = second.unionByName(other)
    assert state.to_scan(both, store.read("file_scans"), "r1").count() == 0
    assert "content" not in state.to_scan(both, scans, "r1").columns
    store.put("k", '"v1"', 1.0)
    store.put("k", '"v2"', 2.0)
    assert [r.value for r in store.get("k").collect()] == ['"v2"']
    compact = store.compact(str(tmp_path / "next"))
    assert {r.table: r.rows for r in compact.stats().collect()} == {
        "file_scans": 9, "project_scans": 0, "metadata": 1}
    store.clear()
    assert {r.rows for r in store.stats().collect()} == {0}


def test_selection_cache(spark, files_of, tmp_path):
    files = files_of({"a.py": "1", "b.py": "22"}).withColumn(
        "size_bytes", F.octet_length("content").cast("bigint"))
    hashes = state.structure_hash(files).withColumn("project_id", F.col("project_id").cast("string"))
    changed = state.structure_hash(files.withColumn("size_bytes", F.col("size_bytes") + 1))
    assert hashes.first().structure_hash != changed.first().structure_hash
    store = state.ScanState(spark, str(tmp_path / "s"))
    chosen = spark.createDataFrame([("1", "b.py", 1), ("1", "a.py", 2)],
                                   "project_id string, path string, ord int")
    store.save_selection(chosen, hashes, 1.0, "r1")
    saved = store.read("project_scans")
    assert state.cached_selection(hashes, saved, "r1").first().critical_files == ["b.py", "a.py"]
    assert state.cached_selection(hashes, saved, "r2").count() == 0


def test_findings_of_unscanned_projects_count(spark):
    found = findings(spark, [("a.py", 1, "xss", "High", 0.9)])
    none = spark.createDataFrame([], "project_id int, path string")
    row = report.summary(found, none).first()
    assert (row.files_scanned, row.vulnerabilities_found, row.critical_files) == (0, 1, [])
    assert report.totals(found.where("false"), none).count() == 0
