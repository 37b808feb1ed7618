from pyspark.sql import functions as F

from tests.test_project import named
from tracewell.plans import responses, scan
from tracewell.streaming.state import ScanState


def test_selection_takes_the_right_branch_per_project(spark, files_of):
    many = named(files_of({f"s/login{i}.py": "import os" for i in range(16)}, 1))
    few = named(files_of({"auth.py": "x", "b.py": "y"}, 2))
    asked = named(files_of({"login.py": "x", "other.py": "y", "more.py": "z"}, 3))
    plain = named(files_of({"a.py": "x", "main.py": "y"}, 4))
    files = many.unionByName(few).unionByName(asked).unionByName(plain)
    answers = spark.createDataFrame([(3, '["other.py"]'), (1, '["never.py"]')],
                                    "project_id bigint, response string")
    got = {}
    for r in scan.select_files(files, answers).orderBy("project_id", "ord").collect():
        got.setdefault(r.project_id, []).append(r.path)
    assert len(got[1]) == 16 and "never.py" not in got[1]
    assert got[2] == ["auth.py"]
    assert got[3] == ["other.py", "login.py"]
    assert got[4] == ["main.py", "a.py"]


def test_scan_from_files_to_summary(spark, files_of):
    files = named(files_of({
        "login.py": "aa = input()\nhelper(aa)", "auth_db.py": "def helper(q):\n    os.system(q)"}))
    roots = spark.createDataFrame([(1, "requirements.txt", "flask")],
                                  "project_id bigint, name string, content string")
    ready = scan.prepare(files, roots)
    assert {r.path for r in ready.selected.collect()} == {"login.py", "auth_db.py"}
    prompts = {r.path: r.prompt for r in ready.file_requests.collect()}
    assert "- Framework: flask\n" in prompts["login.py"]
    assert [(r.caller_file, r.called_file) for r in ready.cross_calls.collect()] == [
        ("login.py", "auth_db.py")]
    assert ready.pattern_requests.count() == 2
    everything = scan.prepare(files, roots, scan_all=False, pattern_files=5)
    assert everything.pattern_requests.count() == 2 and everything.files.count() == 2
    answers = ready.files.select("project_id", "path", F.lit(
        '[{"line": 2, "vulnerability_type": "Command Injection", "severity": "Critical", '
        '"confidence": 0.9}, {"vulnerability_type": "xss", "confidence": 0.1}]').alias("response"))
    cross = spark.createDataFrame(
        [(1, '[{"files_involved": ["login.py"], "vulnerability_type": "xss", "severity": "Low", '
             '"confidence": 0.8}]')], "project_id bigint, response string")
    advice = spark.createDataFrame(
        [(1, '[{"vulnerability_type": "xss", "affected_files": ["no.py"]}]')],
        "project_id bigint, response string")
    done = scan.finish(ready.selected, answers, cross, advice)
    row = done.summary.first()
    assert (row.vulnerabilities_found, row.files_scanned, row.unique_vulnerability_types) == (3, 2, 2)
    assert row.risk_score == 100 and row.severity_breakdown.Critical == 2
    assert [r.affected_files for r in done.recommendations.collect()] == [["login.py"]]


def test_scan_with_saved_results_equals_full_scan(spark, files_of, tmp_path):
    roots = spark.createDataFrame([(1, "requirements.txt", "flask")], "project_id bigint, name string, content string")

    def answered(files):
        """What a model would say: one finding per line that mentions a secret."""
        one = F.to_json(F.struct(F.length("content").alias("line"), F.lit("xss").alias("vulnerability_type"),
                                 F.col("path").alias("description"), F.lit(0.9).alias("confidence")))
        return files.select("project_id", "path", F.concat(F.lit("["), F.when(
            F.contains("content", F.lit("secret")), one).otherwise(""), F.lit("]")).alias("response"))

    def results(done):
        return sorted(map(str, done.findings.collect())), done.summary.drop("scan_date").collect()

    def at(texts):
        return named(files_of(texts)).withColumn("mtime", F.lit(1.0))

    store = ScanState(spark, str(tmp_path / "state"))
    first = at({"a.py": "secret 1", "b.py": "none", "c.py": "secret 33"})
    ready = scan.prepare(first, roots, state=store, rules_version="r1")
    assert ready.file_requests.count() == 3 and ready.saved.count() == 0
    found = responses.parse_findings(answered(ready.files)).drop("parse_path", "finding_ord")
    scan.save(store, ready.files, found, 1.0, "r1")
    second = at({"a.py": "secret 1", "b.py": "secret now", "c.py": "secret 33", "d.py": "secret 4444"})
    ready = scan.prepare(second, roots, state=store, rules_version="r1")
    assert {r.path for r in ready.file_requests.collect()} == {"b.py", "d.py"}
    assert {r.file for r in ready.saved.collect()} == {"a.py", "c.py"}
    whole = scan.prepare(second, roots)
    again = scan.finish(ready.selected, answered(ready.files), saved=ready.saved)
    assert results(again) == results(scan.finish(whole.selected, answered(whole.files)))
    assert len(results(again)[0]) == 4
    assert scan.prepare(second, roots, state=store, rules_version="r2").file_requests.count() == 4


def test_a_save_touches_only_the_buckets_of_its_keys(spark, tmp_path):
    import glob
    store = ScanState(spark, str(tmp_path / "state"))
    schema = "key string, value string, last_updated double"
    store.save("metadata", spark.createDataFrame([(f"k{i}", f"v{i}", 1.0) for i in range(600)], schema))
    files = {p: open(p, "rb").read() for p in glob.glob(str(tmp_path / "state/metadata/data/*/*/*.parquet"))}
    store.save("metadata", spark.createDataFrame([("k7", "new", 2.0), ("k8", "old", 0.5), ("z", "z", 1.0)], schema))
    assert {p: open(p, "rb").read() for p in files} == files
    new = set(glob.glob(str(tmp_path / "state/metadata/data/*/bucket=*"))) - {p.rsplit("/", 1)[0] for p in files}
    assert 1 <= len(new) <= 3
    got = {r.key: r.value for r in store.read("metadata").collect()}
    assert got == {f"k{i}": f"v{i}" for i in range(600)} | {"k7": "new", "z": "z"}
    (tmp_path / "state/metadata/data/interrupted/bucket=1").mkdir(parents=True)      # a save that did not end
    assert store.read("metadata").count() == 601
    store.clear()
    assert store.read("metadata").count() == 0
    store.put("k7", "back", 3.0)
    assert [(r.key, r.value) for r in store.read("metadata").collect()] == [("k7", "back")]
