from pyspark.sql import functions as F

from tracewell.operators import dataflow, facts, project
from tracewell.plans import requests
from tracewell.rules import project as custom


def named(files):
    return files.withColumn("name", F.substring_index("path", "/", -1)) \
        .withColumn("ext", F.substring_index("path", ".", -1)) \
        .withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def test_metadata_and_score(files_of):
    files = named(files_of({
        "auth/login.py": "import os\nfrom flask import request\n@app.route('/a')\ndef login_user(x): pass",
        "b.js": "const fs = require('fs'); app.get('/x', f); function runQuery (a) {}",
        "plain.txt": "nothing"}))
    meta = {r.path: r for r in project.file_metadata(files).collect()}
    assert meta["auth/login.py"].imports == ["flask", "os", "request"]
    assert meta["auth/login.py"].endpoints == ["/a"]
    assert meta["auth/login.py"].critical_functions == ["def login_user("]
    assert meta["b.js"].critical_functions == ["function runQuery ("]
    assert meta["plain.txt"].imports is None
    scores = {r.path: r for r in project.file_scores(project.file_metadata(files)).collect()}
    assert scores["auth/login.py"].score == 2 + 3 + 3 + 5
    assert scores["auth/login.py"].reasons == [
        "Imports: request", "Has 1 API endpoints", "Has 1 security-critical functions",
        "Security-relevant filename: login.py"]
    assert "plain.txt" not in scores


def test_fallback_score_counts_auth_twice(files_of):
    files = named(files_of({"src/auth.go": "", "api/main.go": ""}))
    got = {r.path: r.score for r in project.fallback_scores(files).collect()}
    assert got == {"src/auth.go": 5 + 5 + 5, "api/main.go": 20 + 5}


def test_top_files_gate(spark):
    rows = [(1, f"f{i:02}", i % 7 + 1) for i in range(40)] + [(2, f"g{i}", 3) for i in range(14)]
    scores = spark.createDataFrame(rows, "project_id int, path string, score int")
    top = project.top_files(scores).orderBy("rank").collect()
    assert {r.project_id for r in top} == {1} and len(top) == 30
    want = sorted([(r[2], r[1]) for r in rows if r[0] == 1], key=lambda x: (-x[0], x[1]))[:30]
    assert [(r.score, r.path) for r in top] == want


def test_append_missing(spark):
    chosen = spark.createDataFrame([(1, "z", 1), (1, "a", 2)], "project_id int, path string, ord int")
    scored = spark.createDataFrame([(1, "a", 9), (1, "b", 1), (1, "c", 5)],
                                   "project_id int, path string, score int")
    got = project.append_missing(chosen, scored).orderBy("ord").collect()
    assert [r.path for r in got] == ["z", "a", "c", "b"]


def test_cross_file_calls_use_the_last_definition(files_of):
    files = files_of({"a.py": "def helper(x):\n    pass", "b.py": "\ndef helper(y):\n    pass",
                      "c.py": "q = 1\nhelper(1) + helper (2)\nmyhelper(3)"})
    calls = project.cross_file_calls(files)
    got = {(r.caller_file, r.caller_line, r.called_entity, r.called_file, r.called_line)
           for r in calls.collect()}
    assert got == {("c.py", 2, "helper", "b.py", 2), ("a.py", 1, "helper", "b.py", 2)}
    snip = {r.caller_file: r for r in project.cross_call_snippets(
        files, project.first_cross_calls(calls)).collect()}
    assert snip["c.py"].caller_code == "q = 1\nhelper(1) + helper (2)\nmyhelper(3)"
    assert snip["c.py"].called_code == "\ndef helper(y):\n    pass"


def test_context_and_entry_points(files_of):
    files = files_of({"src/test_a.py": "main()\nrunserver", "lib/x.js": "r.post('/p')",
                      "plain.go": "jwt"})
    rows = {r.path: r for r in project.with_context(files).collect()}
    assert rows["src/test_a.py"].purpose == "Test" and rows["src/test_a.py"].entry_point
    assert rows["lib/x.js"].endpoints == ["/p"]
    assert rows["plain.go"].purpose == "Security-Related" and not rows["plain.go"].entry_point
    assert sorted(r.kind for r in project.entry_points(files).collect()) == ["main", "server"]
    java = files_of({"A.java": "public static void main (String[] a) {}", "B.java": "int mainly;"})
    assert [r.path for r in project.entry_points(java).collect()] == ["A.java"]


def test_whole_texts_unless_a_head_is_asked_for(files_of):
    late = "x = 1\n" * 4_000 + "import jwt\n"
    files = files_of({"late.py": late}).withColumn("name", F.lit("late.py"))
    assert project.file_metadata(files).first().imports == ["jwt"]
    assert project.file_metadata(files, 10_240).first().imports is None
    assert late in requests.file_requests(files).first().prompt


def test_last_place_in_the_last_file_wins(spark):
    rows = [(1, "custom_function", None, "f", f"impact {k}", k // 3, k % 3) for k in (5, 0, 3, 4)]
    patterns = spark.createDataFrame(rows, "project_id bigint, kind string, category string, name string, "
                                           "impact string, file_ord int, pattern_ord int")
    assert [r.impact for r in custom.merge_samples(patterns).collect()] == ["impact 5"]
    assert [r.impact for r in custom.merge_samples(patterns, 1).collect()] == ["impact 0"]


def test_request_text(files_of):
    files = files_of({"x.py": "aa = input()\nos.system(aa)"})
    prompt = requests.file_requests(files, instructions="END").first().prompt
    assert prompt.startswith("File: x.py\nLanguage: python\n")
    assert "1. user_input at line 1 flows to command_injection at line 2\n   Source: aa = input()" in prompt
    assert "   Sanitized: False\n" in prompt and prompt.endswith("os.system(aa)\n```\nEND")


def test_request_holds_all_flows_unless_first_ones_are_asked_for(files_of):
    names = [letter * 2 for letter in "abcdefghijklm"]
    files = files_of({"x.py": "".join(f"{n} = input()\nos.system({n})\n" for n in names)})
    prompt = requests.file_requests(files).first().prompt
    assert all(f"Source: {n} = input()" in prompt for n in names) and "13. user_input" in prompt
    assert "11. user_input" not in requests.file_requests(files, flows=10).first().prompt


def test_request_names_project_patterns(spark, files_of):
    extra = spark.createDataFrame(
        [(1, "wrapper_function", None, "wrapIt", None, 0), (1, "security_pattern", "encryption", "enc", None, 1),
         (1, "validation_function", None, "okay", None, 0)],
        "project_id bigint, kind string, category string, name string, impact string, file_ord int") \
        .withColumn("pattern_ord", F.lit(0))
    prompt = requests.file_requests(files_of({"x.py": "a = 1"}), patterns=extra).first().prompt
    assert ("- Custom security functions: enc\n- Data transformation functions: \n"
            "- Validation functions: okay\n- Wrapper functions: wrapIt\n") in prompt


def test_result_does_not_depend_on_partitions(files_of):
    texts = {f"f{i}.py": f"aa{i} = input()\nbb = aa{i}\nos.system(bb)" for i in range(12)}
    files = files_of(texts)
    one = dataflow.table(files.coalesce(1), "flows").select("path", "variable", "source_line")
    many = dataflow.table(files.repartition(7), "flows").select("path", "variable", "source_line")
    assert sorted(one.collect()) == sorted(many.collect())
    assert facts.lines(files).count() == 36


def test_no_shuffle_inside_a_file(files_of):
    plan = dataflow.table(files_of({"x.py": "a = 1"}), "flows") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_top_k_is_trimmed_before_its_shuffle(spark):
    scores = spark.range(100).selectExpr("id % 3 as project_id", "cast(id as string) as path",
                                         "id as score")
    plan = project.fallback_files(scores)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
