"""Lists and ranks of projects of any size, and rows kept by a bitmap of wanted keys."""

import json

from pyspark.sql import functions as F

from tracewell.operators import project, ranges
from tracewell.operators.sizing import only_wanted
from tracewell.plans import report, requests


def test_ranks_of_a_project_that_holds_half_of_all_files(spark):
    scored = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 41).alias("project_id"),
        F.concat(F.lit("p"), "id").alias("path"), (F.col("id") % 7).alias("score"))
    chosen = spark.createDataFrame([(0, "p8", 1), (0, "extra", 2), (3, "p3", 1)], "project_id long, path string, ord int")
    frame = project.append_missing(chosen, scored.repartition(9))
    plan = frame._jdf.queryExecution().toString()
    assert "windowspecdefinition(project_id" in plan
    for line in plan.splitlines():
        assert "windowspecdefinition(project_id" not in line or "_range" in line, line
    got = {}
    for r in frame.collect():
        got.setdefault(r.project_id, {})[r.path] = r.ord
    rows = {}
    for r in scored.collect():
        rows.setdefault(r.project_id, {})[r.path] = r.score
    for p, known in rows.items():
        given = {0: ["p8", "extra"], 3: ["p3"]}.get(p, [])
        rest = sorted((path for path in known if path not in given), key=lambda x: (-known[x], x))
        assert got[p] == {path: i for i, path in enumerate([*given, *rest], 1)}


def test_pages_hold_whole_lists(spark):
    rows = [(k % 3, f"f{k:03d}", k % 5) for k in range(200)]
    frame = spark.createDataFrame(rows, "k int, name string, n int").repartition(6)
    pages = ranges.paged(frame, ["k"], [F.asc("name")], F.col("name"), 20).collect()
    for k in range(3):
        mine = sorted((r for r in pages if r.k == k), key=lambda r: r.ordinal)
        names = sorted(name for key, name, _ in rows if key == k)
        assert [r.name for r in mine] == names and [r.ordinal for r in mine] == list(range(1, len(names) + 1))
        assert [r.page for r in mine] == [4 * i // 20 for i in range(len(names))]


def test_long_lists_go_on_in_further_rows(spark):
    listing = spark.createDataFrame([(1, f"d/f{k:03d}.py", "py", 10 + k, "python") for k in range(60)]
                                    + [(2, "a.go", "go", 1, "golang")],
                                    "project_id long, path string, ext string, size_bytes long, language string")
    scored = listing.selectExpr("project_id", "path", "cast(size_bytes % 4 as int) as score")
    whole = {r.project_id: r.prompt for r in requests.selection_requests(listing, scored).collect()}
    cut = requests.selection_requests(listing, scored, page_bytes=500).collect()
    assert len(whole) == 2 and sum(r.project_id == 1 for r in cut) > 5

    def lists(prompt):
        tree, best = prompt.split("\n\nAlready Identified Files With Security Indicators:\n")
        return json.loads(tree.removeprefix("Project Structure:\n")), json.loads(best)

    joined = ([], [])
    for r in sorted((r for r in cut if r.project_id == 1), key=lambda r: r.page):
        for out, part in zip(joined, lists(r.prompt)):
            out += part
    assert joined == lists(whole[1]) and len(joined[0]) == len(joined[1]) == 60

    found = listing.selectExpr("project_id", "path as file", "'xss' as vulnerability_type", "'High' as severity")
    pages = report.affected_files(found, page_bytes=100).orderBy("page").collect()
    assert sum((r.affected_files for r in pages if r.project_id == 1), []) == [f"d/f{k:03d}.py" for k in range(60)]
    records = report.summary(found, listing, page_bytes=100).orderBy("project_id", "page").collect()
    assert sum((r.critical_files for r in records if r.project_id == 1), []) == [f"d/f{k:03d}.py" for k in range(60)]
    assert {(r.files_scanned, r.vulnerabilities_found, r.severity_breakdown.High) for r in records if r.project_id == 1} == {
        (60, 60, 60)}


def test_bitmap_keeps_what_is_wanted(spark):
    frame = spark.range(50_000).selectExpr("id % 10 as project_id", "concat('name', id) as name", "id")
    wanted = spark.createDataFrame([(i % 10, f"name{i}") for i in range(0, 3000, 7)], "project_id int, name string")
    kept = {r.id for r in only_wanted(frame, wanted, ["project_id", "name"]).collect()}
    exact = set(range(0, 3000, 7))
    assert exact <= kept and len(kept - exact) < 20
    crowded = {r.id for r in only_wanted(frame, wanted, ["project_id", "name"], bits=64).collect()}
    assert exact <= crowded
    assert only_wanted(frame, wanted.limit(0), ["project_id", "name"]).count() == 0


def test_calls_of_undefined_names_are_dropped_where_they_are_read(spark, files_of):
    files = files_of({"a.py": "def here():\n    there()\n    unknown()\n    other(there())", "b.py": "def there():\n    here()"})
    calls = project.call_names(files)
    kept = only_wanted(calls, project.last_definitions(files), ["project_id", "name"])
    assert {r.name for r in kept.collect()} == {"here", "there"} and calls.where("name = 'unknown'").count() == 1
    found = {(r.caller_file, r.caller_line, r.called_entity) for r in project.cross_file_calls(files).collect()}
    assert found == {("a.py", 2, "there"), ("a.py", 4, "there"), ("b.py", 2, "here")}
