"""Data flow as tables against the array expressions on a file row, and the joins it is made of."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import dataflow, facts, flow_tables, mentions, ranges

LINES = {
    "py": ["{a} = request.args.get('q')", "{a} = {c}.strip()", "{a} = html.escape({c})", "os.system({a})",
           "if ({a} == None):", "def {f}({a}):", "{a} = {f}({c})", "{a} = {c}", "validate({a})", "# {a}", "{a} += {c}"],
    "js": ["let {a} = req.query.q;", "let {a} = {c}.trim();", "let {a} = escapeHTML({c});", "execSync({a});",
           "if ({a} === null) return;", "function {f}({a}) {{", "{a} = {f}({c});", "{a} = {c};", "el.innerHTML = {a};"],
    "java": ["String {a} = request.getParameter(\"q\");", "String {a} = {c};", "stmt.executeQuery(\"S\" + {a});",
             "if ({a} == null) return;", "public static String {f}(String {a}) {{", "String {a} = {f}({c});",
             "String {a} = escapeHtml({c});", "out.print({a});"],
    "go": ["{a} = req.body;", "{a} = {c};", "{a} = escapeHtml({c});", "executeQuery({a});", "if ({a} == nil);",
           "func {f}({a}) {{", "{a} = {f}({c});"]}


def file_text(rng, kind, n, names):
    line = lambda: rng.choice(LINES[kind]).format(a=rng.choice(names), c=rng.choice(names), f=f"fn{rng.randint(0, 5)}")
    return "\n".join(line() for _ in range(n))


@pytest.fixture(scope="module")
def files(files_of):
    rng = random.Random(3)
    names = [f"v{i}" for i in range(12)] + ["obj", "val"]
    return files_of({f"f{n}.{kind}": file_text(rng, kind, rng.randint(1, 60), names)
                     for n in range(5) for kind in LINES} | {"empty.py": ""}).repartition(4).cache()


def plain(frame, columns):
    def value(x):
        return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(value(r[c]) for c in columns) for r in frame.select(*columns).collect()), key=repr)


def equal(got, expected, *skip):
    columns = [c for c in expected.columns if c not in skip]
    a, b = plain(got, columns), plain(expected, columns)
    assert a == b and b


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for function in (ranges.numbered, ranges.nearest_before, ranges.between):
        monkeypatch.setattr(function, "__defaults__", (*function.__defaults__[:-1], 4))
    monkeypatch.setattr(mentions.mentions, "__defaults__", (*mentions.mentions.__defaults__[:-1], 16))


@pytest.mark.parametrize("options", [{}, {"word": True}, {"chain_calls": True}, {"max_hops": 2}])
def test_taints_and_flows_equal_arrays(files, options):
    tables = flow_tables.FlowTables(files, **options)
    equal(tables.taints, dataflow.table(files, "taints", "taint_ord", **options))
    equal(tables.flows(), dataflow.table(files, "flows", **options))


def test_project_rules(files, spark):
    patterns = spark.createDataFrame(
        [(1, "data_transformation", None, "strip", None, 0, 0), (1, "data_transformation", None, "fn1", None, 0, 1),
         (1, "wrapper_function", None, "fn2", None, 0, 2), (1, "validation_function", None, "fn3", None, 0, 3)],
        "project_id long, kind string, category string, name string, impact string, file_ord int, pattern_ord long")
    tables = flow_tables.FlowTables(files, patterns)
    equal(tables.taints, dataflow.table(files, "taints", "taint_ord", patterns=patterns))
    equal(tables.flows(), dataflow.table(files, "flows", patterns=patterns))


def test_other_tables_equal_arrays(files):
    tables = flow_tables.FlowTables(files)
    equal(tables.variables, facts.variables(files), "later_assigns")
    equal(tables.sources, dataflow.table(files, "sources"))
    equal(tables.references(), facts.references(files))
    equal(tables.call_edges(), dataflow.table(files, "call_edges"))
    equal(tables.validations(), dataflow.table(files, "validation_attempts"))


def test_short_and_long_files_together(files):
    lengths = [r.n for r in files.select(flow_tables.n_lines().alias("n")).collect()]
    assert min(lengths) < 30 <= max(lengths)
    for result in ("taints", "call_edges"):
        equal(flow_tables.table(files, result, lines=30), dataflow.table(files, result))


def test_empty_table(files):
    tables = flow_tables.FlowTables(files.limit(0))
    for frame in (tables.flows(), tables.references(), tables.call_edges(), tables.validations()):
        assert frame.count() == 0


def test_ranges_against_loops(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 40)) for k in "ab" for i in range(60)]
    others = [(rng.choice("ab"), n, rng.randint(0, 40)) for n in range(50)]
    left = spark.createDataFrame(rows, "k string, i int, line_no int").withColumn("high", F.col("line_no") + F.col("i") % 17)
    right = spark.createDataFrame(others, "k string, n int, line_no int")
    near = ranges.nearest_before(left, right, ["k"], F.col("n"), ["n"], "_v").collect()
    for r in near:
        earlier = [(o[2], o[1]) for o in others if o[0] == r.k and o[2] < r.line_no]
        assert (r._v.n if r._v else None) == (max(earlier)[1] if earlier else None)
    got = ranges.between(left.withColumnRenamed("line_no", "low"), right, ["k"], "low", "high").collect()
    assert sorted((r.i, r.k, r.n) for r in got) == sorted(
        (i, k, o[1]) for k, i, low in rows for o in others if o[0] == k and low < o[2] < low + i % 17)
    unique = spark.createDataFrame([(k, i * 3) for k in "ab" for i in range(40)], "k string, at int").repartition(5)
    assert all(r["no"] == r["at"] // 3 + 1 for r in ranges.numbered(unique, ["k"], "at", "no").collect())
    ranked = ranges.ranked(left.repartition(7), ["k"], [F.desc("line_no"), F.col("i")], "no").collect()
    for k in "ab":
        mine = sorted((r for r in ranked if r.k == k), key=lambda r: (-r.line_no, r.i))
        assert [r["no"] for r in mine] == list(range(1, 61))


def test_automaton_against_loops():
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("ab_1") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    texts = ["".join(rng.choice("ab_1 .=é") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None]
    assert sorted(mentions.hits(names, texts)) == [(i, n) for i, t in enumerate(texts) for n in names if n in (t or "")]
    import re
    assert sorted(mentions.hits(names, texts, word=True)) == [
        (i, n) for i, t in enumerate(texts) for n in names
        if re.search(rf"(?:^|[^0-9A-Za-z_]){re.escape(n)}(?:$|[^0-9A-Za-z_])", t or "")]


def test_mentions_cost_grows_with_text_and_hits():
    def seconds(n):
        names, texts = [f"n{i}x" for i in range(n)], [f"n{i}x = n{i // 2}x + 1" for i in range(n)]
        start = time.process_time()
        assert sum(1 for _ in mentions.hits(names, texts)) == 2 * n - 1
        return time.process_time() - start

    seconds(20_000)
    once, more = seconds(20_000), seconds(80_000)
    assert more < 10 * once            # pairs would take sixteen times as long


def test_file_of_fifty_thousand_lines(spark, files_of, monkeypatch):
    monkeypatch.undo()
    lines = []
    for k in range(10_000):
        a = f"w{k}x"
        lines += [f"{a} = input()" if k % 50 == 0 else f"{a} = w{k - 1 if k % 5 else k}x", f"def d{k}():", f"os.system({a})",
                  f"print(w{k}x)", "pass"]
    files = files_of({"big.py": "\n".join(lines)})
    tables = flow_tables.FlowTables(files)
    taints = {(r.variable, r.hop) for r in tables.taints.where("hop is not null").collect()}
    assert {("w0x", 0), ("w50x", 0)} <= taints and tables.flows().count() > 200
    edges = tables.call_edges()
    assert edges.where("line_no = 49998 and caller = 'd9999' and caller_line = 49997").count() == 1


@pytest.mark.parametrize("word", [False, True])
@pytest.mark.parametrize("limit", [0, 16, 100_000])
def test_mentions_against_loops(spark, word, limit):
    rng = random.Random(4)
    some = lambda most, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    names = [(k, some(9, "ab_1")) for k in (1, 2) for _ in range(30)] + [(3, None)]
    texts = [(k, i, some(30, "ab_1 .=é")) for k in (1, 2, 3) for i in range(80)] + [(1, 80, None)]
    got = mentions.mentions(spark.createDataFrame(texts, "k int, at int, text string"),
                            spark.createDataFrame(names, "k int, name string"), ["k"], word=word, limit=limit).collect()
    held = {}
    for k, name in names:
        if name:
            held.setdefault(k, set()).add(name)
    assert sorted((r.k, r.at, r.name_in_text) for r in got) == sorted(
        (k, i, n) for k, i, t in texts for n in held.get(k, ()) if list(mentions.hits([n], [t], word)))


def test_no_task_gets_all_names_of_a_file(files, capsys):
    tables = flow_tables.FlowTables(files)
    tables.flows().explain()
    tables.references().explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "CoGroups" not in plan
    # an array column would be measured anew for each row of a batch
    assert not [line for line in plan.splitlines() if "MapInArrow" in line and "bypasses" in line]
