"""Pieces of long files: facts of pieces are those of the whole text, wherever a statement crosses a line."""

import random

import pytest
from pyspark.sql import functions as F

from suite import fixtures as fx
from suite import queries
from tests.test_flow_tables import equal
from tracewell.operators import dataflow, facts, flow_tables, pieces

PARTS = {
    "py": ["a = request.args.get('q')", "b = a.strip()", "def f(a,", "      b=g(1,", "2)):", "os.system(b)", "class K(", ")",
           "if (a == None):", "def h", "(x):", "print(", "a)", "", "x = f(a) # ("],
    "js": ["let a = req.query.q;", "let b =", " a", "  .trim();", "execSync(b);", "function", "f(a", ", b) {", "a", "= b;",
           "if (a === null) return;", "}", "", "  ", "el.innerHTML = b;", "f(", "a);", "c = b"],
    "java": ["String a = request.getParameter(\"q\");", "String b", "  = a;", "public static String f(String a)", "{", "}",
             "  static int g(int a) {", "class K", " implements A,", "B {", "class L {", "static int h(int b) {", ";", "",
             "  ", "stmt.executeQuery(\"S\" + b);", "String c = f(", "b);", "public K(int q) {", "@A"],
    "go": ["a = req.body;", "b = a", "func f(a,", "b) {", "executeQuery(b)", "f", "(a)", "g(a)", "{", "}", "", "if (a == nil);"]}


@pytest.fixture(scope="module")
def files(files_of):
    rng = random.Random(5)
    return files_of({f"f{n}.{kind}": "\n".join(rng.choice(PARTS[kind]) for _ in range(rng.randint(1, 70)))
                     for n in range(12) for kind in PARTS} | {"empty.py": "", "lines.js": "\n\n\n", "end.java": "a();\n"}).cache()


@pytest.fixture(autouse=True)
def short_pieces(monkeypatch):
    monkeypatch.setattr(pieces.pieces, "__defaults__", (1,))


def test_pieces_give_the_text_back(files):
    found = pieces.pieces(files).collect()
    assert len(found) > 3 * files.count()
    for f in files.collect():
        mine = sorted((r for r in found if r.path == f.path), key=lambda r: r.piece)
        lines = f.content.split("\n")
        assert [line for r in mine for line in r.content.split("\n")] == lines
        for r in mine:
            n = r.content.count("\n") + 1
            assert r.before == lines[max(0, r.skipped - 4):r.skipped] and r.after == lines[r.skipped + n:r.skipped + n + 4]


def test_facts_of_pieces_equal_those_of_files(files, spark):
    tables = flow_tables.FlowTables(files)
    for name, column, table in (("calls", "call_ord", facts.calls), ("defs", "def_ord", facts.definitions)):
        equal(tables._rows(name, column), table(files))
    equal(tables.variables, facts.variables(files), "later_assigns")
    equal(tables.sources, dataflow.table(files, "sources"))
    equal(tables.validations(), dataflow.table(files, "validation_attempts"))
    equal(tables.flows(), dataflow.table(files, "flows"))
    patterns = spark.createDataFrame(
        [(1, "wrapper_function", None, "f", None, 0, 0), (1, "wrapper_function", None, "g", None, 0, 1)],
        "project_id long, kind string, category string, name string, impact string, file_ord int, pattern_ord long")
    equal(flow_tables.FlowTables(files, patterns)._rows("sinks", "sink_ord"),
          dataflow.table(files, "sinks", "sink_ord", patterns=patterns))


def test_a_long_file_is_many_bounded_rows(files_of, monkeypatch):
    monkeypatch.undo()
    files = files_of({"big.js": "let h = f(a);\n" * 40_000, "big.py": "def f(a):\n" * 40_000})
    sizes = flow_tables.FlowTables(files).facts.select(F.size("events") + F.size("defs")).collect()
    assert len(sizes) > 10 and max(r[0] for r in sizes) < 12_000


def test_references_of_a_repeated_name_do_not_multiply(spark, files_of, monkeypatch):
    monkeypatch.undo()
    files = files_of({"a.js": "let h = hash(1);\n" * 300})
    monkeypatch.setattr(fx, "long_files", lambda *_: files)
    tables = flow_tables.FlowTables(files)
    # each line is a declaration and an assignment
    assert tables.references(by_name=True).count() == 600 and tables.references().count() == 180_000
    rows = queries.QUERIES["jn_03_long_files"](spark, "").collect()
    assert len(rows) == 300 and {(r.uses, r.line_sum, r.ref_names) for r in rows} == {(600, 90_300, 1)}


def parted(files, spark):
    """The files as rows of one line each, in an order of their own."""
    rows = [(f.project_id, f.path, f.language, n, line) for f in files.collect()
            for n, line in enumerate(f.content.split("\n"))]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "project_id bigint, path string, language string, part bigint, content string")


def test_files_in_parts_give_the_same_pieces(files, spark):
    columns = ["project_id", "path", "language", "content", "piece", "skipped", "before", "after"]
    whole, parts = (sorted(map(tuple, pieces.pieces(f).select(columns).collect()), key=repr)
                    for f in (files, parted(files, spark)))
    assert whole == parts and len(whole) > 3 * files.count()


def test_one_piece_of_a_file_in_parts_is_held_at_a_time():
    read = [0]

    def parts():
        for n in range(100_000):
            read[0] += 1
            yield f"let h{n} = f(a);"

    for language in ("javascript", "python"):
        read[0], given, ahead = 0, 0, []
        for body, _, _ in pieces.cuts(parts(), language):
            given += body.count("\n") + 1
            ahead.append(read[0] - given)
        assert given == 100_000 and max(ahead) < 30_000


def test_tables_of_files_in_parts(files, spark):
    parts = parted(files, spark)
    for result in ("sources", "call_edges", "validation_attempts"):
        equal(flow_tables.table(parts, result, lines=30), dataflow.table(files, result))


def test_only_the_facts_of_a_result_are_made(files):
    made = flow_tables.FlowTables(files, result="call_edges").facts.columns
    assert {"calls", "defs"} <= set(made) and not {"lines", "hits", "events", "checks", "sinks"} & set(made)


def test_long_files_in_parts_hold_the_texts(spark, tmp_path):
    rows = [(o, n % 7 + 1, o * 3 + n, n) for o in range(0, 900, 5) for n in range(6)] + [(None, 1, 2, 3), (8, None, 1, 1)]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = {(r.project_id, r.path, r.language): r.content for r in fx.long_files(spark, str(tmp_path)).collect()}
    found = {}
    for r in sorted(fx.long_files(spark, str(tmp_path), True).collect(), key=lambda r: r.part or 0):
        found.setdefault((r.project_id, r.path, r.language), []).append(r.content)
    assert {k: "\n".join(t for t in v if t is not None) for k, v in found.items()} == whole
    assert max(len(v) for v in found.values()) > 1
