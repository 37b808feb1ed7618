import random

from tracewell.operators import dataflow, facts

def rows(files, name, **options):
    return dataflow.table(files, name, "ord", **options).orderBy("path", "ord").collect()


def test_chain_from_source_to_sink(files_of):
    # one-letter names would also occur inside other words
    text = "aa = input()\nbb = aa\ncc = bb\nos.system(cc)"
    last = [f for f in rows(files_of({"x.py": text}), "flows") if f.variable == "cc"]
    assert last[0].sink_line == 4 and not last[0].sanitized
    assert last[0].flow_path == [
        "Source at line 3", "Transformed from bb at line 3", "Reaches sink at line 4"]
    assert last[0].validation_bypass == ["No validation attempts detected"]


def test_hops_and_parents(files_of):
    text = "seed = input()\nfirst = seed\nsecond = first\nthird = second\nother = 1"
    taints = rows(files_of({"x.py": text}), "taints")
    reached = [(t.variable, t.transformed_from, t.hop, t.source) for t in taints if t.hop]
    # 'first = seed' is itself an indirect source line, so it is a seed
    assert reached == [("second", "first", 1, "indirect_user_input"),
                       ("third", "second", 2, "indirect_user_input")]


def test_long_chain_reaches_its_sink(files_of):
    names = [f"v{a}{b}x" for a in "abcdefghij" for b in "abcdefg"]
    lines = [f"let {b} = {a};" for a, b in zip(names, names[1:])][::-1]
    text = "\n".join([*lines, f"let {names[0]} = req.query.q;", f"eval({names[-1]});"])
    taints = rows(files_of({"x.js": text}), "taints")
    assert max(t.hop or 0 for t in taints) >= 68
    flows = rows(files_of({"x.js": text}), "flows")
    assert [f.variable for f in flows if f.sink_type] == [names[-1]]
    assert rows(files_of({"x.js": text}), "flows", max_hops=50) == []


def test_reversed_chain_longer_than_five(files_of):
    names = ["n" + c * 2 for c in "abcdefgh"]
    lines = [f"{a} = {b}" for a, b in zip(names[1:], names)][::-1] + [f"{names[0]} = input()"]
    taints = rows(files_of({"x.py": "\n".join(lines)}), "taints")
    assert {t.variable for t in taints} == set(names)
    assert max(t.hop or 0 for t in taints) == 6
    short = rows(files_of({"x.py": "\n".join(lines)}), "taints", max_hops=2)
    assert max(t.hop or 0 for t in short) == 2


def test_substring_and_word_matching(files_of):
    text = "v1 = input()\nv11 = 5\nos.system(v11)"
    loose = {f.variable for f in rows(files_of({"x.py": text}), "flows")}
    strict = {f.variable for f in rows(files_of({"x.py": text}), "flows", word=True)}
    assert "v1" in loose and strict == set()


def test_sanitizer_must_be_strictly_between(files_of):
    def flow(text):
        return [f for f in rows(files_of({"x.py": text}), "flows") if f.variable == "aa"
                and f.source_type == "user_input"][0]

    between = flow("aa = input()\nhtml.escape(aa)\nos.system(aa)")
    assert between.sanitized and {s.line_no for s in between.sanitizers} == {2}
    same = flow("aa = input()\nos.system(html.escape(aa))")
    assert not same.sanitized and same.sanitizers == []


def test_sink_before_source_is_kept_and_marked(files_of):
    flows = rows(files_of({"x.py": "os.system(aa)\n\n\naa = input()"}), "flows")
    assert {(f.sink_line, f.source_line, f.sink_after_source) for f in flows} == {(1, 4, False)}


def test_validation_between_is_reported(files_of):
    text = "aa = input()\nverify(aa)\n\nos.system(aa)"
    flows = [f for f in rows(files_of({"x.py": text}), "flows") if f.variable == "aa"]
    assert flows[0].validation_bypass == ["No obvious bypasses detected"]
    assert "Passed to verify at line 2" in flows[0].flow_path


def test_call_taint_and_chained_option(files_of):
    text = "aa = input()\nbb = clean(aa)\ncc = 1\n"
    taints = rows(files_of({"x.go": text.replace("input()", "req.body;")}), "taints")
    by_call = [(t.variable, t.line_no, t.transformed_from) for t in taints if t.hop is None]
    assert ("bb", 2, "aa") in by_call and len(by_call) == len(set(by_call))
    chained = rows(files_of({"x.go": text}), "taints", chain_calls=True)
    assert isinstance(chained, list)


def test_enclosing_definition_is_strictly_before(files_of):
    text = "before()\ndef one():\n    inner()\ndef two(): same()\n    later()"
    edges = rows(files_of({"x.py": text}), "call_edges")
    assert [(e.callee, e.line_no, e.caller) for e in edges] == [
        ("before", 1, None), ("inner", 3, "one"), ("same", 4, "one"), ("later", 5, "two")]


def test_first_of_two_definitions_on_a_line_wins(files_of):
    text = "function a() { } function b() { }\nc();"
    edges = rows(files_of({"x.js": text}), "call_edges")
    assert [e.caller for e in edges if e.callee == "c"] == ["a"]


def test_call_graph_last_definition_wins(files_of):
    text = "def f():\n    g()\ndef g():\n    f()\ndef f():\n    g()\n    g()"
    graph = {g.name: g for g in rows(files_of({"x.py": text}), "call_graph")}
    assert graph["f"].line_no == 5 and graph["f"].calls == ["g", "g"]
    assert graph["g"].called_by == ["f", "f"] and graph["f"].called_by == ["g"]


def test_variables_of_each_language(files_of):
    files = files_of({
        "a.js": "let xx = 1;\nlet xx = 2;\nxx = yy;\nobj.k = 3;",
        "b.java": "String s = \"a\";\nreturn x;\ns = y;",
        "c.go": "aa = 1; bb = 2\naa = bb",
        "d.py": "aa = 1\nif aa == 2:\n    aa = 3\n(bb, cc) = 1, 2\ndd += 1"})
    got = {}
    for v in facts.variables(files).orderBy("path", "var_ord").collect():
        got.setdefault(v.path, []).append((v.name, v.line_no, v.assigned_value, len(v.later_assigns)))
    assert got["a.js"] == [("xx", 1, "1", 3), ("xx", 2, "2", 0), ("obj.k", 4, "3", 0)]
    assert got["b.java"] == [("s", 1, '"a"', 0), ("x", 2, "", 0)]
    assert got["c.go"] == [("aa", 1, "1", 1), ("bb", 1, "2", 0)]
    assert got["d.py"] == [("aa", 1, "1", 1), ("dd", 5, "1", 0)]


def test_java_definitions_and_fields(files_of):
    text = ("public class A extends B implements C, D {\n"
            "  private static final int k = 3;\n"
            "  public static void run(String a, int b) throws X, Y {\n}")
    defs = facts.definitions(files_of({"A.java": text})).orderBy("def_ord").collect()
    assert (defs[0].kind, defs[0].name, defs[0].extends, defs[0].implements) == (
        "class", "A", "B", ["C", "D"])
    run = defs[1]
    assert (run.name, run.result_type, run.is_static, run.param_types, run.param_names, run.throws) == (
        "run", "void", True, ["String", "int"], ["a", "b"], ["X", "Y"])
    fields = facts.declarations(files_of({"A.java": text})).where("kind = 'field'").collect()
    assert [(f.var_type, f.name, f.value) for f in fields] == [("int", "k", "3")]


def test_python_facts(files_of):
    text = ("import os, sys as s\nfrom a.b import c, d\n# skip(me)\n"
            "def f(a, b: int = 2, *rest):\n    return g(h.i(j), k.l.m())\nclass K:\n    pass")
    files = files_of({"x.py": text})
    assert [(c.function, c.line_no) for c in facts.calls(files).orderBy("call_ord").collect()] == [
        ("g", 5), ("i", 5), ("g", 5)]
    assert [(d.kind, d.name, d.param_names) for d in facts.definitions(files).orderBy("def_ord").collect()] == [
        ("function", "f", ["a", "b"]), ("class", "K", [])]
    assert [(i.module, i.names) for i in facts.imports(files).orderBy("import_ord").collect()] == [
        (None, ["os", "sys"]), ("a.b", ["c", "d"])]


def test_python_statements_over_several_lines(files_of):
    text = ("from a.b import (c as d,  # why\n    e,\n)\nimport os.path as p, \\\n  sys\nfrom . import *\n"
            "def f(a, b=g(1, 2),\n      # comment, here\n      *rest,\n      key: int = 3):\n    return h(a,\n             b)\n"
            "class K(\n    Base):\n    async def m(self): pass")
    files = files_of({"x.py": text})
    imports = [(i.line_no, i.module, i.names, i.aliases) for i in facts.imports(files).orderBy("import_ord").collect()]
    assert imports == [(1, "a.b", ["c", "e"], ["d", ""]), (4, None, ["os.path", "sys"], ["p", ""]), (6, ".", ["*"], [""])]
    defs = [(d.line_no, d.kind, d.name, d.param_names) for d in facts.definitions(files).orderBy("def_ord").collect()]
    assert defs == [(7, "function", "f", ["a", "b", "key"]), (13, "class", "K", []), (15, "function", "m", ["self"])]


def brute_taint(seeds, variables):
    """Smallest hop first, then lowest parent, initializer before later assignment."""
    marked = {i: (0, None) for i, v in enumerate(variables) if v["line"] in seeds}
    frontier, hop = sorted(marked), 0
    while frontier:
        hop, new = hop + 1, {}
        for i, v in enumerate(variables):
            if i in marked:
                continue
            best = min(((p, k, w) for p in frontier for k, w, text in v["writes"]
                        if variables[p]["name"] in text), default=None)
            if best:
                new[i] = (hop, variables[best[0]]["name"])
        marked.update(new)
        frontier = sorted(new)
    return {(variables[i]["name"], h, p) for i, (h, p) in marked.items() if h}


def test_fixpoint_equals_brute_force_on_random_files(spark, files_of):
    rng = random.Random(5)
    texts = {}
    for n in range(40):
        lines = []
        for _ in range(rng.randint(3, 25)):
            a, b = (f"w{rng.randint(0, 14)}x" for _ in range(2))
            lines.append(f"{a} = input()" if rng.random() < 0.1 else f"{a} = {b} + 1")
        texts[f"f{n}.py"] = "\n".join(lines)
    files = files_of(texts).repartition(5)
    got = {}
    for t in dataflow.table(files, "taints").where("hop > 0").collect():
        got.setdefault(t.path, set()).add((t.variable, t.hop, t.transformed_from))
    sources = {}
    for s in dataflow.table(files, "sources").collect():
        sources.setdefault(s.path, set()).add(s.line_no)
    for path, text in texts.items():
        variables, index = [], {}
        for n, line in enumerate(text.split("\n"), 1):
            name, value = line.split(" = ", 1)
            if name in index:
                v = variables[index[name]]
                v["writes"].append((1, len(v["writes"]), value))
            else:
                index[name] = len(variables)
                variables.append({"name": name, "line": n, "writes": [(0, 0, line)]})
        assert got.get(path, set()) == brute_taint(sources.get(path, set()), variables), path


def test_only_needed_rules_and_lines_are_looked_at(files_of):
    files = files_of({"x.py": "aa = input()\nbb = html.escape(aa)\nos.system(bb)"})

    def plan(result):
        return dataflow.table(files, result)._jdf.queryExecution().analyzed().toString()

    taints, sinks, flows = plan("taints"), plan("sinks"), plan("flows")
    assert "os.system(" not in taints and "html.escape(" not in taints and "input(" in taints
    assert "os.system(" in sinks and "html.escape(" not in sinks
    assert "os.system(" in flows and "html.escape(" in flows
    # surrounding lines come with the hits, however many results are asked for
    both = dataflow.analyze(files, results=["sinks", "flows"]).first()
    assert both.sinks[0].context.startswith("aa = input()") and both.flows
    assert [f.variable for f in both.flows if f.sanitized] == []


def test_names_are_bound_without_copies(spark):
    from tracewell.functions.expressions import let

    spoken = let({"a": "id + 1", "b": "array(a, a)"}, "concat(b, array(id))")
    assert "transform(" not in spoken
    assert [list(r[0]) for r in spark.range(2).selectExpr(spoken).collect()] == [[1, 1, 0], [2, 2, 1]]
    assert spark.range(1).selectExpr(let({"a": "cast(null as int)"}, "coalesce(a, 5)")).first()[0] == 5


def test_no_expression_is_made_per_name(files_of):
    from tracewell.operators import match

    # one fixed expression for all literals and names, not one compiled for each pair
    assert "\\Q" not in match.assigned_name("code", "name") and "\\Q" not in dataflow.taints_expr()
    assert "rlike" not in match.sources_expr() and "concat('(?d)" not in match.sources_expr()
    text = "x == (yy = input() + zz)\nuu = 5 = yy\nyy.k = vv\nww = clean(yy, (a = b))\nyy = 1"
    files = files_of({"x.py": text})
    found = [(s.line_no, s.assigned, s.derived_variable, s.parent_line) for s in rows(files, "sources")]
    assert found == [(1, "x", None, None)]
    text = "\tyy = input()\nuu = 5 = yy\nyy.k = vv\nww = clean(yy, (a = b))\nyy = 1"
    files = files_of({"x.py": text})
    found = [(s.line_no, s.assigned, s.derived_variable, s.parent_line) for s in rows(files, "sources")]
    assert found == [(1, "yy", None, None), (2, None, "uu", 1), (4, None, "ww", 1)]
    assert [(t.variable, t.line_no, t.transformed_from) for t in rows(files, "taints") if t.hop is None] == [
        ("yy", 1, "yy"), ("ww", 4, "yy"), ("ww", 4, "ww")]


def test_taints_need_no_arguments_scopes_or_types(files_of):
    files = files_of({"x.js": "let aa = req.query.q;\nlet bb = go(aa, 1);\nbb = aa;\nlet aa = cc;"})

    def plan(result):
        return dataflow.table(files, result)._jdf.queryExecution().analyzed().toString()

    assert "lambda ar#" in plan("function_calls") and "lambda ar#" not in plan("taints")
    assert "lambda kd#" in plan("variables") and "lambda kd#" not in plan("taints")
    assert [(v.name, v.assigned_value, v.scope, len(v.later_assigns)) for v in rows(files, "variables")] == [
        ("aa", "req.query.q", "let", 2), ("bb", "go(aa, 1)", "let", 2), ("aa", "cc", "let", 0)]
    assert [c.args for c in rows(files, "function_calls")] == [["aa", "1"]]
    both = dataflow.analyze(files, results=["variables", "taints"]).first()
    assert both.variables[0].scope == "let" and [(t.variable, t.hop) for t in both.taints][:1] == [("aa", 0)]


def test_wrapper_lines_meet_sinks_by_number(spark, files_of):
    from tracewell.operators import match

    assert "split(" not in match.sinks_expr()
    patterns = spark.createDataFrame(
        [(1, "wrapper_function", None, "go(", None, 0, 1), (1, "wrapper_function", None, "no(", None, 0, 2),
         (1, "custom_function", None, "mine(", "executes a sql query", 0, 3)],
        "project_id bigint, kind string, category string, name string, impact string, file_ord int, pattern_ord bigint")
    lines = ["eval(aa)", "mine(aa); eval(bb)", "xx", "yy", "go(1)", "zz", "uu", "mine(bb)", "eval(cc)", "go(2)"]
    found = rows(files_of({"x.py": "\n".join(lines)}), "sinks", patterns=patterns)
    wrapped = [(s.line_no, s.wrapped_sink, s.context.count("\n") + 1) for s in found if s.wrapped_sink]
    assert wrapped == [(5, "eval(", 7), (5, "mine(", 7), (5, "mine(", 7), (10, "eval(", 4), (10, "mine(", 4)]
