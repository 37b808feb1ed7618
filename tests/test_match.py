import re

from pyspark.sql import functions as F

from tracewell.functions.expressions import MARK
from tracewell.operators import dataflow, facts, match
from tracewell.rules.catalog import regex_rules

TEXTS = {
    "a.py": 'password =\n  "x"\ntoken="a"; token="b"\n\nos.system(cmd)\nx = 1  # http://h http://h\n',
    "b.js": "let k = req.query.q;\nel.innerHTML =\n  k;\nprocess.env\n" + MARK + " eval(k) eval (k)",
    "c.java": 'String s = request.getParameter("q");\nstmt.executeQuery("SELECT" + s);',
    "d.ts": "document.cookie == 'x'; secret='s'",
    "e.txt": "PRIVATE   KEY and private\nkey",
    "f.go": "",
}


def brute(texts):
    langs = {"py": "python", "js": "javascript", "java": "java"}
    out = []
    for path, text in texts.items():
        rules = list(regex_rules("common"))
        lang = langs.get(path.rsplit(".", 1)[1])
        if lang:
            rules += regex_rules(lang)
        for r in rules:
            for m in re.finditer(r.pattern, text, re.IGNORECASE | re.ASCII):
                n = text[:m.start()].count("\n") + 1
                out.append((path, r.rule_type, n, r.pattern, text.split("\n")[n - 1].strip()))
    return out


def test_quick_scan_equals_a_plain_search(files_of):
    rows = match.quick_scan(files_of(TEXTS)).collect()
    got = [(r.path, r.rule_type, r.line_no, r.pattern, r.code) for r in rows]
    assert sorted(got) == sorted(brute(TEXTS))
    assert ("a.py", "hardcoded_credentials", 1) in [g[:3] for g in got]
    assert [g[2] for g in got if g[0] == "a.py" and g[3].startswith("token")] == [3, 3]


def test_quick_scan_keeps_rule_order_in_a_file(files_of):
    rows = match.quick_scan(files_of({"a.py": TEXTS["a.py"]})).orderBy("issue_ord").collect()
    assert [(r.rule_type, r.line_no, r.pattern) for r in rows] == [
        (t, n, p) for _, t, n, p, _ in brute({"a.py": TEXTS["a.py"]})]


def test_web_scan_lookahead(files_of):
    page = ('<form a="1"><p></p></form>\n<form><input name="csrf"></form>\n'
            "Set-Cookie: a=1; HttpOnly\nSet-Cookie: b; secure; samesite\n")
    rows = match.web_scan(files_of({"p.html": page})).collect()
    want = []
    for r in regex_rules("web"):
        for m in re.finditer(r.pattern, page, re.IGNORECASE | re.ASCII):
            want.append((r.pattern, page[:m.start()].count("\n") + 1))
    assert sorted((r.pattern, r.line_no) for r in rows) == sorted(want)
    assert any("csrf|token" in p and n == 1 for p, n in want)


def table(files, name, **options):
    return dataflow.table(files, name, "ord", **options).orderBy("path", "ord").collect()


def test_hits_repeat_per_literal_and_carry_context(files_of):
    text = "a\n  b\nx = flask.request.args.get('q')\nd\ne\nf"
    rows = table(files_of({"a.py": text}), "sources")
    direct = [r for r in rows if r.parent_line is None]
    assert [(r.line_no, r.source_pattern) for r in direct] == [
        (3, "request.args"), (3, "flask.request")]
    assert direct[0].context == "a\n  b\nx = flask.request.args.get('q')\nd\ne"
    assert direct[0].source_code == "x = flask.request.args.get('q')"


def test_indirect_source_is_one_level_only(files_of):
    text = "a = input()\nb = a\nc = b\nprint(a)"
    rows = table(files_of({"x.py": text}), "sources")
    indirect = [(r.line_no, r.source_type, r.source_pattern, r.derived_variable, r.parent_line)
                for r in rows if r.parent_line]
    assert indirect == [(2, "indirect_user_input", "a", "b", 1)]


def test_sanitized_variable_is_assigned_name_or_first_argument(files_of):
    text = "x = html.escape(a)\nreturn html.escape(b, True)\nescape"
    rows = table(files_of({"x.py": text}), "sanitizers")
    got = {(r.line_no, r.sanitizer_pattern): r.sanitized_variable for r in rows}
    assert got == {(1, "escape("): "x", (1, "html.escape("): "x",
                   (2, "escape("): "b", (2, "html.escape("): "b"}


def test_validation_messages_and_input_line(files_of):
    text = "x = 1\ny = 2\nif (x.length > 3) { z }\nSELECT a\nq"
    rows = table(files_of({"x.js": text}), "validation_attempts")
    assert len(rows) == 1
    assert rows[0].bypasses == [
        "Length check for 'x' doesn't validate the content",
        "sql_injection validation may be incomplete - missing checks for: "
        "DELETE, DROP, INSERT, UNION, UPDATE"]
    assert rows[0].input_line == 1  # falls back: "length" is the compared name
    again = table(files_of({"y.js": "a\nx = 1\nb\nif (validate(x) && x == 2)\n"}),
                  "validation_attempts")
    assert [r.input_line for r in again] == [2, 2] and again[0].code == again[1].code


def test_input_line_estimate(files_of):
    rows = table(files_of({"x.go": "\n" * 8 + "check(a)"}), "validation_attempts")
    assert [(r.line_no, r.input_line, r.bypasses) for r in rows] == [(9, 4, [])]


def test_suspicious_order_and_kinds(files_of):
    text = "h = md5(a)\neval(x); eval(y)\nArray.prototype .x\n" + r'"\x41\x42\x43"' + "\nString.fromCharCode(1)"
    rows = table(files_of({"x.js": text}), "suspicious_patterns")
    assert [(r.type, r.line_no) for r in rows] == [
        ("dynamic_code_execution", 2), ("weak_crypto", 1), ("obfuscated_code", 4),
        ("obfuscated_code", 5), ("prototype_pollution", 3)]


def patterns(spark, rows):
    return spark.createDataFrame(
        rows, "project_id bigint, kind string, category string, name string, impact string, file_ord int")\
        .withColumn("pattern_ord", F.lit(0))


def test_project_rules_and_wrappers(spark, files_of):
    text = "v = readThing(1)\n\n\ndoIt(v)\n\n\nos.system(v)\n\nos.popen(v)"
    extra = patterns(spark, [
        (1, "custom_function", None, "readThing", "old", 0),
        (1, "custom_function", None, "readThing", "Reads USER DATA, unsafe", 1),
        (1, "custom_function", None, "late", "user data", 5),
        (1, "wrapper_function", None, "doIt", None, 0),
        (1, "data_transformation", None, "readThing", None, 0),
        (2, "wrapper_function", None, "popen", None, 0)])
    files = files_of({"x.py": text})
    sources = table(files, "sources", patterns=extra)
    assert ("custom_input", "readThing") in [(r.source_type, r.source_pattern) for r in sources]
    sinks = table(files, "sinks", patterns=extra)
    wrapped = [(r.line_no, r.sink_type, r.sink_pattern, r.wrapped_sink) for r in sinks if r.wrapped_sink]
    assert wrapped == [(4, "wrapper_command_injection", "doIt", "os.system(")]  # line 9 is too far
    odd = table(files, "suspicious_patterns", patterns=extra)
    assert [(r.type, r.line_no, r.pattern) for r in odd] == [("custom_suspicious", 1, "readThing")]


def test_hits_lie_in_lines(spark, files_of):
    files = files_of(TEXTS)
    hits = dataflow.table(files, "sinks").select("path", "line_no", "sink_pattern")
    lines = facts.lines(files)
    kept = hits.join(lines, ["path", "line_no"]).where(F.expr("contains(text, sink_pattern)"))
    assert kept.count() == hits.count() > 0


def test_plain_text_is_looked_for_before_expressions(spark):
    assert match._found("x", "validate") == "contains(x, 'validate')"
    found = match._found("x", r"if\s*\(")
    assert found.startswith("(contains(x, 'if') and rlike(x, ")
    for pattern in ("a|b", "(?i)eval"):
        assert match._found("x", pattern).startswith("rlike(")
    texts = spark.createDataFrame([("if  (a)",), ("iff",), ("elif(",), ("",), (None,)], "x string")
    held = texts.selectExpr(found, f"rlike(x, {match.text(match.java_regex('if.s*.(').replace('.', chr(92)))})").collect()
    assert all(a == b for a, b in held) and [a for a, _ in held] == [True, False, True, False, None]
