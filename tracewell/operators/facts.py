"""Fact extraction: declarations, assignments, calls, definitions, imports and variables.

Input: ``files`` with ``project_id, path, language, content``. Every extraction is one projection over the file row, so the job is map-only. The
``*_expr`` builders return SQL expression text for reuse in larger projections; the functions
without that suffix explode the result into tables keyed by ``project_id, path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expressions import (
    case, empty, find_all, let, lines_of, null, strip, struct, text, window_text,
)
from tracewell.functions.rows import explode_structs
from tracewell.operators.sizing import only_wanted
from tracewell.rules.catalog import java_regex, word_regex

KEYS = ["project_id", "path"]
JS = ("javascript", "typescript")

# Expressions that define what counts as a declaration, definition, call or
# assignment in each language family.
JS_DECLARATION = r"(var|let|const)\s+(\w+)\s*=\s*([^;]+);"
JS_FUNCTION = r"function\s+(\w+)\s*\(([^)]*)\)\s*\{"
ANY_CALL = r"(\w+(?:\.\w+)*)\s*\(([^)]*)\)"
ANY_ASSIGNMENT = r"(\w+(?:\.\w+)*)\s*=\s*([^;]+);"
JAVA_CLASS = (r"(public|private|protected)?\s+class\s+(\w+)(?:\s+extends\s+(\w+))?"
              r"(?:\s+implements\s+([\w,\s]+))?\s*\{")
JAVA_METHOD = (r"(public|private|protected)?\s+(static)?\s+(\w+)\s+(\w+)\s*\(([^)]*)\)"
               r"\s*(?:throws\s+([\w,\s]+))?\s*\{")
JAVA_FIELD = (r"(public|private|protected)?\s+(static)?\s+(final)?\s+(\w+)\s+(\w+)"
              r"\s*(?:=\s*([^;]+))?;")
TYPED_VARIABLE = r"(\w+)\s+(\w+)\s*(?:=\s*([^;]+))?;"
GENERIC_FUNCTION = r"(?:(\w+)\s+)?(\w+)\s*\(([^)]*)\)\s*\{"
LINE_ASSIGNMENT = r"(\w+)\s*=\s*([^;]+)"

# Python source is read by expressions instead of through a syntax tree: definitions and imports as whole
# statements, over several lines if need be; assignments and calls line by line.
PY_ASSIGNMENT = r"^\s*([A-Za-z_]\w*)\s*((?:[-+*/%&|^@]|//|\*\*|<<|>>)?)=(?:[^=]|$)"
PY_DEFINITION = (r"(?m)^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*"
                 r"(?:\(([^()]*(?:\([^()]*\)[^()]*)*)\)?)?")
PY_HEADING = r"\b(?:def|class)\s+\w+\s*\("
PY_CALL = r"(\w+(?:\.\w+)*)\s*\("
PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([^\n\\#;]*(?:\\\n[^\n\\#;]*)*)"
PY_FROM = r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+([^\n\\#;(]+(?:\\\n[^\n\\#;(]*)*)"
PY_FROM_LIST = r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]*\(([^)]*)\)"
PY_COMMENT = r"#[^\n]*|\\"
PY_NESTED = r"\([^()]*\)"
PY_KEYWORDS = ("and", "assert", "await", "del", "elif", "else", "except", "for", "from", "if",
               "import", "in", "is", "lambda", "not", "or", "raise", "return", "while", "with",
               "yield")

DECL = "struct<line_no:int,kind:string,var_type:string,name:string,value:string>"
ASSIGN = "struct<line_no:int,target:string,value:string>"
CALL = "struct<line_no:int,function:string,args:array<string>,code:string>"
DEF = ("struct<line_no:int,kind:string,name:string,param_types:array<string>,"
       "param_names:array<string>,modifier:string,is_static:boolean,result_type:string,"
       "extends:string,implements:array<string>,throws:array<string>>")
IMPORT = "struct<line_no:int,module:string,names:array<string>,aliases:array<string>>"
EVENT = ("struct<line_no:int,name:string,is_decl:boolean,scope:string,var_type:string,"
         "initializer:string,assigned_value:string>")
LATER = "struct<line_no:int,value:string>"


def _p(pattern: str) -> str:
    return java_regex(pattern)


def _parts(value: str) -> str:
    """Comma-separated text as an array of stripped, non-empty parts."""
    return f"filter(transform(split({value}, ',', -1), _q -> {strip('_q')}), _q -> _q <> '')"


def _code(lines: str, line_no: str) -> str:
    return strip(f"coalesce(get({lines}, {line_no} - 1), '')")


def _no_strings() -> str:
    return empty("string")


def _per_line(lines: str, pattern: str, groups: dict[str, int], result: str, element: str) -> str:
    """One ``result`` per match of an assignment inside each line; ``_x`` is the line, ``_n`` its number."""
    bound = {f"_a_{g}": f"regexp_extract_all(_x, {text(pattern)}, {i})" for g, i in groups.items()}
    first = f"_a_{next(iter(groups))}"
    inner = let({g: f"get(_a_{g}, _k)" for g in groups}, result)
    body = let({"_n": "_i + 1", **bound}, f"transform({first}, (_m, _k) -> {inner})")
    return (f"flatten(transform({lines}, (_x, _i) -> "
            f"if(contains(_x, '='), {body}, {empty(element)})))")


# --- declarations and assignments -------------------------------------------------------------

def decls_expr(content: str = "content", language: str = "language") -> str:
    js = find_all(content, _p(JS_DECLARATION), {"kd": 1, "nm": 2, "vl": 3}, struct(
        line_no="_ln", kind="kd", var_type=null("string"), name="nm", value=strip("vl")), DECL)
    typed = find_all(content, word_regex(TYPED_VARIABLE), {"ty": 1, "nm": 2, "vl": 3}, struct(
        line_no="_ln", kind="'variable'", var_type="ty", name="nm", value=strip("vl")), DECL)
    fields = find_all(content, _p(JAVA_FIELD), {"ty": 4, "nm": 5, "vl": 6}, struct(
        line_no="_ln", kind="'field'", var_type="ty", name="nm", value=strip("vl")), DECL)
    return case(language, {
        ("python",): empty(DECL), JS: js, ("java",): f"concat({fields}, {typed})",
    }, typed)


def assigns_expr(content: str = "content", lines: str = "lines",
                 language: str = "language") -> str:
    whole = find_all(content, word_regex(ANY_ASSIGNMENT), {"lf": 1, "rt": 2}, struct(
        line_no="_ln", target="lf", value=strip("rt")), ASSIGN)
    python = _per_line(lines, _p(PY_ASSIGNMENT), {"nm": 1}, struct(
        line_no="_n", target="nm", value=after_equals(strip("_x"))), ASSIGN)
    return case(language, {("python",): python, ("java",): empty(ASSIGN)}, whole)


def after_equals(code: str) -> str:
    """Text after the first equals sign, stripped; empty when there is none."""
    return (f"if(instr({code}, '=') > 0, "
            f"{strip(f'substring({code}, instr({code}, {text(chr(61))}) + 1)')}, '')")


# --- calls ------------------------------------------------------------------------------------

def calls_expr(content: str = "content", lines: str = "lines", language: str = "language",
               brief: bool = False) -> str:
    """Calls in text order; ``brief`` leaves their arguments empty, for uses that only look at names and lines."""
    def whole(function):
        return find_all(content, word_regex(ANY_CALL), {"cl": 1} if brief else {"cl": 1, "ar": 2}, struct(
            line_no="_ln", function=function, args=_no_strings() if brief else _parts("ar"),
            code=_code(lines, "_ln")), CALL)

    bare = f"regexp_replace(_x, {text(_p(PY_HEADING))}, ' ')"
    names = f"regexp_extract_all({bare}, {text(_p(PY_CALL))}, 1)"
    keywords = ", ".join(text(k) for k in PY_KEYWORDS)
    # a name or one attribute gives its last part; a longer chain gives the first call of the line
    dots = "length(_f) - length(replace(_f, '.', ''))"
    function = (f"if({dots} < 2, substring_index(_f, '.', -1), "
                f"regexp_extract({strip('_x')}, {text(_p(PY_CALL))}, 1))")
    python = (
        f"flatten(transform({lines}, (_x, _i) -> if(instr(_x, '(') = 0 or ltrim(_x) like '#%', "
        f"{empty(CALL)}, transform(filter({names}, _f -> _f not in ({keywords})), _f -> "
        + struct(line_no="_i + 1", function=function, args=_no_strings(),
                 code=strip("_x")) + "))))")
    return case(language, {
        ("python",): python, ("java",): whole("substring_index(cl, '.', -1)"),
    }, whole("cl"))


# --- definitions and imports ------------------------------------------------------------------

def _definition(line_no, kind, name, types=None, names=None, modifier="''", static="false",
                result="''", extends="''", implements=None, throws=None):
    return struct(
        line_no=line_no, kind=kind, name=name, param_types=types or _no_strings(),
        param_names=names or _no_strings(), modifier=modifier, is_static=static,
        result_type=result, extends=extends, implements=implements or _no_strings(),
        throws=throws or _no_strings())


def _words(value: str, index: int) -> str:
    word = f"coalesce(get(filter(split(_q, '[ \\\\t\\\\n\\\\r]+', -1), _w -> _w <> ''), {index}), '')"
    return f"transform({_parts(value)}, _q -> {word})"


def defs_expr(content: str = "content", lines: str = "lines", language: str = "language") -> str:
    js = find_all(content, _p(JS_FUNCTION), {"nm": 1, "pr": 2},
                  _definition("_ln", "'function'", "nm", names=_parts("pr")), DEF)
    classes = find_all(
        content, _p(JAVA_CLASS), {"md": 1, "nm": 2, "ex": 3, "im": 4},
        _definition("_ln", "'class'", "nm", modifier="md", extends="ex", implements=_parts("im")),
        DEF)
    methods = find_all(
        content, _p(JAVA_METHOD), {"md": 1, "st": 2, "rt": 3, "nm": 4, "pr": 5, "th": 6},
        _definition("_ln", "'method'", "nm", types=_words("pr", 0), names=_words("pr", 1),
                    modifier="md", static="st <> ''", result="rt", throws=_parts("th")), DEF)
    generic = find_all(
        content, word_regex(GENERIC_FUNCTION), {"rt": 1, "nm": 2, "pr": 3},
        _definition("_ln", "'function'", "nm", names=_parts("pr"), result="rt"), DEF)
    flat = f"regexp_replace(regexp_replace(pr, {text(_p(PY_COMMENT))}, ' '), {text(_p(PY_NESTED))}, ' ')"
    arguments = (f"filter(transform({_parts(flat)}, _q -> "
                 + strip("regexp_extract(_q, '^([^:=]*)', 1)") + "), _q -> _q rlike '^[A-Za-z_]')")
    python = find_all(content, _p(PY_DEFINITION), {"kd": 1, "nm": 2, "pr": 3}, _definition(
        "_ln", "if(kd = 'def', 'function', 'class')", "nm",
        names=f"if(kd = 'def', {arguments}, {_no_strings()})"), DEF)
    return case(language, {
        ("python",): python, JS: js, ("java",): f"concat({classes}, {methods})"}, generic)


def imports_expr(content: str = "content", language: str = "language") -> str:
    """Python import statements with the names they import, and the alias of each (or an empty text)."""
    clean = f"regexp_replace(nm, {text(_p(PY_COMMENT))}, ' ')"

    def each(pattern):
        return f"transform({_parts(clean)}, _q -> regexp_extract(_q, {text(_p(pattern))}, 1))"

    def statements(pattern, groups, module):
        return find_all(content, _p(pattern), groups, struct(
            line_no="_ln", module=module, names=each(r"^([\w.*]+)"), aliases=each(r"\sas\s+(\w+)")), IMPORT)

    found = [statements(PY_IMPORT, {"nm": 1}, null("string"))] + [
        statements(p, {"md": 1, "nm": 2}, "md") for p in (PY_FROM, PY_FROM_LIST)]
    return case(language, {("python",): f"array_sort(concat({', '.join(found)}))"}, empty(IMPORT))


# --- variables --------------------------------------------------------------------------------

def events_expr(content: str = "content", lines: str = "lines", language: str = "language",
                brief: bool = False) -> str:
    """Assignment-like facts in fact order; the first sighting of a name makes a variable.

    ``brief`` leaves scope and type null, and the value of declarations, which are never later assignments.
    """
    def groups(**numbers):
        return {n: i for n, i in numbers.items() if n == "nm" or not brief}

    def event(line_no, name, is_decl, scope, var_type, value=None):
        code = _code(lines, line_no)
        if brief:
            scope = var_type = null("string")
            value = null("string") if is_decl == "true" else value
        return let({"_cd": code}, struct(
            line_no=line_no, name=name, is_decl=is_decl, scope=scope, var_type=var_type,
            initializer="_cd", assigned_value=value or after_equals("_cd")))

    js_value = let({"_av": after_equals("_cd")},
                   "if(endswith(_av, ';'), left(_av, length(_av) - 1), _av)")
    js = "concat({}, {})".format(
        find_all(content, _p(JS_DECLARATION), groups(kd=1, nm=2),
                 event("_ln", "nm", "true", "kd", null("string"), js_value), EVENT),
        find_all(content, word_regex(ANY_ASSIGNMENT), {"nm": 1},
                 event("_ln", "nm", "false", "'var'", null("string"), js_value), EVENT))
    java = find_all(content, word_regex(TYPED_VARIABLE), groups(ty=1, nm=2, vl=3),
                    event("_ln", "nm", "true", null("string"), "ty", strip("vl")), EVENT)
    python = _per_line(lines, _p(PY_ASSIGNMENT), {"nm": 1},
                       event("_n", "nm", "false", null("string"), null("string")), EVENT)
    generic = _per_line(lines, word_regex(LINE_ASSIGNMENT), {"nm": 1, "vl": 2},
                        event("_n", "nm", "false", null("string"), null("string"), strip("vl")),
                        EVENT)
    return case(language, {("python",): python, JS: js, ("java",): java}, generic)


def variables_expr(content: str = "content", lines: str = "lines",
                   language: str = "language", brief: bool = False) -> str:
    """Variables in fact order, each with its later assignments.

    A declaration is always a variable; an assignment is one only at the first sighting of its
    name and is otherwise attached to the first variable of that name. ``brief`` gives name, line, initializer
    and later assignments only; the other fields are not to be relied on.
    """
    numbered = "transform(_ev, (e, i) -> struct(i as idx, array_position(_nm, e.name) - 1 as fp, e))"
    later = ("transform(filter(_la, y -> y.fp = x.idx), "
             "y -> struct(y.e.line_no as line_no, y.e.assigned_value as value))")
    variable = struct(
        var_ord="_vi + 1", name="x.e.name", line_no="x.e.line_no", initializer="x.e.initializer",
        assigned_value="x.e.assigned_value", scope="x.e.scope", var_type="x.e.var_type",
        later_assigns=f"if(x.idx = x.fp, {later}, {empty(LATER)})")
    return let({
        "_ev": events_expr(content, lines, language, brief),
        "_nm": "transform(_ev, e -> e.name)",
        "_ix": numbered,
        "_la": "filter(_ix, y -> not y.e.is_decl and y.idx <> y.fp)",
    }, f"transform(filter(_ix, x -> x.e.is_decl or x.idx = x.fp), (x, _vi) -> {variable})")


# --- tables -----------------------------------------------------------------------------------

def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", F.expr(lines_of("content")))


def lines(files: DataFrame) -> DataFrame:
    """Numbered source lines, first line 1."""
    return files.select(*KEYS, F.posexplode(F.expr(lines_of("content"))).alias("pos", "text")) \
        .select(*KEYS, (F.col("pos") + 1).alias("line_no"), "text")


def _table(files: DataFrame, expression: str, ordinal: str) -> DataFrame:
    return explode_structs(with_lines(files), KEYS, F.expr(expression), ordinal)


def declarations(files: DataFrame) -> DataFrame:
    return _table(files, decls_expr(), "decl_ord")


def assignments(files: DataFrame) -> DataFrame:
    return _table(files, assigns_expr(), "assign_ord")


def calls(files: DataFrame) -> DataFrame:
    return _table(files, calls_expr(), "call_ord")


def definitions(files: DataFrame) -> DataFrame:
    return _table(files, defs_expr(), "def_ord")


def imports(files: DataFrame) -> DataFrame:
    return _table(files, imports_expr(), "import_ord")


def variables(files: DataFrame) -> DataFrame:
    return explode_structs(with_lines(files), KEYS, F.expr(variables_expr()))


def later_assigns(files: DataFrame) -> DataFrame:
    named = variables(files).withColumnRenamed("name", "var_name").drop("line_no")
    return explode_structs(named, [*KEYS, "var_ord", "var_name"], "later_assigns", "assign_ord")


def usages(files: DataFrame) -> DataFrame:
    """Lines that mention a variable without assigning it, for languages without a parser."""
    pairs = (
        f"flatten(transform({lines_of('content')}, (x, i) -> transform(filter(_v, v -> "
        "contains(x, v.name) and not contains(x, concat(v.name, ' =')) "
        "and not contains(x, concat(v.name, '='))), v -> "
        + struct(var_ord="v.var_ord", name="v.name", line_no="i + 1", context=strip("x")) + ")))")
    generic = files.where(~F.col("language").isin("python", "java", *JS))
    return explode_structs(with_lines(generic), KEYS, F.expr(let({"_v": variables_expr()}, pairs)))


def references(files: DataFrame) -> DataFrame:
    """Where a variable's name occurs in an initializer or later value of any variable."""
    hit = struct(var_ord="v.var_ord", name="v.name", line_no="{0}", context="{1}",
                 ref_name="o.name")
    from_init = "if(contains(o.initializer, v.name), array({}), {})".format(
        hit.format("o.line_no", "o.initializer"),
        empty("struct<var_ord:int,name:string,line_no:int,context:string,ref_name:string>"))
    from_later = ("transform(filter(o.later_assigns, a -> contains(a.value, v.name)), a -> "
                  + hit.format("a.line_no", "a.value") + ")")
    body = (f"flatten(transform(_v, v -> flatten(transform(_v, o -> "
            f"concat({from_init}, {from_later})))))")
    return explode_structs(with_lines(files), KEYS, F.expr(let({"_v": variables_expr()}, body)))


def assignments_to(files: DataFrame) -> DataFrame:
    """Later assignments seen from every variable of the same name."""
    body = ("flatten(transform(_v, v -> flatten(transform(_v, o -> if(o.name = v.name, "
            "transform(o.later_assigns, a -> "
            + struct(var_ord="v.var_ord", name="v.name", line_no="a.line_no", value="a.value")
            + "), " + empty("struct<var_ord:int,name:string,line_no:int,value:string>") + ")))))")
    return explode_structs(with_lines(files), KEYS, F.expr(let({"_v": variables_expr()}, body)))


def snippet_at(files: DataFrame, places: DataFrame, context: int = 2) -> DataFrame:
    """Stripped line and surrounding lines for ``places(project_id, path, line_no)``.

    The wanted line numbers are gathered per file and meet the file row once; content is never copied
    per place. A bitmap of the wanted files leaves out all others where they are read.
    """
    wanted = places.groupBy(*KEYS).agg(F.array_sort(F.collect_set("line_no")).alias("_want"))
    one = struct(line_no="n", code=_code("_l", "n"), context=window_text("_l", "n", context))
    body = let({"_l": lines_of("content")}, f"transform(_want, n -> {one})")
    rows = only_wanted(files, wanted, KEYS).select(*KEYS, "content")
    return explode_structs(rows.join(wanted, KEYS), KEYS, F.expr(body))
