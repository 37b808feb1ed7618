"""Work across the files of a project: metadata, scores, selection, context, cross-file calls.

A project may hold a large share of all files, so nothing here gathers a project in one task:
counts and last definitions are plain aggregations (combined before the shuffle), top-k is a rank
filter that Spark trims per partition first, and calls meet definitions on ``project_id, name``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.expressions import case, empty, let, lines_of, strip, struct, text, window_text
from tracewell.functions.rows import explode_structs
from tracewell.functions.scalars import basename, kind_hint, purpose_of, security_words_in
from tracewell.operators.facts import JS, KEYS, definitions, with_lines
from tracewell.operators.ranges import ranked
from tracewell.operators.sizing import only_wanted, written
from tracewell.rules.catalog import java_regex, word_regex
from tracewell.sources.corpus import head

TOP_FILES = 30
ENOUGH_SCORED = 15

# What counts as an import, an endpoint or a security-critical definition.
IMPORTS = {
    ("python",): [r"import\s+(\w+(?:\.\w+)*)", r"from\s+(\w+(?:\.\w+)*)\s+import"],
    JS: [r"""import\s+.*\s+from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""],
    ("java",): [r"import\s+([^;]+);"],
}
ENDPOINTS = {
    ("python",): [(r"""@app\.route\s*\(\s*['"]([^'"]+)['"]""", 1),
                  (r"""@app\.\w+\s*\(\s*['"]([^'"]+)['"]""", 1),
                  (r"""path\s*\(\s*['"]([^'"]+)['"]""", 1),
                  (r"""url\s*\(\s*['"]([^'"]+)['"]""", 1)],
    JS: [(r"""app\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 2),
         (r"""router\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 2)],
    ("java",): [(rf"""@{a}\s*\(\s*['"]([^'"]+)['"]""", 1) for a in (
        "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "Path")],
}
SCAN_ENDPOINTS = {
    ("python",): (r"""@\w+\.route\s*\(\s*['"]([^'"]+)['"]""", 1),
    JS: (r"""\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 2),
    ("java",): (r"@(RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping)\s*\(\s*"
                r"""['"]([^'"]+)['"]""", 2),
}
CRITICAL_WORDS = [
    "authenticate|login|authorize|password|credential|token|key|secret|encrypt|decrypt|hash|"
    "permission|access|admin|root",
    "exec|eval|system|command|execute|spawn|injection|sanitize|escape|validate|filter",
    "sql|query|database|insert|update|delete|select|where",
    "request|response|header|cookie|session|csrf|xss|html|url|redirect|forward",
    "file|directory|path|upload|download|stream|read|write|open|close",
]
CALLED_NAME = r"(\w+)\s*\("
IMPORT_WORDS = ["sql", "auth", "crypt", "token", "password", "login", "security", "exec", "eval",
                "command", "system", "request", "http", "express", "file", "path", "stream",
                "upload", "download"]
NAME_WORDS = ["auth", "login", "security", "password", "user", "admin", "permission", "token",
              "jwt", "session", "cookie", "crypt", "hash", "controller", "route", "api", "request",
              "response", "upload", "download", "validator", "sanitize", "filter", "sql",
              "database", "config", "env", "secret"]
# Fixed values of the fallback score; "auth" stands twice on purpose and counts twice.
FALLBACK_WORDS = [
    "auth", "login", "user", "password", "cred", "admin", "access", "security", "permission",
    "token", "jwt", "oauth", "session", "api", "controller", "endpoint", "route", "handler",
    "middleware", "database", "sql", "query", "db", "store", "crypto", "encrypt", "secret", "key",
    "cert", "config", "setting", "env", "http", "request", "response", "server", "client", "auth",
    "file", "upload", "download", "exec", "shell", "command", "process", "stream", "socket",
    "cookie"]
MAIN_FILES = {
    "python": ["app.py", "main.py", "wsgi.py", "asgi.py", "application.py", "server.py"],
    "javascript": ["app.js", "index.js", "server.js", "main.js", "app.jsx", "index.jsx"],
    "java": ["main.java", "application.java", "app.java", "server.java"],
    "ruby": ["application.rb", "app.rb", "main.rb", "server.rb"],
    "php": ["index.php", "app.php", "main.php"],
    "golang": ["main.go", "app.go", "server.go"],
}
FOLDER_WORDS = ["api", "controllers", "routes", "handlers", "services", "middleware", "auth",
                "security", "users", "admin", "src/main", "app"]


def _all(content: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({content}, {text(java_regex(pattern))}, {group})"


def _distinct(parts: list[str]) -> str:
    return f"array_sort(array_distinct(concat({', '.join(parts)})))"


def imports_of(content: str) -> str:
    """Distinct imports of a text by ``language``, sorted."""
    branches = {k: _distinct([f"transform({_all(content, p, 1)}, v -> {strip('v')})" for p in ps])
                for k, ps in IMPORTS.items()}
    return case("language", branches, empty("string"))


def endpoints_of(content: str) -> str:
    branches = {k: _distinct([_all(content, p, g) for p, g in ps]) for k, ps in ENDPOINTS.items()}
    return case("language", branches, empty("string"))


def scan_endpoints_of(content: str) -> str:
    """Endpoints for the scan context: fewer expressions, in text order, duplicates kept."""
    branches = {k: _all(content, p, g) for k, (p, g) in SCAN_ENDPOINTS.items()}
    return case("language", branches, empty("string"))


def critical_functions_of(content: str) -> str:
    """Distinct texts of definitions whose name holds a critical word, sorted."""
    def found(shape):
        return _distinct([
            f"regexp_extract_all({content}, {text(java_regex(shape.format(words), True))}, 0)"
            for words in CRITICAL_WORDS])

    return case("language", {
        JS: found(r"function\s+\w*({})\w*\s*\("),
        ("python",): found(r"def\s+\w*({})\w*\s*\("),
        ("java",): found(r"\w+\s+\w*({})\w*\s*\([^)]*\)"),
    }, found(r"\w+\s+\w*({})\w*\s*\("))


def _or_null(expression: str) -> Column:
    return F.expr(let({"v": expression}, "if(size(v) = 0, null, v)"))


def file_metadata(files: DataFrame, head_chars: int | None = None) -> DataFrame:
    """Imports, endpoints and critical definitions of each file (or its head); null when none."""
    top = files.withColumn("head", head(F.col("content"), head_chars))
    return top.withColumns({
        "imports": _or_null(imports_of("head")),
        "endpoints": _or_null(endpoints_of("head")),
        "critical_functions": _or_null(critical_functions_of("head")),
    }).drop("head")


def _contains_any(value: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(value, F.lit(word))
    return hit


def file_scores(metadata: DataFrame) -> DataFrame:
    """Security score and its reasons; files scoring nothing are left out.

    The positive ones are picked inside an array: a plain filter on the score would be pushed down
    and compute every extraction a second time.
    """
    nothing = F.expr(empty("string"))
    secure = F.filter(F.coalesce("imports", nothing),
                      lambda i: _contains_any(F.lower(i), IMPORT_WORDS))
    counted = metadata.select(
        *KEYS, "name", secure.alias("secure"),
        F.size(F.coalesce("endpoints", nothing)).alias("n_ends"),
        F.size(F.coalesce("critical_functions", nothing)).alias("n_funcs"),
        _contains_any(F.lower(F.col("name")), NAME_WORDS).alias("named"))
    score = (F.size("secure") * 2 + F.col("n_ends") * 3 + F.col("n_funcs") * 3
             + F.when(F.col("named"), 5).otherwise(0))
    reasons = F.array_compact(F.array(
        F.when(F.size("secure") > 0,
               F.concat(F.lit("Imports: "), F.array_join("secure", ", "))),
        F.when(F.col("n_ends") > 0, F.concat(F.lit("Has "), "n_ends", F.lit(" API endpoints"))),
        F.when(F.col("n_funcs") > 0,
               F.concat(F.lit("Has "), "n_funcs", F.lit(" security-critical functions"))),
        F.when(F.col("named"), F.concat(F.lit("Security-relevant filename: "), "name"))))
    scored = F.array(F.struct(score.alias("score"), reasons.alias("reasons")))
    return explode_structs(counted, KEYS, F.filter(scored, lambda s: s["score"] > 0))


def fallback_scores(files: DataFrame) -> DataFrame:
    """Score from name and path alone."""
    low, where = F.lower(F.col("name")), F.lower(F.col("path"))

    def points(value, words):
        total = F.lit(0)
        for word in words:
            total = total + F.when(F.contains(value, F.lit(word)), 5).otherwise(0)
        return total

    main = F.lit(False)
    for language, names in MAIN_FILES.items():
        main = main | ((F.col("language") == language) & low.isin(*names))
    score = points(low, FALLBACK_WORDS) + F.when(main, 20).otherwise(0) \
        + points(where, FOLDER_WORDS)
    return files.select(*KEYS, score.alias("score"), F.col("size_bytes").alias("size"))


def _ranked(scores: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("project_id").orderBy(F.desc("score"), "path")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_files(scores: DataFrame, n: int = TOP_FILES, enough: int = ENOUGH_SCORED) -> DataFrame:
    """The ``n`` best files of every project with at least ``enough`` scored files."""
    best = _ranked(scores.select(*KEYS, "score"), n)
    kept = W.partitionBy("project_id")
    return best.withColumn("_n", F.count("*").over(kept)).where(F.col("_n") >= enough).drop("_n")


def fallback_files(scores: DataFrame, n: int = TOP_FILES) -> DataFrame:
    return _ranked(scores.select(*KEYS, "score"), n)


def append_missing(selected: DataFrame, scored: DataFrame) -> DataFrame:
    """``selected(project_id, path, ord)`` in order, then the scored files not in it, best first.

    A project of any size is ranked in ranges of its rows; they are written when this is called.
    """
    both = scored.select(*KEYS, "score").join(
        selected.select(*KEYS, F.col("ord").alias("given")), KEYS, "full")
    order = [F.asc_nulls_last("given"), F.desc_nulls_last("score"), F.asc("path")]
    return ranked(both, ["project_id"], order, "ord").select(*KEYS, "ord")


# --- project context --------------------------------------------------------------------------

def entry_kinds(content: Column) -> Column:
    """How a file starts something; both ways are possible."""
    return F.array_compact(F.array(
        F.when(F.contains(content, F.lit("main("))
               | F.contains(content, F.lit("public static void main")), F.lit("main")),
        F.when(F.contains(content, F.lit("app.listen"))
               | F.contains(content, F.lit("runserver")), F.lit("server"))))


def entry_points(files: DataFrame) -> DataFrame:
    """Files that start something; a file that does it both ways appears twice."""
    return files.select(*KEYS, F.explode_outer(entry_kinds(F.col("content"))).alias("kind")) \
        .where(F.col("kind").isNotNull())


def with_context(files: DataFrame, context: DataFrame | None = None,
                 head_chars: int | None = None) -> DataFrame:
    """Files with purpose, endpoints, security words, hint and entry flag of their own content.

    ``context`` (one row per project) adds the project's frameworks and dependencies.
    """
    top = "content" if head_chars is None else f"left(content, {head_chars})"
    out = files.withColumn("security_patterns", security_words_in(F.expr(top))) \
        .withColumns({
            "purpose": purpose_of(F.col("path"), F.col("security_patterns")),
            "security_relevant": F.size("security_patterns") > 0,
            "endpoints": F.expr(scan_endpoints_of(top)),
            "hint": kind_hint(basename(F.col("path"))),
            "entry_point": F.size(entry_kinds(F.col("content"))) > 0,
        })
    return out if context is None else out.join(context, "project_id", "left")


# --- cross-file calls -------------------------------------------------------------------------

def call_names(files: DataFrame) -> DataFrame:
    """Distinct names followed by an opening parenthesis, per line."""
    names = f"array_distinct(regexp_extract_all(x, {text(word_regex(CALLED_NAME))}, 1))"
    body = (f"flatten(transform({lines_of('content')}, (x, i) -> transform({names}, n -> "
            + struct(line_no="i + 1", name="n") + ")))")
    return explode_structs(files, KEYS, F.expr(body))


def last_definitions(files: DataFrame) -> DataFrame:
    """One row per project and name: the definition that comes last by path, then position."""
    defs = definitions(files)
    return defs.groupBy("project_id", "name").agg(
        F.max_by(F.struct("path", "line_no", "kind"), F.struct("path", "def_ord")).alias("_d")
    ).select("project_id", "name", F.col("_d.path").alias("called_file"),
             F.col("_d.line_no").alias("called_line"), F.col("_d.kind").alias("called_kind"))


def cross_file_calls(files: DataFrame) -> DataFrame:
    """Lines calling a name whose (last) definition is in another file of the project.

    The definitions are written when this is called; calls of names that the project does not define are
    dropped where the text is read, by a bitmap of the defined names.
    """
    defined = written(last_definitions(files), "definitions")
    calls = only_wanted(call_names(files), defined, ["project_id", "name"]).withColumnsRenamed(
        {"path": "caller_file", "line_no": "caller_line"})
    return calls.join(defined, ["project_id", "name"]) \
        .where(F.col("caller_file") != F.col("called_file")) \
        .withColumnRenamed("name", "called_entity")


def first_cross_calls(calls: DataFrame, n: int = 5) -> DataFrame:
    order = W.partitionBy("project_id").orderBy("caller_file", "caller_line", "called_entity")
    return calls.withColumn("call_ord", F.row_number().over(order)).where(F.col("call_ord") <= n)


def cross_call_snippets(files: DataFrame, calls: DataFrame) -> DataFrame:
    """Caller lines (three around) and called lines (one before, six after) of few calls.

    The calls are written first. A bitmap of their places leaves out all other files where they are
    read, so no other content moves.
    """
    calls = written(calls, "calls")

    def snippets(path, line, before, after, name):
        places = calls.groupBy("project_id", F.col(path).alias("path")).agg(
            F.array_sort(F.collect_set(line)).alias("_want"))
        one = struct(line_no="n", snippet=window_text("l", "n", before, after))
        body = let({"l": lines_of("content")}, f"transform(_want, n -> {one})")
        wanted = only_wanted(files, places, KEYS).select(*KEYS, "content")
        return explode_structs(wanted.join(places, KEYS), KEYS, F.expr(body)) \
            .withColumnsRenamed({"path": path, "line_no": line, "snippet": name})

    caller = snippets("caller_file", "caller_line", 3, 3, "caller_code")
    called = snippets("called_file", "called_line", 1, 6, "called_code")
    return calls.join(caller, ["project_id", "caller_file", "caller_line"]) \
        .join(called, ["project_id", "called_file", "called_line"])
