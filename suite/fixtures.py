"""Tables derived from the given data, written once and rendered for Spark and for DuckDB.

Only portable arithmetic and string functions are used, so both engines hold the same rows at any
scale. The code corpus comes from ``lineitem``; repositories, responses and findings come from
``orders`` and ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.expressions import text

LANGUAGES = ("python", "javascript", "java", "golang")
EXTENSIONS = ("py", "js", "java", "go")

TEMPLATES = {
    "python": [
        '{a} = request.args.get("q")', '{a} = {c}.strip()', '{a} = html.escape({c})',
        'cursor.execute("SELECT " + {a})', 'os.system({a})', 'if ({a} == None):',
        'def {fn}({a}):', '{a} = {fn}({c})', 'import subprocess', 'password = "pw{p}"',
        'h = md5({a})', 'return html.escape({a})', '@app.route("/{c}")', '{a} = {c}',
        'validate({a})', '# {a}'],
    "javascript": [
        'let {a} = req.query.q;', 'let {a} = {c}.trim();', 'let {a} = escapeHTML({c});',
        'db.query("SELECT " + {a});', 'execSync({a});', 'if ({a} === null) return;',
        'function {fn}({a}) {', '{a} = {fn}({c});', "const fs = require('fs');",
        'const apiKey = "k{p}";', 'let h = Math.random();', 'return encodeURIComponent({a});',
        'app.get("/{c}", {fn});', '{a} = {c};', 'if ({a}.length > 3) {', 'el.innerHTML = {a};'],
    "java": [
        'String {a} = request.getParameter("q");', 'String {a} = {c}.trim();',
        'String {a} = escapeHtml({c});', 'stmt.executeQuery("SELECT " + {a});',
        'Runtime.getRuntime().exec({a});', 'if ({a} == null) return;',
        'public static String {fn}(String {a}) {', 'String {a} = {fn}({c});',
        'import java.io.File;', 'String secret = "s{p}";', 'Random r = new Random();',
        'return normalize({a});', '@GetMapping("/{c}")', '{a} = {c};', 'validate({a});',
        'out.print({a});'],
    "golang": [
        '{a} = req.body;', '{a} = {c};', '{a} = escapeHtml({c});', 'executeQuery({a});',
        'exec({a});', 'if ({a} == nil);', 'func {fn}({a}) {', '{a} = {fn}({c});', 'import fmt;',
        'token = "t{p}";', 'h = md5({a});', 'return {a};', 'route({c});', '{a} = {c};',
        'check({a});', 'http://{a}'],
}


def _duck(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _line_text(quote, pick, row: str = "", mark: str = "''") -> str:
    """Text of a line: template k of the language with its placeholders filled in.

    ``mark`` ends the names of variables.
    """
    part, supp = f"{row}l_partkey", f"{row}l_suppkey"
    table = [t for name in LANGUAGES for t in TEMPLATES[name]]
    index = f"lang_ix * 16 + ({part} * 7 + {supp} * 3) % 16"
    chosen = pick("[" + ", ".join(quote(t) for t in table) + "]", index)
    for hole, value in (("{a}", f"concat('v', {supp} % 12, {mark})"), ("{c}", f"concat('v', {part} % 11, {mark})"),
                        ("{fn}", f"concat('fn', {part} % 23)"),
                        ("{p}", f"cast({part} as varchar(20))")):
        chosen = f"replace({chosen}, {quote(hole)}, {value})"
    return chosen


def _cases(quote, value: str, names) -> str:
    whens = " ".join(f"when {i} then {quote(n)}" for i, n in enumerate(names))
    return f"case {value} {whens} end"


def _code_keys(quote) -> list[str]:
    return [
        "file_id", "file_id % 20 as project_id", "file_id % 4 as lang_ix",
        f"concat('p', file_id % 20, '/src/f', file_id, '.', "
        f"{_cases(quote, 'file_id % 4', EXTENSIONS)}) as path",
        f"{_cases(quote, 'file_id % 4', LANGUAGES)} as language"]


def _spark_pick(table: str, index: str) -> str:
    return f"element_at(array({table[1:-1]}), cast({index} as int) + 1)"


def _duck_pick(table: str, index: str) -> str:
    return f"({table})[cast({index} as integer) + 1]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(project_id, path, name, ext, language, size_bytes, content)``.

    Rows are spread by file as plain numbers and turned into text where they arrive, row by row, before they
    are gathered.
    """
    rows = read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8.0).cast("bigint").alias("file_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    numbers = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    texts = rows.repartition("file_id").withColumn("lang_ix", F.expr("file_id % 4")) \
        .select("file_id", *numbers, F.expr(_line_text(text, _spark_pick)).alias("line"))
    # the text is made of the numbers before it, so it never decides the order
    gathered = texts.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct(*numbers, "line"))).alias("rows")
    ).selectExpr("rows", *_code_keys(text))
    return gathered.select(
        "project_id", "path", "language", F.array_join("rows.line", "\n").alias("content"),
    ).select(
        "project_id", "path", F.substring_index("path", "/", -1).alias("name"),
        F.substring_index("path", ".", -1).alias("ext"), "language",
        F.octet_length("content").cast("bigint").alias("size_bytes"), "content")


DUCK_CODE = f"""
  raw_lines as materialized (
    select {', '.join(_code_keys(_duck)).replace('file_id % 4 as lang_ix, ', '')}, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           {_line_text(_duck, _duck_pick)} as text
    from (select *, file_id % 4 as lang_ix from (
      select l_orderkey, l_linenumber, l_partkey, l_suppkey,
             cast(floor(l_orderkey / 8.0) as bigint) as file_id from lineitem) a) b),
  code_lines as materialized (
    select project_id, path, language, text,
           cast(row_number() over (partition by file_id
                order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as integer) as line_no
    from raw_lines),
  code_files as materialized (
    select project_id, path, any_value(language) as language,
           string_agg(text, chr(10) order by line_no) as content,
           count(*) as n_lines
    from code_lines group by project_id, path)"""


LONG_MARK = "concat('f', {0}file_id, 'x')"
LONG_PATH = f"concat('p', project_id, '/all.', {_cases(text, 'project_id % 4', EXTENSIONS)}) as path"


def long_files(spark: SparkSession, sf_dir: str, in_parts: bool = False) -> DataFrame:
    """One file per project that holds the lines of all its files, each with variables of its own.

    ``in_parts`` gives a file as rows with a number ``part``, whose texts a newline joins, so no row holds a file.
    """
    numbers = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8.0).cast("bigint").alias("file_id"), *numbers)
    line = _line_text(text, _spark_pick, "r.", LONG_MARK.format(""))
    # the lines of one file become text first, so few rows move; lines without a text do not count
    parts = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*numbers))).alias("rows")) \
        .selectExpr("file_id", "rows", "file_id % 20 as project_id", "file_id % 20 % 4 as lang_ix") \
        .withColumn("lines", F.expr(f"filter(transform(rows, r -> {line}), l -> l is not null)")) \
        .select("project_id", F.expr(LONG_PATH), F.expr(f"{_cases(text, 'project_id % 4', LANGUAGES)} as language"),
                F.col("file_id").alias("part"),
                F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("content"))
    if in_parts:
        return parts
    return parts.groupBy("project_id", "path", "language").agg(
        F.array_sort(F.collect_list(F.struct("part", "content"))).alias("parts")).repartition("project_id").select(
        "project_id", "path", "language", F.array_join("parts.content", "\n").alias("content"))


# Python statements over several lines, with comments, defaults and aliases.
LONG_IMPORT = ("from sub.process import (run as go,  # fast\n    call,\n    check as ok)\n"
               "import os.path as osp, \\\n    sys")
LONG_HEAD = ",\n        limit=min(1, 2),  # most\n        *rest, key: str = ''):"

DUCK_LONG = f"""
  raw_lines as materialized (
    select project_id, {LONG_PATH}, {_cases(_duck, 'project_id % 4', LANGUAGES)} as language,
           file_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           {_line_text(_duck, _duck_pick, mark=LONG_MARK.format(''))} as text
    from (select *, file_id % 20 as project_id, file_id % 4 as lang_ix from (
      select l_orderkey, l_linenumber, l_partkey, l_suppkey,
             cast(floor(l_orderkey / 8.0) as bigint) as file_id from lineitem) a) b),
  code_lines as materialized (
    select project_id, path, language, text,
           cast(row_number() over (partition by project_id
                order by file_id, l_orderkey, l_linenumber, l_partkey, l_suppkey) as integer) as line_no
    from raw_lines),
  code_files as materialized (
    select project_id, path, any_value(language) as language,
           string_agg(text, chr(10) order by line_no) as content,
           count(*) as n_lines
    from code_lines group by project_id, path)"""


# --- repositories, manifests, findings, responses, project patterns ---------------------------

DIRS = ["src", "routes", "node_modules/x", "build", "auth", "api/controllers", "docs",
        ".git/hooks", "env", "lib", "src/main/java", "services", "models", "app/middleware",
        "test", "common/util"]
BASES = ["login", "index", "main", "app", "user_admin", "environment", "config", "Main",
         "Application", "server", "utils", "test_api", "router", "session.min", ".hidden",
         "README", "auth_controller", "sql_helper", "data", ""]
SUFFIXES = [".py", ".js", ".ts", ".java", ".go", ".rb", ".PY", ".min.js", ".png", ".json",
            ".yaml", ".php", ".html", ".txt"]
MANIFESTS = [
    ("package.json", '{"name":"a","dependencies":{"react":"1.{m}","left-pad":"2"},'
                     '"devDependencies":{"react":"9.{m}","jest":"3"}}'),
    ("package.json", '{"dependencies":{"express":"4.{m}","vue":"3"}}'),
    ("package.json", '{"dependencies": broken'),
    ("pom.xml", "<project><artifactId>spring-boot-starter</artifactId>spring-security</project>"),
    ("pom.xml", "spring-boot without the tag"),
    ("requirements.txt", "django=={m}"),
    ("requirements.txt", "flask\nrequests"),
    ("README.md", "About project {m}"),
    ("Gemfile", "gem 'rails'"),
]
TYPES = ["SQL Injection", "xss", "Command Injection", "hardcoded_credentials", "nosql_injection",
         "Path Traversal", "XSS (reflected)", "insecure_communication", "weak_crypto",
         "Unknown thing", "csrf", "Open Redirect", None, "xxe"]
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info", None]
RESPONSES = [
    '[{"line": {n}, "vulnerability_type": "SQL Injection", "description": "d", '
    '"severity": "High", "confidence": 0.9, "code_snippet": "x", "cwe_id": "", '
    '"data_flow": ["a","b"], "remediation": "r"}]',
    '[{"line": 3, "vulnerability_type": "xss"}, {"confidence": "0.8", "severity": "Low"}]',
    '{"line": 1}',
    'Here: [ {"line": {m}, "vulnerability_type": "csrf", "confidence": 0.6} ] done',
    'None found: []',
    'Vulnerability 1: bad\nLine {n} has SQL Injection. Issue 2: Line 4 and XSS',
    '  ',
    '[1, "x", {"line": 7}]',
    '[]',
    'nothing to say about {m}',
    '[{"line": 2, "vulnerability_type": "nosql_injection"}] trailing',
    '[{"line": 5, "vulnerability_type": "Unknown", "severity": "Critical"',
]
KINDS = ["custom_function", "data_transformation", "validation_function", "wrapper_function",
         "security_pattern"]
CATEGORIES = ["sanitization", "authentication", "other"]
IMPACTS = ["reads user data from a request", "executes a database query", "encode and sanitize",
           "unsafe and risky", "critical command execution", "validate and transform",
           "sensitive output render", None]


def _pick(quote, value: str, items) -> str:
    whens = " ".join(f"when {i} then {'null' if n is None else quote(n)}"
                     for i, n in enumerate(items))
    return f"case {value} {whens} end"


def _repo_sql(source: str, quote) -> str:
    return f"""
      select o_custkey % 50 as project_id,
             concat({_pick(quote, 'o_orderkey % 16', DIRS)}, '/d', o_orderkey, '/',
                    {_pick(quote, '(o_custkey + o_orderkey) % 20', BASES)},
                    {_pick(quote, '(o_orderkey * 7 + o_custkey * 3) % 14', SUFFIXES)}) as path,
             cast(floor(o_totalprice) as bigint) as size_bytes
      from {source}"""


def _manifest_sql(source: str, quote) -> str:
    filled = (f"replace({_pick(quote, 'ix', [c for _, c in MANIFESTS])}, '{{m}}', "
              "cast(o_orderkey % 7 as varchar(20)))")
    return f"""
      select o_custkey as project_id, {_pick(quote, 'ix', [n for n, _ in MANIFESTS])} as name,
             {filled} as content
      from (select *, o_orderkey % 9 as ix from {source}) a"""


def _finding_sql(source: str, quote) -> str:
    return f"""
      select file_id % 20 as project_id,
             case when l_suppkey % 97 = 0 then null else
               concat('p', file_id % 20, '/src/f', file_id, '.',
                      {_pick(quote, 'file_id % 4', EXTENSIONS)}) end as file,
             l_linenumber as line,
             {_pick(quote, 'l_partkey % 14', TYPES)} as vulnerability_type,
             concat('finding ', l_partkey) as description,
             {_pick(quote, 'l_suppkey % 6', SEVERITIES)} as severity,
             case when l_quantity > 48 then null
               else cast(round(l_discount * 100) as double) / cast(10 as double) end as confidence,
             concat('say "', l_suppkey, '", then') as code_snippet,
             case when l_partkey % 3 = 0 then 'CWE-1' end as cwe_id,
             'fix it' as remediation
      from (select *, cast(floor(l_orderkey / 8.0) as bigint) as file_id from {source}) a"""


def _response_sql(source: str, quote) -> str:
    filled = (f"replace(replace({_pick(quote, 'o_orderkey % 12', RESPONSES)}, '{{n}}', "
              "cast(o_orderkey as varchar(20))), '{m}', cast(o_custkey as varchar(20)))")
    return f"""
      select o_custkey % 50 as project_id, concat('f', o_orderkey, '.py') as path,
             {filled} as response
      from {source}"""


def _pattern_sql(source: str, quote) -> str:
    return f"""
      select p_partkey % 20 as project_id, {_pick(quote, 'p_size % 5', KINDS)} as kind,
             case when p_size % 5 = 4 then {_pick(quote, 'p_partkey % 3', CATEGORIES)} end as category,
             concat('fn', p_partkey % 23) as name,
             case when p_size % 5 = 0 then {_pick(quote, 'p_partkey % 8', IMPACTS)} end as impact,
             cast(p_partkey % 7 as integer) as file_ord, p_partkey as pattern_ord
      from {source}"""


PAGE_LINES = [
    '<form action="/a"><input type="password" name="p{n}"></form>',
    '<form action="/b"><input name="csrf" value="{n}"></form> <form><p>x</p></form>',
    'Set-Cookie: sid={n}; HttpOnly',
    'Set-Cookie: sid={n}; Secure; SameSite=Lax',
    '<script src="http://cdn.example.com/{n}.js"></script>',
    'var s = String.fromCharCode({n}); Object.prototype .x = 1; eval (s);',
    "window.location = base + '{n}'; document.cookie = 'a';",
    '<iframe src = "//x.example.com/{n}"> unsafe-inline',
    'plain {n}',
]


def _page_sql(source: str, quote) -> str:
    """Pages with one more line each, so that markup and script rules have something to find."""
    filled = f"replace({_pick(quote, 'page_id % 9', PAGE_LINES)}, '{{n}}', cast(page_id as varchar(20)))"
    return f"select page_id, concat(html, chr(10), {filled}) as html from {source}"


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "pages", ["page_id", "html"], _page_sql)


DUCK_PAGES = f"web_pages as ({_page_sql('pages', _duck)})"


def _derived(spark, sf_dir, table, columns, build) -> DataFrame:
    view = f"tracewell_{table}"
    read(spark, sf_dir, table).select(*columns).createOrReplaceTempView(view)
    return spark.sql(build(view, text))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing ``project_id, path, size_bytes`` from ``orders``."""
    return _derived(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"], _repo_sql)


def root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"], _manifest_sql)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"]
    rows = _derived(spark, sf_dir, "lineitem", columns, _finding_sql)
    return rows.withColumn("data_flow", F.array(F.lit("step1"), F.col("description")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"], _response_sql)


def project_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "part", ["p_partkey", "p_size"], _pattern_sql)


DUCK_REPO = f"repo_files as ({_repo_sql('orders', _duck)})"
DUCK_ROOT = f"root_files as ({_manifest_sql('orders', _duck)})"
DUCK_FINDINGS = f"findings as ({_finding_sql('lineitem', _duck)})"
DUCK_RESPONSES = f"responses as ({_response_sql('orders', _duck)})"
DUCK_PATTERNS = f"project_patterns as ({_pattern_sql('part', _duck)})"
