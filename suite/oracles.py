"""The same results in DuckDB SQL, written from the meaning of each operator.

Within-file work is done here with joins over line and fact tables (the library uses array
expressions on the file row), so the two sides share rule texts and fixtures only.
"""

from __future__ import annotations

from suite import fixtures as fx
from tracewell.functions import scalars as sc
from tracewell.operators import facts, match, project
from tracewell.plans import responses as rs
from tracewell.plans import report
from tracewell.rules.catalog import GENERIC, ROLES, literal_rules, regex_rules
from tracewell.rules.project import SECURITY_CATEGORIES
from tracewell.sources import corpus, manifests

q = fx._duck
WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
ORACLES: dict[str, str] = {}
KEY = "project_id, path"


def add(name, *ctes, body):
    recursive = "recursive " if any("with_recursion" in c for c in ctes) else ""
    head = f"with {recursive}" + ",\n".join(c.strip() for c in ctes) + "\n" if ctes else ""
    ORACLES[name] = head + body.strip()


def strip(x):
    return f"trim({x}, {WS})"


def contains_any(x, words):
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def case_map(x, table, default):
    whens = " ".join(f"when {x} = {q(k)} then {q(v)}" for k, v in table.items())
    return f"case {whens} else {default} end"


def find(pattern, groups, source="code_files", where="true", content="content", keys=None):
    """Every match of a pattern over whole texts with the line it starts on."""
    keys = keys or "project_id, path, language"
    p = q(pattern)
    marked = f"string_split(regexp_replace({content}, {p}, chr(1) || '\\0', 'g'), chr(10))"
    lines = (f"flatten(list_transform({marked}, lambda x, li: list_transform("
             "range(0, length(x) - length(replace(x, chr(1), ''))), lambda z: cast(li as integer))))")
    lists = ", ".join(f"regexp_extract_all({content}, {p}, {g}) as l_{n}" for n, g in groups.items())
    picks = ", ".join(f"l_{n}[m] as {n}" for n in groups)
    sep = ", " if groups else ""
    return f"""(select {keys}, cast(m as integer) as m, lns[m] as line_no{sep}{picks}
      from (select {keys}, {lines} as lns{sep}{lists} from {source} where {where}) t,
           unnest(range(1, len(lns) + 1)) as u(m))"""


def per_line(pattern, groups, where="true", source="code_lines"):
    """Every match of a pattern inside each line."""
    p = q(pattern)
    first = next(iter(groups))
    lists = ", ".join(f"regexp_extract_all(text, {p}, {g}) as l_{n}" for n, g in groups.items())
    picks = ", ".join(f"l_{n}[m] as {n}" for n in groups)
    return f"""(select project_id, path, language, line_no, text, cast(m as integer) as m, {picks}
      from (select *, {lists} from {source} where {where}) t,
           unnest(range(1, len(l_{first}) + 1)) as u(m))"""


def after_equals(x):
    return f"case when contains({x}, '=') then {strip(f'substr({x}, strpos({x}, {q(chr(61))}) + 1)')} else '' end"


def parts(x):
    """Comma-separated text as stripped, non-empty parts."""
    return f"list_filter(list_transform(string_split({x}, ','), lambda v: {strip('v')}), lambda v: v <> '')"


def window(k, after=None):
    return (f"string_agg(text, chr(10)) over (partition by path order by line_no rows between "
            f"{k} preceding and {k if after is None else after} following)")


CODE = fx.DUCK_CODE
GROUPED = f"(case when language in ('python','javascript','java') then language else '{GENERIC}' end)"

# --- scans and sources ------------------------------------------------------------------------

IGNORE = "|".join(f"(?:{p})" for p in corpus.IGNORE_PATTERNS)
ANCHORED = "|".join(f"(?:{p})" if p.endswith("$") else f"(?:^(?:{p})$)" for p in corpus.IGNORE_PATTERNS)
NAME = "string_split(path, '/')[-1]"
BARE = f"ltrim({NAME}, '.')"
EXT = f"(case when contains({BARE}, '.') then string_split({BARE}, '.')[-1] else '' end)"


def ignored(pattern):
    dirs = "array_to_string(string_split(path, '/')[1:-2], '/')"
    return (f"(len(list_filter(string_split(path, '/'), lambda p: regexp_matches(p, {q(pattern)}))) > 0 "
            f"or regexp_matches({dirs}, {q(pattern)}))")


LANG = case_map("ext", sc.LANGUAGE_OF, "null")
SCANNED = f"""scanned as (select project_id, path, name, ext, size_bytes, {LANG} as language
  from (select *, {NAME} as name, {EXT} as ext from repo_files) r where not {ignored(IGNORE)})"""

add("src_01_corpus_scan", fx.DUCK_REPO, SCANNED, body="""
select project_id, path, ext as type, size_bytes, language from scanned
where language is not null and size_bytes <= 100000""")
add("src_01_packed_corpus", fx.DUCK_REPO, SCANNED, body="""
select cast(project_id as varchar) as project_id, path, ext, size_bytes % 300 * 3 as size_bytes, language,
       cast(size_bytes % 300 * 2 as integer) as chars from scanned
where language is not null and size_bytes % 300 between 1 and 200""")
add("src_02_ignore_filter", fx.DUCK_REPO, body=f"""
select project_id, path, {ignored(IGNORE)} as ignored, {ignored(ANCHORED)} as ignored_anchored
from repo_files""")
add("src_03_language", fx.DUCK_REPO, body=f"""
select ext, coalesce({LANG}, 'unknown') as language, count(*) as files
from (select {EXT} as ext from repo_files) t group by all""")
add("src_04_file_cap", fx.DUCK_REPO, SCANNED, body="""
select project_id, path, size_bytes from scanned
where language is not null and size_bytes <= 300000
qualify row_number() over (partition by project_id order by path) <= 20""")
add("src_05_all_source_files", fx.DUCK_REPO, SCANNED, body="""
select project_id, count(*) as files, min(path) as first_path from scanned
where language is not null group by project_id""")
add("src_06_decode", body="""
select doc_id, md5(t) as digest, length(t) as chars
from (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) as t
      from documents) d""")
add("src_07_head", body="""
select doc_id, md5(substr(text, 1, 10240)) as digest, length(substr(text, 1, 10240)) as chars
from documents""")
DEPENDENCIES = """
dev as (select project_id, content, unnest(json_keys(content, '$.devDependencies')) as dependency
        from root_files where name = 'package.json' and json_valid(content)),
plain as (select project_id, content, unnest(json_keys(content, '$.dependencies')) as dependency
          from root_files where name = 'package.json' and json_valid(content)),
deps as (
  select project_id, dependency, json_extract_string(content, '$.devDependencies."' || dependency || '"') as version from dev
  union all
  select project_id, dependency, json_extract_string(content, '$.dependencies."' || dependency || '"') as version
  from plain where json_extract(content, '$.devDependencies."' || dependency || '"') is null)"""
add("src_08_dependencies", fx.DUCK_ROOT, DEPENDENCIES, body="""
select project_id, dependency, version, count(*) as files from deps group by all""")

# --- projections ------------------------------------------------------------------------------

add("prj_01_lines", CODE, body="select project_id, path, line_no, text from code_lines")
add("prj_01_document_lines", body="""
select cast(doc_id as varchar) as path, len(l) as lines, len(l) as last_line,
       list_sum(list_transform(l, lambda x: length(x))) as chars
from (select doc_id, string_split(text, chr(10)) as l from documents) t""")
DOCS = "docs as (select 0 as project_id, cast(doc_id as varchar) as path, 'unknown' as language, text as content from documents)"
PAGES = "docs as (select 0 as project_id, cast(page_id as varchar) as path, 'html' as language, html as content from web_pages)"
add("prj_02_match_line", DOCS, body=f"""
select path, line_no, count(*) as matches, min(hit) as first_text
from {find(r'\.\s+[A-Z]\w*', {'hit': 0}, 'docs')} f group by all""")
add("prj_03_04_snippet_context", CODE, body=f"""
select project_id, path, line_no, {strip('text')} as code, context
from (select *, {window(2)} as context from code_lines) l where contains(text, 'return')""")
add("prj_06_cwe", fx.DUCK_FINDINGS,
    "cwes(ord, k, v) as (values " + ", ".join(
        f"({i}, {q(k)}, {q(v)})" for i, (k, v) in enumerate(sc.CWE_OF.items())) + ")",
    body="""
select vulnerability_type,
       coalesce((select v from cwes where k = key), (select arg_min(v, ord) from cwes where contains(key, k) or contains(k, key))) as cwe,
       count(*) as findings
from (select coalesce(vulnerability_type, 'none') as vulnerability_type,
             replace(lower(coalesce(vulnerability_type, 'none')), ' ', '_') as key from findings) f
group by vulnerability_type, key""")
SEVERITY = "case " + " ".join(
    f"when {contains_any('key', ws)} then {q(level)}" for level, ws in sc.SEVERITY_WORDS.items()) + " else 'Low' end"
add("prj_07_severity", fx.DUCK_FINDINGS, body=f"""
select vulnerability_type, {SEVERITY} as severity_class, count(*) as findings
from (select coalesce(vulnerability_type, 'none') as vulnerability_type,
             replace(lower(coalesce(vulnerability_type, 'none')), ' ', '_') as key from findings) f
group by all""")
add("prj_08_09_buckets", fx.DUCK_FINDINGS, body="""
select case when coalesce(confidence, 0.5) >= 0.8 then 'high'
            when coalesce(confidence, 0.5) >= 0.5 then 'medium' else 'low' end as bucket,
       case coalesce(severity, 'Medium') when 'Critical' then 'critical' when 'High' then 'high'
            when 'Medium' then 'medium' else 'low' end as css_class,
       count(*) as findings
from findings group by all""")
PURPOSE = "case " + " ".join(
    f"when {contains_any('lower(path)', ws)} then {q(p)}" for p, ws in sc.PURPOSE_WORDS.items())
add("prj_10_purpose", fx.DUCK_REPO, body=f"""
select project_id, path, {PURPOSE} else 'Unknown' end as purpose from repo_files""")
add("prj_11_paths", fx.DUCK_REPO, body=f"""
select project_id, path, {NAME} as base,
       '/r/' || array_to_string(string_split(path, '/')[1:-2], '/') || '/x' as normal
from repo_files""")
add("prj_12_shorten", body=f"""
select doc_id, length(t) as chars, md5(t) as digest
from (select doc_id, case when length(text) > 12000
        then substr(text, 1, 6000) || {q(sc.TRUNCATED)} || substr(text, length(text) - 5999)
        else text end as t from documents) d""")
add("prj_13_fingerprint", CODE, body="select path, md5(path || md5(content)) as file_hash from code_files")
HINT = "case " + " ".join(
    f"when lower(ext) in ({', '.join(q(e) for e in k)}) then {q(v)}" for k, v in sc.HINT_OF.items()) + " else '' end"
add("prj_15_kind_hint", fx.DUCK_REPO, body=f"""
select {HINT} as hint, count(*) as files from (select {EXT} as ext from repo_files) t group by all""")

# --- filters ----------------------------------------------------------------------------------

add("flt_01_confidence", fx.DUCK_FINDINGS, body="""
select project_id, count(*) as kept, min(confidence) as lowest from findings
where coalesce(confidence, 0) >= 0.7 group by all""")
add("flt_02_report_filter", fx.DUCK_FINDINGS, body="""
select project_id, coalesce(vulnerability_type, 'Unknown') as vulnerability_type, count(*) as findings
from findings where severity = 'High' and coalesce(confidence, 0.5) >= 0.8 group by all""")
WORDS = "[" + ", ".join(q(w) for w in sc.SECURITY_WORDS) + "]"
add("flt_03_security_words", body=f"""
select doc_id, array_to_string(w, ',') as words, len(w) > 0 as relevant
from (select doc_id, list_filter({WORDS}, lambda k: contains(lower(text), k)) as w from documents) t""")
add("flt_04_substring", CODE, body="""
select project_id, count(*) as lines from code_lines where contains(text, 'escape(') group by all""")
add("flt_05_regex", CODE, body=f"""
select project_id, count(*) as lines from code_lines
where regexp_matches(text, {q("(?i)password" + chr(92) + "s*=" + chr(92) + "s*['" + chr(34) + "][^'" + chr(34) + "]+['" + chr(34) + "]")}) group by all""")

# --- fact extraction --------------------------------------------------------------------------


def listed(branches, name):
    """Distinct captured texts per file, sorted, per language."""
    whens = []
    for keys, patterns in branches.items():
        lists = [f"regexp_extract_all(head, {q(p)}, {g})" for p, g in patterns]
        joined = " || ".join(lists)
        whens.append(f"when language in ({', '.join(q(k) for k in keys)}) then {joined}")
    return (f"{name} as (select project_id, path, language, list_sort(list_distinct(list_transform("
            f"case {' '.join(whens)} else [] end, lambda v: {strip('v')}))) as v "
            "from (select *, content as head from code_files) h)")


ONE = {k: [(p, 1) for p in ps] for k, ps in project.IMPORTS.items()}
IMPORTS = listed(ONE, "imps")
ENDPOINTS = listed(project.ENDPOINTS, "ends")


def critical(shape):
    return [("(?i)" + shape.format(w), 0) for w in project.CRITICAL_WORDS]


OTHER = "golang"
CRITICAL = listed({
    facts.JS: critical(r"function\s+\w*({})\w*\s*\("), ("python",): critical(r"def\s+\w*({})\w*\s*\("),
    ("java",): critical(r"\w+\s+\w*({})\w*\s*\([^)]*\)"), (OTHER,): critical(r"\w+\s+\w*({})\w*\s*\("),
}, "crit")
for query_name, cte, table, column in (
    ("ext_01_imports", IMPORTS, "imps", "imports"), ("ext_02_endpoints", ENDPOINTS, "ends", "endpoints"),
    ("ext_04_critical_functions", CRITICAL, "crit", "critical_functions")):
    add(query_name, CODE, cte, body=f"""
select project_id, path, case when len(v) > 0 then array_to_string(v, ' | ') end as {column} from {table}""")
SCAN_ENDS = "case " + " ".join(
    f"when language in ({', '.join(q(k) for k in keys)}) then regexp_extract_all(content, {q(p)}, {g})"
    for keys, (p, g) in project.SCAN_ENDPOINTS.items()) + " else [] end"
add("ext_03_scan_endpoints", CODE, body=f"""
select project_id, path, array_to_string(v, ' | ') as endpoints,
       {PURPOSE} when {contains_any('lower(content)', sc.SECURITY_WORDS)} then 'Security-Related' else 'Unknown' end as purpose
from (select *, {SCAN_ENDS} as v from code_files) t""")
ENTRIES = """entries as (
  select project_id, path, 'main' as kind from edited where contains(content, 'main(')
    or contains(content, 'public static void main')
  union all select project_id, path, 'server' from edited
  where contains(content, 'app.listen') or contains(content, 'runserver'))"""
add("ext_05_entry_points", CODE, """edited as (select project_id, path,
  replace(replace(replace(content, 'String fn5(', 'void main ('), 'fn2(', 'main('), 'route(', 'app.listen(')
  as content from code_files)""",
    ENTRIES, body="select * from entries")
FRAMEWORKS = "fw as (" + " union ".join(
    [f"select project_id, dependency as framework, version from deps where dependency in ({', '.join(q(n) for n in manifests.PACKAGE_FRAMEWORKS)})"]
    + [f"select project_id, {q(n)}, 'true' from root_files where name = 'pom.xml' and contains(content, '<artifactId>') and contains(content, {q(n)})" for n in manifests.POM_FRAMEWORKS]
    + [f"select project_id, {q(n)}, 'true' from root_files where name = 'requirements.txt' and contains(content, {q(n)})" for n in manifests.REQUIREMENT_FRAMEWORKS]) + ")"
add("ext_06_frameworks", fx.DUCK_ROOT, DEPENDENCIES, FRAMEWORKS, body="select * from fw")
add("ext_07_captured", CODE, body=f"""
select project_id, path, array_to_string(list_filter(list_transform(
  regexp_extract_all(content, {q(chr(40) + chr(92) + 'w*)' + chr(92) + 's*=[^=]')}, 1), lambda v: {strip('v')}), lambda v: v <> ''), ' | ') as names
from code_files""")
JS_WHERE = "language in ('javascript','typescript')"
add("ext_08_js_facts", CODE, body=f"""
select path, m as ord, line_no, 'decl' as fact, kd as kind, nm as name, {strip('vl')} as value
from {find(facts.JS_DECLARATION, dict(kd=1, nm=2, vl=3), where=JS_WHERE)} a
union all
select path, m, line_no, 'assign', '', lf, {strip('rt')}
from {find(facts.ANY_ASSIGNMENT, dict(lf=1, rt=2), where=JS_WHERE)} b""")
JAVA = "language = 'java'"


def java_defs(source):
    return f"""java_defs as (
  select *, row_number() over (partition by path order by part, m) as def_ord from (
    select 0 as part, project_id, path, m, line_no, 'class' as kind, nm as name, md as modifier,
           false as is_static, '' as result_type, '' as pr, ex, im, '' as th
    from {find(facts.JAVA_CLASS, dict(md=1, nm=2, ex=3, im=4), source, JAVA)} c
    union all
    select 1, project_id, path, m, line_no, 'method', nm, md, st <> '', rt, pr, '', '', th
    from {find(facts.JAVA_METHOD, dict(md=1, st=2, rt=3, nm=4, pr=5, th=6), source, JAVA)} d) u)"""


JAVA_DEFS = java_defs("code_files")
# Lines that hold what the templates lack: class heads, exceptions, fields.
JAVA_FILES = f"""java_files as (select project_id, path, language, replace(replace(replace(content,
  'import java.io.File;', 'public class Kind extends Base implements One, Two {{'),
  ') {{', ') throws Bad, Worse {{'), 'Random r =', 'private static final Random r =') as content
  from code_files where {JAVA})"""


def words(i):
    one = f"coalesce(list_filter(regexp_split_to_array(v, '[ \\t\\n\\r]+'), lambda w: w <> '')[{i}], '')"
    return f"array_to_string(list_transform({parts('pr')}, lambda v: {one}), ' | ')"


add("ext_09_java_facts", CODE, JAVA_FILES, java_defs("java_files"), body=f"""
select path, def_ord as ord, line_no, kind, name, modifier, is_static, result_type,
       {words(1)} as param_types, {words(2)} as param_names, coalesce(ex, '') as extends,
       array_to_string({parts('im')}, ' | ') as implements, array_to_string({parts('th')}, ' | ') as throws
from java_defs""")
add("ext_09_java_variables", CODE, JAVA_FILES, body=f"""
select path, line_no, 'variable' as kind, ty as var_type, nm as name, coalesce({strip('vl')}, '') as value
from {find(facts.TYPED_VARIABLE, dict(ty=1, nm=2, vl=3), "java_files")} v
union all
select path, line_no, 'field', ty, nm, coalesce({strip('vl')}, '')
from {find(facts.JAVA_FIELD, dict(ty=4, nm=5, vl=6), "java_files")} f""")
GO = "language = 'golang'"
add("ext_10_generic_facts", CODE, body=f"""
select path, line_no, 'decl' as fact, ty as kind, nm as name, coalesce({strip('vl')}, '') as value
from {find(facts.TYPED_VARIABLE, dict(ty=1, nm=2, vl=3), where=GO)} v
union all
select path, line_no, 'def', coalesce(rt, ''), nm, array_to_string({parts('pr')}, ' | ')
from {find(facts.GENERIC_FUNCTION, dict(rt=1, nm=2, pr=3), where=GO)} f""")
PY = "language = 'python'"
PY_ASSIGNS = f"py_assigns as (select project_id, path, line_no, m, nm, {after_equals(strip('text'))} as value from {per_line(facts.PY_ASSIGNMENT, dict(nm=1), PY)} a)"
PY_DEFS = f"py_defs as (select project_id, path, line_no, kd, nm, pr from {per_line(facts.PY_DEFINITION, dict(kd=1, nm=2, pr=3), PY)} a)"
add("ext_11_python_facts", CODE, PY_ASSIGNS, PY_DEFS, body=f"""
select path, line_no, 'assign' as fact, nm as name, value from py_assigns
union all select path, line_no, 'def', nm, array_to_string({parts('pr')}, ' | ') from py_defs
union all select path, line_no, 'import', '', array_to_string({parts('nm')}, ' | ')
from {per_line(facts.PY_IMPORT, dict(nm=1), PY)} i
union all select path, line_no, 'import', md, array_to_string({parts('nm')}, ' | ')
from {per_line(facts.PY_FROM, dict(md=1, nm=2), PY)} i""")

def names_of(x, pattern):
    """Imported names, or aliases, of a list with comments and continued lines."""
    clean = f"regexp_replace({x}, {q(facts.PY_COMMENT)}, ' ', 'g')"
    each = f"list_filter(list_transform(string_split({clean}, ','), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"array_to_string(list_transform({each}, lambda p: regexp_extract(p, {q(pattern)}, 1)), ' | ')"


def _escaped(x):
    return " || chr(10) || ".join(q(part) for part in x.split("\n"))


def python_statements(long_import, long_head):
    flat = f"regexp_replace(regexp_replace(pr, {q(facts.PY_COMMENT)}, ' ', 'g'), {q(facts.PY_NESTED)}, ' ', 'g')"
    head = strip(f"regexp_extract(p, {q('^([^:=]*)')}, 1)")
    params = (f"array_to_string(list_filter(list_transform(string_split({flat}, ','), lambda p: {head}), "
              "lambda p: regexp_matches(p, '^[A-Za-z_]')), ' | ')")
    name, alias = r"^([\w.*]+)", r"\sas\s+(\w+)"
    parts_ = [f"""select path, line_no, 'import' as fact, {module} as name, {names_of('nm', name)} as parts,
      {names_of('nm', alias)} as aliases from {find(p, groups, source="edited", where=PY)} a""" for p, groups, module in (
        (facts.PY_IMPORT, dict(nm=1), "''"), (facts.PY_FROM, dict(md=1, nm=2), "md"),
        (facts.PY_FROM_LIST, dict(md=1, nm=2), "md"))]
    parts_.append(f"""select path, line_no, 'def', nm, case when kd = 'def' then {params} else '' end, ''
      from {find(facts.PY_DEFINITION, dict(kd=1, nm=2, pr=3), source="edited", where=PY)} d""")
    edited = f"""edited as (select project_id, path, language, replace(replace(content, 'import subprocess',
  {_escaped(long_import)}), '):', {_escaped(long_head)}) as content from code_files)"""
    add("ext_11_python_statements", CODE, edited, body="\nunion all ".join(parts_))


python_statements(fx.LONG_IMPORT, fx.LONG_HEAD)

CODED = f"coded as (select project_id, path, line_no, {strip('text')} as code from code_lines)"
JS_VALUE = f"regexp_replace({after_equals('code')}, ';$', '')"
EVENTS = f"""ev0 as (
  select project_id, path, 0 as part, m, line_no, nm, true as is_decl, null as value
  from {find(facts.JS_DECLARATION, dict(nm=2), where=JS_WHERE)} a
  union all select project_id, path, 1, m, line_no, nm, false, null
  from {find(facts.ANY_ASSIGNMENT, dict(nm=1), where=JS_WHERE)} b
  union all select project_id, path, 0, m, line_no, nm, true, {strip('vl')}
  from {find(facts.TYPED_VARIABLE, dict(nm=2, vl=3), where=JAVA)} c
  union all select project_id, path, 0, line_no * 1000 + m, line_no, nm, false, null from py_assigns
  union all select project_id, path, 0, line_no * 1000 + m, line_no, nm, false, {strip('vl')}
  from {per_line(facts.LINE_ASSIGNMENT, dict(nm=1, vl=2), GO)} e),
ev as (
  select e.project_id, e.path, e.line_no, e.nm as name, e.is_decl, c.code as initializer,
         coalesce(e.value, case when e.path like '%.js' then {JS_VALUE} else {after_equals('code')} end) as value,
         row_number() over (partition by e.path order by part, m) as idx
  from ev0 e join coded c on c.path = e.path and c.line_no = e.line_no),
evf as (select *, min(idx) over (partition by path, name) as fp from ev),
vars as (select project_id, path, name, line_no, initializer, value as assigned_value, idx, fp,
                cast(row_number() over (partition by path order by idx) as integer) as var_ord
         from evf where is_decl or idx = fp),
laters as (select e.project_id, e.path, e.name, e.line_no, e.value, e.idx, v.var_ord
           from evf e join vars v on v.path = e.path and v.idx = e.fp
           where not e.is_decl and e.idx <> e.fp)"""
VARS = (CODE, CODED, PY_ASSIGNS, EVENTS)
add("ext_12_variables", *VARS, body="""
select project_id, path, var_ord, name, line_no, initializer, assigned_value,
       (select count(*) from laters l where l.path = v.path and l.var_ord = v.var_ord) as later
from vars v""")
add("ext_13_usages", *VARS, body=f"""
select v.project_id, v.path, v.var_ord, v.name, l.line_no, {strip('l.text')} as context
from vars v join code_lines l on l.path = v.path
where l.language = 'golang' and contains(l.text, v.name)
  and not contains(l.text, v.name || ' =') and not contains(l.text, v.name || '=')""")
KEYWORDS = ", ".join(q(k) for k in facts.PY_KEYWORDS)
PY_NAMES = (f"list_filter(regexp_extract_all(regexp_replace(text, {q(facts.PY_HEADING)}, ' ', 'g'), "
            f"{q(facts.PY_CALL)}, 1), lambda f: f not in ({KEYWORDS}))")
CALLS = f"""calls0 as (
  select project_id, path, m as o, line_no,
         case when language = 'java' then string_split(cl, '.')[-1] else cl end as function,
         array_to_string({parts('ar')}, ' | ') as args
  from {find(facts.ANY_CALL, dict(cl=1, ar=2), where="language <> 'python'")} a
  union all
  select project_id, path, line_no * 1000 + i, line_no,
         case when len(string_split(fs[i], '.')) <= 2 then string_split(fs[i], '.')[-1]
              else regexp_extract(text, {q(facts.PY_CALL)}, 1) end, ''
  from (select *, {PY_NAMES} as fs from code_lines
        where language = 'python' and not starts_with(ltrim(text), '#')) p, unnest(range(1, len(fs) + 1)) u(i)),
calls as (select a.project_id, a.path, a.line_no, a.function, a.args, c.code,
                 cast(row_number() over (partition by a.path order by o) as integer) as call_ord
          from calls0 a join coded c on c.path = a.path and c.line_no = a.line_no)"""
add("ext_14_calls", CODE, CODED, CALLS, body="""
select project_id, path, call_ord, line_no, function, args, code from calls""")
DEFS = f"""defs as (
  select project_id, path, line_no, name, cast(def_ord as integer) as def_ord from java_defs
  union all select project_id, path, line_no, nm, m
  from {find(facts.JS_FUNCTION, dict(nm=1), where=JS_WHERE)} a
  union all select project_id, path, line_no, nm, m
  from {find(facts.GENERIC_FUNCTION, dict(nm=2), where=GO)} b
  union all select project_id, path, line_no, nm,
    cast(row_number() over (partition by path order by line_no) as integer) from py_defs)"""
add("ext_15_definitions", CODE, JAVA_DEFS, PY_DEFS, DEFS, body="""
select project_id, path, def_ord, line_no, name from defs""")

# --- rules and matching -----------------------------------------------------------------------


def has(words):
    return contains_any("lower(coalesce(impact, ''))", words)


MERGED = f"""merged as (
  select project_id, kind, category, name,
         arg_max(coalesce(impact, ''), file_ord * 1000000000000 + pattern_ord) as impact
  from project_patterns
  where (kind <> 'security_pattern'
        or category in ({', '.join(q(c) for c in SECURITY_CATEGORIES)}))
  group by all)"""
RUNS = f"(kind = 'custom_function' and {has(['execute', 'query', 'sensitive', 'critical'])})"
EASED = f"(kind = 'custom_function' and {has(['validation', 'sanitize', 'secure', 'transform', 'encode'])})"
CUSTOM = f"""custom as (
  select project_id, 'source' as role, 'custom_input' as rule_type, name from merged
  where kind = 'custom_function' and {has(['input', 'user data', 'request'])}
  union all
  select project_id, 'sink', kindof, name from (select *,
    case when {has(['sql', 'database'])} then 'custom_sql'
         when {has(['command', 'exec'])} then 'custom_command'
         when {has(['output', 'render'])} then 'custom_output' end as kindof from merged where {RUNS}) s
  where kindof is not null
  union all select project_id, 'sanitizer', 'custom_sanitization', name from merged
  where {EASED} and {has(['sanitize', 'validate'])}
  union all select project_id, 'sanitizer', 'custom_validation', name from merged where kind = 'validation_function'
  union all select project_id, 'sanitizer', 'custom_sanitization', name from merged
  where kind = 'security_pattern' and category = 'sanitization'
  union all select project_id, 'suspicious', 'custom_suspicious', name from merged
  where kind = 'custom_function' and {has(['unsafe', 'vulnerable', 'risky'])}
  union all select project_id, 'validation', 'validation', name from merged where kind = 'validation_function'
  union all select project_id, 'wrapper', 'wrapper', name from merged where kind = 'wrapper_function'
  union all select project_id, 'transform', 'transform', name from merged where kind = 'data_transformation')"""
add("rul_04_custom_rules", fx.DUCK_PATTERNS, MERGED, CUSTOM, body="""
select project_id, role, rule_type, name from custom""")
add("rul_05_merged_patterns", fx.DUCK_PATTERNS, MERGED, body="""
select project_id, kind, coalesce(category, '') as category, name,
       case when kind = 'custom_function' then impact else '' end as impact from merged""")


def scan(rules, source="code_files", where="true"):
    """All matches of a list of rules over whole texts, with the line each starts on."""
    out = []
    for r in rules:
        pattern = ("(?i)" if r.ignore_case else "") + r.pattern
        out.append(f"""select {KEY}, {q(r.rule_type)} as rule_type, line_no, {q(r.pattern)} as pattern
          from {find(pattern, {}, source, f"{where} and regexp_matches(content, {q(pattern)})")} x""")
    return "\nunion all\n".join(out)


QUICK = "issues as (" + scan(regex_rules("common")) + "".join(
    "\nunion all\n" + scan(regex_rules(p), where=f"language = '{p}'")
    for p in ("java", "javascript", "python")) + ")"
add("mat_01_quick_scan", CODE, CODED, QUICK, body="""
select i.project_id, i.path, rule_type, i.line_no, pattern, code
from issues i join coded c on c.path = i.path and c.line_no = i.line_no""")
add("mat_01_documents", DOCS, "issues as (" + scan(regex_rules("common"), "docs") + ")", body="""
select path, rule_type, pattern, count(*) as matches, min(line_no) as first_line
from issues group by all""")
LOOKING = [r for r in regex_rules("web") if "(?!" in r.pattern]
AHEAD = []
for r in LOOKING:
    if r.pattern.startswith("Set-Cookie"):
        word = r.pattern.split("(?!.*")[1][:-1]
        AHEAD.append(f"""
    select project_id, path, {q(r.rule_type)} as rule_type, cast(li as integer) as line_no, {q(r.pattern)} as pattern
    from (select *, string_split(content, chr(10)) as ls from docs) d, unnest(range(1, len(ls) + 1)) u(li),
         unnest(range(2, len(regexp_split_to_array(ls[li], '(?i)Set-Cookie:')) + 1)) w(k)
    where not contains(lower(array_to_string(regexp_split_to_array(ls[li], '(?i)Set-Cookie:')[k:], 'set-cookie:')), {q(word.lower())})""")
    else:
        AHEAD.append(f"""
    select project_id, path, {q(r.rule_type)}, line_no, {q(r.pattern)}
    from {find(r'(?i)<form[^>]*>[^' + chr(10) + r']*?</form>', {'hit': 0}, 'docs')} f
    where not regexp_matches(regexp_replace(hit, '(?i)^<form[^>]*>', ''), '(?i)csrf|token|nonce')""")
add("mat_02_web_scan", fx.DUCK_PAGES, PAGES,
    "issues as (" + scan([r for r in regex_rules("web") if r not in LOOKING], "docs")
    + "".join("\nunion all" + a for a in AHEAD) + ")", body="""
select path, rule_type, pattern, count(*) as matches, min(line_no) as first_line
from issues group by all""")

RULES = "rules(grp, role, rule_type, rule_ord, pattern) as (values " + ", ".join(
    f"({q(g)}, {q(r.role)}, {q(r.rule_type)}, {r.rule_ord}, {q(r.pattern)})"
    for g in ("java", "javascript", "python", GENERIC) for role in ROLES
    for r in literal_rules(g, role)) + ")"
ASSIGNED = r"regexp_extract(code, '(\w+)\s*=\s*.*\Q' || pattern || '\E', 1)"
FIRST_ARG = strip(r"string_split(regexp_extract(code, '\Q' || regexp_replace(pattern, '\($', '') || '\E\s*\(([^)]+)\)', 1), ',')[1]")
HITS = f"""ctx2 as (select *, {strip('text')} as code, {window(2)} as context,
  {GROUPED} as grp from code_lines),
hits as (select l.project_id, l.path, l.line_no, l.text, l.code, l.context, r.role, r.rule_type,
                r.rule_ord, r.pattern,
                row_number() over (partition by l.path order by l.line_no, r.rule_ord) as hit_ord
         from ctx2 l join rules r on r.grp = l.grp and contains(l.text, r.pattern))"""
for query_name, role in (("mat_03_sources", "source"), ("mat_04_sinks", "sink")):
    add(query_name, CODE, RULES, HITS, body=f"""
select project_id, path, line_no, rule_type as {role}_type, code as {role}_code,
       pattern as {role}_pattern, context from hits where role = '{role}'""")
SANITIZERS = f"""sanitizers as (
  select project_id, path, line_no, rule_type, code, pattern, context, hit_ord,
         coalesce(nullif({ASSIGNED}, ''), nullif({FIRST_ARG}, ''), '') as sanitized_variable
  from hits where role = 'sanitizer')"""
add("mat_05_sanitizers", CODE, RULES, HITS, SANITIZERS, body="""
select project_id, path, line_no, rule_type as sanitizer_type, code as sanitizer_code,
       pattern as sanitizer_pattern, sanitized_variable, context from sanitizers""")

CHECKS = []
for i, (pattern, message) in enumerate(match.BYPASS_CHECKS):
    if "{}" in message:
        a, b = message.split("{}")
        CHECKS.append(f"list_transform(regexp_extract_all(context, {q(pattern)}, 1), lambda v: {q(a)} || v || {q(b)})")
    else:
        CHECKS.append(f"list_transform(regexp_extract_all(context, {q(pattern)}, 0), lambda v: {q(message)})")
for vector, vector_words in match.VECTORS.items():
    missing = "list_filter([" + ", ".join(q(w) for w in sorted(vector_words)) + "], lambda w: not regexp_matches(context, '(?i)' || w))"
    CHECKS.append(f"case when len({missing}) between 1 and {len(vector_words) - 1} then "
                  f"[{q(match.MISSING_MESSAGE.format(vector))} || array_to_string({missing}, ', ')] else [] end")
CHECK_RULES = "checks(p) as (values " + ", ".join(f"({q(p)})" for p in match.VALIDATION_PATTERNS) + ")"
VALID = f"""ctx4 as (select *, {strip('text')} as code, {window(4)} as context from code_lines),
valid0 as (select project_id, path, line_no, code, context from ctx4 join checks on regexp_matches(text, p))"""
BYPASS = f"valid as (select *, {' || '.join(CHECKS)} as bypasses from valid0)"
add("mat_06_08_validations", CODE, CHECK_RULES, VALID, BYPASS, body="""
select project_id, path, line_no, code, context, array_to_string(bypasses, ' | ') as bypasses from valid""")
COMPARED = r"(\w+)\s*(?:===|!==|==|!=|>=|<=|>|<|\bin\b)"
add("jn_15_input_line", CODE, CHECK_RULES, VALID, body=f"""
select project_id, path, line_no, code, cast(coalesce((
    select max(l.line_no) from code_lines l, unnest(regexp_extract_all(v.context, {q(COMPARED)}, 1)) as n(name)
    where l.path = v.path and l.line_no < v.line_no
      and regexp_matches(l.text, '\\b' || n.name || '\\b\\s*=')), greatest(1, line_no - 5)) as integer) as input_line
from valid0 v""")
SUSPECT = "suspects(rule_ord, type, pattern, regex) as (values " + ", ".join(
    f"({r.rule_ord}, {q(r.rule_type)}, {q(r.pattern)}, {q(r.pattern.replace('{', chr(92) + '{') if 'function' in r.pattern else r.pattern)})"
    for r in regex_rules("suspicious")) + ", " + ", ".join(
    f"({n}, {q(t)}, {q(label)}, {q('|'.join(f'(?:{p})' for p in ps))})" for n, t, label, ps in (
        (98, "obfuscated_code", "obfuscated_strings", match.OBFUSCATION_PATTERNS),
        (99, "prototype_pollution", "prototype_modification", match.PROTOTYPE_PATTERNS))) + ")"
ODD = f"""ctx2s as (select *, {strip('text')} as code, {window(2)} as context from code_lines),
odd as (select project_id, path, type, line_no, code, pattern, context, rule_ord
        from ctx2s join suspects on regexp_matches(text, regex))"""
add("mat_09_11_suspicious", CODE, SUSPECT, ODD, body="""
select project_id, path, type, line_no, code, pattern, context from odd""")
add("prj_14_description", CODE, SUSPECT, ODD, body=f"""
select type, {case_map('type', sc.DESCRIPTION_OF, q(sc.DEFAULT_DESCRIPTION))} as description,
       count(*) as rows from odd group by all""")
add("mat_10_11_pages", fx.DUCK_PAGES, SUSPECT, body="""
select cast(page_id as varchar) as path, type, pattern, count(*) as lines
from (select page_id, unnest(string_split(html, chr(10))) as text from web_pages) l
join suspects on regexp_matches(text, regex) group by all""")
add("tk_05_first_per_file", CODE, SUSPECT, ODD, body="""
select * from (select project_id, path, cast(row_number() over (partition by path order by rule_ord, line_no) as integer) as ord,
                      type, line_no, pattern from odd) t where ord <= 5""")

# --- joins inside a file ----------------------------------------------------------------------

INDIRECT = f"""direct as materialized (select *, nullif({ASSIGNED}, '') as assigned from hits where role = 'source'),
near_direct as materialized (
  select d.project_id, d.path, l.line_no, d.rule_type, l.text, d.assigned, d.line_no as parent_line,
         d.pattern as parent_pattern, d.hit_ord
  from direct d join code_lines l on l.path = d.path
  where l.line_no <> d.line_no and contains(l.text, d.assigned)),
indirect as (
  select project_id, path, line_no, 'indirect_' || rule_type as rule_type, {strip('text')} as code,
         assigned as pattern, regexp_extract(text, '(\\w+)\\s*=\\s*.*' || assigned, 1) as derived_variable,
         parent_line, parent_pattern, hit_ord
  from near_direct where regexp_matches(text, '(\\w+)\\s*=\\s*.*' || assigned)),
sources as (select project_id, path, line_no, rule_type, code,
                   row_number() over (partition by path order by part, hit_ord, line_no) as src_ord
            from (select 0 as part, project_id, path, line_no, rule_type, code, hit_ord from direct
                  union all
                  select 1, project_id, path, line_no, rule_type, code, hit_ord from indirect) u)"""
add("jn_01_indirect_sources", CODE, RULES, HITS, INDIRECT, body="""
select project_id, path, line_no, rule_type as source_type, code as source_code,
       pattern as source_pattern, derived_variable, parent_line, parent_pattern from indirect""")
add("jn_02_wrapper_sinks", CODE, RULES, HITS, fx.DUCK_PATTERNS, MERGED, CUSTOM,
    """sink_rules as (select grp, null as project_id, rule_type, pattern from rules where role = 'sink'
  union all select g.grp, project_id, rule_type, name from custom, (select distinct grp from rules) g where role = 'sink')""",
    body=f"""
select l.project_id, l.path, l.line_no, 'wrapper_' || r.rule_type as sink_type,
       {strip('l.text')} as sink_code, w.name as sink_pattern, r.pattern as wrapped_sink
from ctx2 l join custom w on w.role = 'wrapper' and w.project_id = l.project_id and contains(l.text, w.name)
join ctx2 n on n.path = l.path and n.line_no between l.line_no - 3 and l.line_no + 3
join sink_rules r on r.grp = l.grp and coalesce(r.project_id, l.project_id) = l.project_id and contains(n.text, r.pattern)""")
add("jn_03_references", *VARS, body="""
select v.project_id, v.path, v.var_ord, v.name, o.line_no, o.initializer as context, o.name as ref_name
from vars v join vars o on o.path = v.path and contains(o.initializer, v.name)
union all
select v.project_id, v.path, v.var_ord, v.name, l.line_no, l.value, l.name
from vars v join laters l on l.path = v.path and contains(l.value, v.name)""")
add("jn_04_assignments", *VARS, body="""
select v.project_id, v.path, v.var_ord, v.name, l.line_no, l.value
from vars v join laters l on l.path = v.path and l.name = v.name""")

TAINT = """seeds as (
  select s.project_id, s.path, v.name as variable, v.line_no, s.rule_type as source, s.code, s.src_ord, v.var_ord
  from sources s join vars v on v.path = s.path and v.line_no = s.line_no),
writes as (
  select path, var_ord, name, 0 as kind, 0 as wo, line_no, initializer as text from vars
  union all select path, var_ord, name, 1, idx, line_no, value from laters),
edges as (
  select w.path, p.var_ord as po, w.var_ord as vo, p.name as pn, w.name, w.kind, w.wo, w.line_no, w.text
  from writes w join vars p on p.path = w.path and contains(w.text, p.name)
  where w.var_ord <> p.var_ord),
walk as (/* with_recursion */
  select path, 0 as hop, list(distinct var_ord) as frontier, list(distinct var_ord) as seen
  from seeds group by path
  union all
  select w.path, w.hop + 1, list(distinct e.vo), any_value(w.seen) || list(distinct e.vo)
  from walk w join edges e on e.path = w.path and list_contains(w.frontier, e.po)
       and not list_contains(w.seen, e.vo)
  group by w.path, w.hop),
reach as (select path, hop, unnest(frontier) as var_ord from walk),
parents as (
  select r.path, r.hop, r.var_ord, e.po, e.pn, e.name, e.line_no, e.text
  from reach r join edges e on e.path = r.path and e.vo = r.var_ord
  join reach f on f.path = r.path and f.var_ord = e.po and f.hop = r.hop - 1
  where r.hop > 0
  qualify row_number() over (partition by r.path, r.var_ord order by e.po, e.kind, e.wo) = 1),
marked as (/* source type handed down from parent to child */
  select path, var_ord, 0 as hop, arg_max(source, src_ord) as src from seeds group by path, var_ord
  union all
  select p.path, p.var_ord, p.hop, m.src from parents p
  join marked m on m.path = p.path and m.var_ord = p.po and m.hop = p.hop - 1),
tainted as (select m.*, v.name from marked m join vars v on v.path = m.path and v.var_ord = m.var_ord),
call_writes as (
  select c.project_id, c.path, c.call_ord, c.line_no, c.code,
         regexp_extract(c.code, '(\\w+)\\s*=\\s*.*\\Q' || c.function || '\\E', 1) as variable
  from calls c),
call_taints as (
  select distinct c.project_id, c.path, c.variable, c.line_no, t.src as source, c.code, t.name as transformed_from
  from call_writes c join tainted t on t.path = c.path and contains(c.code, t.name)
  where c.variable <> '' and exists (select 1 from vars v where v.path = c.path and v.name = c.variable))"""
TAINTED = (*VARS, CALLS, RULES, HITS, INDIRECT, TAINT)
add("jn_05_taint_seeds", *TAINTED, body="""
select project_id, path, variable, line_no, source, code from seeds""")
add("itr_01_propagation", *TAINTED, body="""
select v.project_id, p.path, p.name as variable, p.line_no, m.src as source, p.text as code,
       p.pn as transformed_from, p.hop
from parents p join marked m on m.path = p.path and m.var_ord = p.var_ord
join vars v on v.path = p.path and v.var_ord = p.var_ord""")
add("jn_07_call_taints", *TAINTED, body="""
select project_id, path, variable, line_no, source, code, transformed_from from call_taints""")
FLOWS = f"""all_taints as (
  select project_id, path, variable, line_no, source, code, null as transformed_from, 0 as part,
         src_ord as a, var_ord as b from seeds
  union all
  select v.project_id, p.path, p.name, p.line_no, m.src, p.text, p.pn, 1, p.hop, p.var_ord
  from parents p join marked m on m.path = p.path and m.var_ord = p.var_ord
  join vars v on v.path = p.path and v.var_ord = p.var_ord
  union all
  select project_id, path, variable, line_no, source, code, transformed_from, 2, 0, 0 from call_taints),
firsts as (
  select path, variable, line_no, transformed_from from (
    select *, row_number() over (partition by path, variable order by part, a, b) as rn from all_taints
    where part < 2 or (path, variable) not in (select path, variable from all_taints where part < 2)) t
  where rn = 1),
taint_ids as (select *, row_number() over (order by path, part, a, b) as tid from all_taints),
sink_ids as (select *, row_number() over (order by path, hit_ord) as sid from hits where role = 'sink'),
pairs as (
  select t.project_id, t.path, t.tid, k.sid, t.variable, t.source as source_type, t.line_no as source_line,
         t.code as source_code, t.transformed_from, k.rule_type as sink_type, k.line_no as sink_line, k.code as sink_code
  from taint_ids t join sink_ids k on k.path = t.path and contains(k.code, t.variable)),
cleaned as (
  select p.tid, p.sid, count(*) as n from pairs p join sanitizers s on s.path = p.path
   and s.line_no > p.source_line and s.line_no < p.sink_line
   and (contains(s.code, p.variable) or s.sanitized_variable = p.variable)
  group by all),
passed as (
  select p.tid, p.sid, string_agg('Passed to ' || c.function || ' at line ' || c.line_no, ' -> ' order by c.call_ord) as steps
  from pairs p join calls c on c.path = p.path and c.line_no > p.source_line and c.line_no < p.sink_line
   and contains(c.code, p.variable)
  group by all),
validated as (
  select p.tid, p.sid, string_agg(case when len(v.bypasses) = 0 then {q(match.NO_BYPASS)}
           else array_to_string(v.bypasses, ' | ') end, ' | ' order by v.line_no) as notes
  from pairs p join valid v on v.path = p.path and v.line_no > p.source_line and v.line_no < p.sink_line
   and contains(v.code, p.variable)
  group by all)"""
add("jn_08_12_flows", *TAINTED, SANITIZERS, CHECK_RULES, VALID, BYPASS, FLOWS, body=f"""
select p.project_id, p.path, source_type, source_line, source_code, sink_type, sink_line, sink_code,
       coalesce(c.n, 0) > 0 as sanitized, coalesce(c.n, 0) as sanitizer_count, p.variable,
       'Source at line ' || source_line
         || case when p.transformed_from is null then '' else ' -> Transformed from ' || p.transformed_from || ' at line ' || source_line
              || case when f.transformed_from is null then '' else ' -> Originally from ' || f.transformed_from || ' at line ' || f.line_no end end
         || coalesce(' -> ' || s.steps, '') || ' -> Reaches sink at line ' || sink_line as flow_path,
       coalesce(v.notes, 'No validation attempts detected') as validation_bypass,
       sink_line > source_line as sink_after_source
from pairs p left join cleaned c on c.tid = p.tid and c.sid = p.sid
left join passed s on s.tid = p.tid and s.sid = p.sid
left join validated v on v.tid = p.tid and v.sid = p.sid
left join firsts f on f.path = p.path and f.variable = p.transformed_from""")
EDGES = """call_edges as (
  select c.project_id, c.path, c.call_ord, c.function as callee, c.line_no, d.name as caller,
         d.line_no as caller_line, d.def_ord
  from calls c left join defs d on d.path = c.path and d.line_no < c.line_no
  qualify row_number() over (partition by c.path, c.call_ord order by d.line_no desc nulls last, d.def_ord) = 1)"""
GRAPH = (CODE, CODED, CALLS, JAVA_DEFS, PY_DEFS, DEFS, EDGES)
add("jn_13_enclosing_definition", *GRAPH, body="""
select project_id, path, call_ord, callee, line_no, caller, caller_line from call_edges""")
add("jn_14_call_graph", *GRAPH, """nodes as (
  select project_id, path, name, line_no, def_ord from defs
  qualify row_number() over (partition by path, name order by def_ord desc) = 1),
links as (select n.path, n.name as caller, e.callee, e.call_ord from nodes n
          join call_edges e on e.path = n.path and e.def_ord = n.def_ord)""", body="""
select n.project_id, n.path, n.name, n.line_no,
       coalesce((select string_agg(callee, ' | ' order by call_ord) from links l where l.path = n.path and l.caller = n.name), '') as calls,
       coalesce((select string_agg(caller, ' | ' order by caller) from links l where l.path = n.path and l.callee = n.name), '') as called_by
from nodes n""")

# --- across files -----------------------------------------------------------------------------

CROSS = f"""last_defs as (
  select project_id, name, path as called_file, line_no as called_line from defs
  qualify row_number() over (partition by project_id, name order by path desc, def_ord desc) = 1),
names as (select distinct project_id, path, line_no, nm
          from {per_line(chr(40) + chr(92) + 'w+)' + chr(92) + 's*' + chr(92) + '(', dict(nm=1))} a),
cross_calls as (
  select n.project_id, n.path as caller_file, n.line_no as caller_line, n.nm as called_entity, called_file, called_line
  from names n join last_defs d on d.project_id = n.project_id and d.name = n.nm and d.called_file <> n.path)"""
CROSSED = (CODE, JAVA_DEFS, PY_DEFS, DEFS, CROSS)
add("jn_16_cross_file_calls", *CROSSED, body="select * from cross_calls")
add("prj_05_cross_snippets", *CROSSED,
    """firsts as materialized (select * from (select *, cast(row_number() over (partition by project_id
   order by caller_file, caller_line, called_entity) as integer) as call_ord from cross_calls) t where call_ord <= 5)""",
    """callers as (select f.project_id, call_ord, string_agg(l.text, chr(10) order by l.line_no) as caller_code
   from firsts f join code_lines l on l.path = caller_file
   where l.line_no between caller_line - 3 and caller_line + 3 group by all)""",
    """callees as (select f.project_id, call_ord, string_agg(l.text, chr(10) order by l.line_no) as called_code
   from firsts f join code_lines l on l.path = called_file
   where l.line_no between called_line - 1 and called_line + 6 group by all)""", body="""
select project_id, call_ord, caller_file, caller_line, called_entity, called_file, called_line,
       caller_code, called_code
from firsts join callers using (project_id, call_ord) join callees using (project_id, call_ord)""")
add("jn_17_file_tiers", CODE, fx.DUCK_FINDINGS, body="""
select c.project_id, c.path, n as findings,
       case when n > 5 then 'danger' when n > 2 then 'warning' when n > 0 then 'info' else '' end as tier
from (select c.project_id, c.path, count(f.file) as n from code_files c
      left join findings f on f.project_id = c.project_id and f.file = c.path group by all) c""")
STATE = """scanned_files as (select project_id, path, octet_length(encode(content)) as size_bytes,
   cast(octet_length(encode(content)) % 97 as double) as mtime, md5(path || md5(content)) as file_hash from code_files),
scans as (select project_id, file_hash, path as file_path,
   case when size_bytes % 7 = 0 then mtime + 1 else mtime end as last_modified
  from scanned_files where size_bytes % 10 <> 0)"""
MATCHED = "select 1 from scans s where s.project_id = f.project_id and s.file_hash = f.file_hash and s.last_modified = f.mtime"
add("jn_18_files_to_scan", CODE, STATE, body=f"""
select project_id, path, file_hash from scanned_files f where not exists ({MATCHED})""")
add("jn_18_reused", CODE, STATE, body=f"""
select project_id, path, '[]' as vulnerabilities from scanned_files f where exists ({MATCHED})""")
SECURE = f"list_filter(i.v, lambda x: {contains_any('lower(x)', project.IMPORT_WORDS)})"
SCORES = f"""named as (select project_id, path, {NAME} as name from code_files),
scored as (
  select * from (
    select n.project_id, n.path, len({SECURE}) * 2 + len(e.v) * 3 + len(c.v) * 3
             + case when {contains_any('lower(n.name)', project.NAME_WORDS)} then 5 else 0 end as score,
           array_to_string(list_filter([
             case when len({SECURE}) > 0 then 'Imports: ' || array_to_string({SECURE}, ', ') end,
             case when len(e.v) > 0 then 'Has ' || len(e.v) || ' API endpoints' end,
             case when len(c.v) > 0 then 'Has ' || len(c.v) || ' security-critical functions' end,
             case when {contains_any('lower(n.name)', project.NAME_WORDS)} then 'Security-relevant filename: ' || n.name end],
             lambda x: x is not null), ' | ') as reasons
    from named n join imps i on i.path = n.path join ends e on e.path = n.path join crit c on c.path = n.path) t
  where score > 0),
ranked as (select project_id, path, score, cast(row_number() over (partition by project_id order by score desc, path) as integer) as rank,
                  count(*) over (partition by project_id) as n from scored)"""
SCORED = (CODE, IMPORTS, ENDPOINTS, CRITICAL, SCORES)
add("ag_09_file_score", *SCORED, body="select project_id, path, score, reasons from scored")
add("tk_01_top_files", *SCORED, body="""
select project_id, path, score, rank from ranked where rank <= 30 and n >= 15""")
add("jn_19_append_missing", *SCORED, body="select project_id, path, rank as ord from ranked")
AFFECTED = """affected as (select project_id, vulnerability_type, count(*) as files,
  md5(string_agg(f, ' | ' order by f)) as digest
  from (select distinct project_id, vulnerability_type, coalesce(file, '') as f from findings) t group by all)"""
add("jn_20_recommendations", fx.DUCK_FINDINGS, AFFECTED, body="""
select project_id, vulnerability_type, 'why' as risk_explanation, files, digest from affected
where vulnerability_type is not null""")
add("ag_08_affected_files", fx.DUCK_FINDINGS, AFFECTED, body="select * from affected")
add("jn_21_context", CODE, fx.DUCK_ROOT, DEPENDENCIES, FRAMEWORKS,
    "edited as (select * from code_files)", ENTRIES, body=f"""
select project_id, path,
       {PURPOSE} when relevant then 'Security-Related' else 'Unknown' end as purpose,
       path in (select path from entries) as entry_point, relevant as security_relevant,
       (select string_agg(framework, ' | ' order by framework) from (select distinct framework from fw f where f.project_id = c.project_id) x) as frameworks,
       (select string_agg(dependency, ' | ' order by dependency) from (select distinct dependency from deps f where f.project_id = c.project_id) x) as dependencies
from (select *, {contains_any('lower(content)', sc.SECURITY_WORDS)} as relevant from code_files) c""")

# --- aggregates, rankings, sets ---------------------------------------------------------------

COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as {s.lower()}" for s in report.SEVERITIES)
TYPE = "coalesce(vulnerability_type, 'Unknown')"
LABEL = "coalesce(nullif(string_split(file, '/')[-1], ''), 'Unknown')"
add("ag_01_severity", fx.DUCK_FINDINGS, body=f"select project_id, {COUNTS} from findings group by all")
add("ag_02_types", fx.DUCK_FINDINGS, body=f"""
select project_id, count(distinct {TYPE}) as unique_vulnerability_types,
       string_agg(distinct {TYPE}, ' | ' order by {TYPE}) as vulnerability_types
from findings group by all""")
TOTALS = """counted as (
  select s.project_id, files_scanned, coalesce(n, 0) as vulnerabilities_found,
         coalesce(d, 0) as files_with_findings, cast(coalesce(w, 0) as bigint) as severity_weight
  from (select project_id, count(*) as files_scanned from code_files group by all) s
  left join (select project_id, count(*) as n, count(distinct coalesce(file, '')) as d,
                    sum(case coalesce(severity, 'Low') when 'Critical' then 10 when 'High' then 7
                        when 'Medium' then 4 else 1 end) as w
             from kept group by all) f on f.project_id = s.project_id),
risk as (select *, cast(least(100, trunc(cast(severity_weight as double) / greatest(1, files_scanned) * 25
          + cast(files_with_findings as double) / greatest(1, files_scanned) * 75)) as integer) as risk_score from counted)"""
add("ag_03_11_risk", CODE, fx.DUCK_FINDINGS, "kept as (select * from findings where confidence >= 0.7)",
    TOTALS, body="select * from risk")
add("ag_14_summary", CODE, fx.DUCK_FINDINGS, "kept as (select * from findings where confidence >= 0.7)",
    TOTALS, body=f"""
select r.project_id, files_scanned, vulnerabilities_found,
       coalesce(u, 0) as unique_vulnerability_types, risk_score, coalesce(critical, 0) as critical,
       coalesce(low, 0) as low, coalesce(types, '') as vulnerability_types,
       files_scanned as critical_files
from risk r left join (select project_id, count(distinct {TYPE}) as u, {COUNTS},
    string_agg(distinct {TYPE}, ' | ' order by {TYPE}) as types from kept group by all) k
  on k.project_id = r.project_id""")
add("ag_04_by_type", fx.DUCK_FINDINGS, body=f"""
select project_id, {TYPE} as vulnerability_type, count(*) as findings from findings group by all""")
add("ag_05_type_severity", fx.DUCK_FINDINGS, body=f"""
select project_id, {TYPE} as vulnerability_type, count(*) as findings, {COUNTS} from findings group by all""")
add("ag_06_by_file", fx.DUCK_FINDINGS, body=f"""
select project_id, {LABEL} as file, count(*) as findings from findings group by all""")
add("ag_07_share", fx.DUCK_FINDINGS, body="""
select project_id, severity, count(*) as findings,
       cast(count(*) as double) / cast(sum(count(*)) over (partition by project_id) as double) * 100.0 as percent
from findings where severity in ('Critical', 'High', 'Medium', 'Low') group by project_id, severity""")


def points(x, key_words):
    return " + ".join(f"case when contains({x}, {q(w)}) then 5 else 0 end" for w in key_words)


MAIN = " or ".join(f"(language = {q(k)} and lower(name) in ({', '.join(q(n) for n in ns)}))"
                   for k, ns in project.MAIN_FILES.items())
FALLBACK = f"""fallback as (select project_id, path, {points('lower(name)', project.FALLBACK_WORDS)}
   + case when {MAIN} then 20 else 0 end + {points('lower(path)', project.FOLDER_WORDS)} as score, size_bytes as size
  from scanned where language is not null)"""
add("ag_10_fallback_score", fx.DUCK_REPO, SCANNED, FALLBACK, body="select * from fallback")
add("tk_02_fallback_files", fx.DUCK_REPO, SCANNED, FALLBACK, body="""
select project_id, path, score, cast(rank as integer) as rank from (select *,
  row_number() over (partition by project_id order by score desc, path) as rank from fallback) t where rank <= 30""")
add("ag_12_structure_hash", CODE, body="""
select project_id, md5(string_agg(h, chr(10) order by b)) as structure_hash from (
  select project_id, b, md5(string_agg(entry, chr(10) order by entry)) as h from (
    select project_id, substr(md5(path), 1, 3) as b,
           path || '|' || octet_length(encode(content)) || '|' || language as entry from code_files) e
  group by project_id, b) t group by project_id""")
add("ag_13_state_counts", CODE, STATE, body="""
select 'file_scans' as table, count(distinct project_id || ':' || file_hash) as rows from scans
union all select 'project_scans', count(distinct project_id) from code_files where project_id % 2 = 0
union all select 'metadata', count(distinct event_type) from events""")
add("tk_03_top_finding_files", fx.DUCK_FINDINGS, body=f"""
select * from (select *, cast(row_number() over (partition by project_id order by findings desc, file) as integer) as rank
  from (select project_id, {LABEL} as file, count(*) as findings from findings group by all) t) r where rank <= 5""")
ORDER = "line nulls first, severity nulls first, confidence nulls first, description"
add("tk_04_examples", fx.DUCK_FINDINGS, body=f"""
select project_id, vulnerability_type, example_ord, file, line, description from (select *,
  cast(row_number() over (partition by project_id, vulnerability_type order by file nulls first, {ORDER}) as integer) as example_ord
  from findings) t where example_ord <= 3""")
add("tk_06_first_per_project", fx.DUCK_FINDINGS, body="""
select project_id, finding_ord, file, line, vulnerability_type from (select *,
  cast(row_number() over (partition by project_id order by file nulls first, line nulls first,
    vulnerability_type nulls first, severity nulls first, confidence nulls first, description) as integer) as finding_ord
  from findings) t where finding_ord <= 5""")
add("tk_07_finding_files", fx.DUCK_FINDINGS, body="""
select distinct project_id, string_split(file, '/')[-1] as file from findings where coalesce(file, '') <> ''""")
add("set_01_union", fx.DUCK_FINDINGS, body="""
select project_id, count(*) as findings, count(description) as described
from (select project_id, description from findings
      union all select project_id, null from findings) t group by all""")
add("set_02_03_lists", CODE, CODED, CALLS, RULES, HITS, body="""
select f.project_id, f.path,
       coalesce((select string_agg(distinct function, ' | ' order by function) from calls c where c.path = f.path), '') as functions,
       coalesce((select string_agg(k, ' | ' order by k) from (values ('xss'), ('sql_injection'), ('command_injection')) v(k)
         where not exists (select 1 from hits h where h.path = f.path and h.role = 'sink' and h.rule_type = k)), '') as missing
from code_files f""")

# --- sinks, responses, state ------------------------------------------------------------------

add("snk_01_json_round_trip", fx.DUCK_FINDINGS, body="select * from findings")
add("snk_03_report_tables", CODE, fx.DUCK_FINDINGS, body="""
select 'summary' as name, count(distinct project_id) as rows from code_files
union all select 'by_type', count(*) from (select distinct project_id, vulnerability_type from findings where confidence >= 0.7) a
union all select 'by_file', count(*) from (select distinct project_id, file from findings where confidence >= 0.7) b
union all select 'file_tiers', count(*) from code_files""")
add("inc_04_clear", CODE, STATE, body="""
select 'file_scans' as table, count(*) as rows from scanned_files where project_id < 5
union all select 'project_scans', 0 union all select 'metadata', 0""")
CSV = {label.lower().replace(" ", "_"): c for label, c in report.CSV_COLUMNS.items()}
add("snk_02_csv_rows", fx.DUCK_FINDINGS, body="select " + ", ".join(
    f"coalesce(cast({c} as varchar), '') as {label}"
    for label, c in CSV.items()) + " from findings")
CWE = "case " + " ".join(
    f"when contains(key, {q(k)}) or contains({q(k)}, key) then {q(v)}" for k, v in sc.CWE_OF.items()) + " end"
EXACT = "case key " + " ".join(f"when {q(k)} then {q(v)}" for k, v in sc.CWE_OF.items()) + " end"


def key_of(x):
    return f"replace(lower({x}), ' ', '_')"


def cwe_sql(x):
    return f"(select coalesce({EXACT}, {CWE}) from (select {key_of(x)} as key))"


LADDER = f"""bodies as (select *, {strip('response')} as body,
   regexp_extract({strip('response')}, {q(rs.ARRAY_BLOCK)}, 1) as block from responses),
pathed as (select *, case
    when body = '' then 'blank'
    when left(body, 1) in ('[', '{{') and json_valid(body)
      then case when left(body, 1) = '[' then 'clean' else 'object' end
    when block <> '' and json_valid(block) then 'block'
    when regexp_matches(body, {q(rs.EMPTY_ARRAY)}) then 'empty'
    when regexp_matches(body, {q(rs.TEXT_FINDING)}) then 'text' else 'none' end as parse_path from bodies),
elements as (
  select project_id, path, parse_path, unnest(json_extract(case parse_path when 'clean' then body else block end, '$[*]')) as e,
         generate_subscripts(json_extract(case parse_path when 'clean' then body else block end, '$[*]'), 1) as i
  from pathed where parse_path in ('clean', 'block')),
objects as (select *, cast(row_number() over (partition by path order by i) as integer) as finding_ord
            from elements where json_type(e) = 'OBJECT'),
spoken as (
  select project_id, path, parse_path, cast(m as integer) as finding_ord, ls[m] as line, ks[m] as kind
  from (select *, regexp_extract_all(body, {q(rs.TEXT_FINDING)}, 2) as ls,
               regexp_extract_all(body, {q(rs.TEXT_FINDING)}, 3) as ks from pathed where parse_path = 'text') t,
       unnest(range(1, len(ls) + 1)) u(m))"""


def dflt(column, value):
    return f"case when parse_path = 'clean' then coalesce(e->>'{column}', {q(value)}) else e->>'{column}' end"


KIND = dflt("vulnerability_type", "Unknown")
add("jsn_01_03_findings", fx.DUCK_RESPONSES, LADDER, body=f"""
select project_id, path as file, parse_path, finding_ord,
       case when parse_path = 'clean' then coalesce(try_cast(e->>'line' as integer), 0) else try_cast(e->>'line' as integer) end as line,
       {KIND} as vulnerability_type, {dflt('description', 'No description provided')} as description,
       {dflt('severity', 'Medium')} as severity,
       case when parse_path = 'clean' and e->>'confidence' is null then 0.5 else try_cast(e->>'confidence' as double) end as confidence,
       case when parse_path = 'clean' and coalesce(e->>'cwe_id', '') = '' and ({KIND}) <> 'Unknown'
            then coalesce({cwe_sql(KIND)}, {dflt('cwe_id', '')}) else {dflt('cwe_id', '')} end as cwe_id,
       array_to_string(cast(e->'data_flow' as varchar[]), ' | ') as data_flow
from objects
union all
select project_id, path, parse_path, finding_ord, cast(line as integer), kind, {q(rs.TEXT_DESCRIPTION)}, 'Medium', 0.5,
       {cwe_sql('kind')}, null from spoken""")
add("jsn_01_conversations", """responses as (select conv_id as project_id, cast(turn as varchar) as path,
  'Issue 1: Line ' || turn || ' ' || text || ' XSS' as response from conversations)""", LADDER, body="""
select project_id, path as file, parse_path, cast(line as integer) as line, kind as vulnerability_type from spoken""")
add("jsn_04_cross_findings", *CROSSED, body=f"""
select project_id, caller_file as file, 0 as line, 'CWE-89' as cwe_id,
       {q(rs.CROSS_HEADING)} || '- ' || caller_file || chr(10) || '- ' || called_file || chr(10) as code_snippet,
       cast(0.8 as double) as confidence, min(called_entity) as functions_involved
from cross_calls group by project_id, caller_file, called_file""")
add("jsn_05_patterns", fx.DUCK_PATTERNS, """best as (
  select project_id, name, impact from project_patterns where kind = 'custom_function'
  qualify row_number() over (partition by project_id, name order by file_ord desc, impact desc nulls last) = 1)""",
    body="""
select project_id, 'custom_function' as kind, name, impact from best
union all select project_id, 'data_transformation', name || '_t', null from best""")
add("jsn_07_selection", CODE, body="""
select path as project_id, unnest([path, 'other.py']) as path, unnest([1, 2]) as ord
from code_files where path not like '%.go'""")
add("inc_01_upsert", CODE, STATE, body="""
select file_hash, file_path, cast(case when last_modified < 50 then 2 else 1 end as double) as last_scanned,
       case when last_modified < 50 then '[1]' else '[]' end as vulnerabilities from scans""")
add("inc_02_cached_selection", CODE, body="""
select distinct project_id, 'a.py | b.py' as critical_files from code_files where project_id % 2 = 0""")
add("inc_03_metadata", body="select event_type as key, max(event_id) as event_id from events group by all")

# --- request texts and project rules in the data flow -----------------------------------------

HITS_CUSTOM = HITS.replace("hits as (select", """hits as (select *, row_number() over (
    partition by path order by line_no, rule_ord, role, rule_type, pattern) as hit_ord from (select""").replace(""",
                row_number() over (partition by l.path order by l.line_no, r.rule_ord) as hit_ord""", "")
HITS_CUSTOM = HITS_CUSTOM[:-1] + """
         union all select l.project_id, l.path, l.line_no, l.text, l.code, l.context, c.role, c.rule_type,
                1000, c.name from ctx2 l join custom c on c.project_id = l.project_id
                and c.role in ('source', 'sink', 'sanitizer') and contains(l.text, c.name)) u)"""
add("jn_06_transformations", *VARS, CALLS, RULES, fx.DUCK_PATTERNS, MERGED, CUSTOM, HITS_CUSTOM, INDIRECT,
    TAINT, """moved as (
  select v.project_id, p.name as variable, (select string_agg(c.name, ' | ' order by c.name) from custom c
      where c.role = 'transform' and c.project_id = v.project_id and contains(p.text, c.name)) as transformations
  from parents p join vars v on v.path = p.path and v.var_ord = p.var_ord
  union all
  select r.project_id, variable, function from (
    select distinct c.project_id, c.path, w.variable, c.line_no, t.src, c.code, t.name, c.function
    from calls c join call_writes w on w.path = c.path and w.call_ord = c.call_ord
    join tainted t on t.path = c.path and contains(c.code, t.name)
    where w.variable <> '' and exists (select 1 from vars v where v.path = c.path and v.name = w.variable)) r
  where function in (select name from custom c where c.role = 'transform' and c.project_id = r.project_id))""",
    body="""
select project_id, variable, count(*) as rows, max(transformations) as transformations
from moved where transformations is not null group by all""")
FIRST_FINDS = """first_finds as (select * from (select *,
  cast(row_number() over (partition by project_id order by file nulls first, line nulls first,
    vulnerability_type nulls first, severity nulls first, confidence nulls first, description) as integer) as finding_ord
  from findings) t where finding_ord <= 5)"""
NL = "chr(10)"
FENCE = q("```")
CALL_TEXT = " || ".join([
    "n", q(". File '"), "caller_file", q("' line "), "caller_line", q(" calls '"), "called_entity",
    q("' from file '"), "called_file", q("' line "), "called_line", NL, q("   Caller code:"), NL, FENCE, NL,
    "a.caller_code", NL, FENCE, NL, q("   Called code:"), NL, FENCE, NL, "b.called_code", NL, FENCE, NL, NL])
FIND_TEXT = " || ".join([
    "finding_ord", q(". "), "coalesce(vulnerability_type, 'None')", q(" in "), "coalesce(file, 'None')",
    q(" line "), "line", NL, q("   Description: "), "description", NL, NL])
add("prj_18_cross_file_requests", *CROSSED, fx.DUCK_FINDINGS, FIRST_FINDS,
    f"near as (select path, line_no, {window(3)} as caller_code, {window(1, 6)} as called_code from code_lines)",
    """firsts as (select * from (select *, row_number() over (partition by project_id
   order by caller_file, caller_line, called_entity) as n from cross_calls) t where n <= 5)""", body=f"""
select c.project_id, 'Cross-File Function Calls:' || {NL} || calls_text
       || coalesce('Previously Identified Vulnerabilities:' || {NL} || finds_text, '') as prompt
from (select f.project_id, string_agg({CALL_TEXT}, '' order by n) as calls_text
      from firsts f join near a on a.path = caller_file and a.line_no = caller_line
      join near b on b.path = called_file and b.line_no = called_line group by f.project_id) c
left join (select project_id, string_agg({FIND_TEXT}, '' order by finding_ord) as finds_text
      from first_finds group by project_id) v on v.project_id = c.project_id""")
add("prj_18_pattern_requests", *SCORED, body=f"""
select c.project_id, c.path, 'File: ' || c.path || {NL} || {NL} || 'Code:' || {NL} || {FENCE} || language || {NL}
       || content || {NL} || {FENCE} || {NL} as prompt
from code_files c join ranked r on r.path = c.path where rank <= 5""")
ENTRY = ("'{\"path\":\"' || c.path || '\",\"type\":\"' || string_split(c.path, '.')[-1] || '\",\"size\":' || "
         "octet_length(encode(content)) || ',\"language\":\"' || language || '\"}'")
add("prj_18_selection_requests", *SCORED, body=f"""
select c.project_id, 'Project Structure:' || {NL} || '[' || string_agg({ENTRY}, ',' order by c.path) || ']'
       || {NL} || {NL} || 'Already Identified Files With Security Indicators:' || {NL}
       || '[' || coalesce(string_agg('"' || r.path || '"', ',' order by score desc, r.path) filter (r.path is not null), '')
       || ']' || {NL} as prompt
from code_files c left join ranked r on r.path = c.path group by c.project_id""")
DESCRIPTIVE = ", ".join(f"({i}, {q(n)})" for i, n in enumerate(manifests.SUMMARY_NAMES))
add("prj_18_summary_requests", fx.DUCK_ROOT, f"described(o, name) as (values {DESCRIPTIVE})", body=f"""
select r.project_id, 'Project root files: ' || string_agg(distinct r.name, ', ' order by r.name) || {NL} || {NL}
       || coalesce(string_agg({NL} || 'Content of ' || r.name || ':' || {NL} || content || {NL}, ''
            order by o, content) filter (o is not null), '') || {NL} as prompt
from root_files r left join described d on d.name = r.name group by r.project_id""")
add("prj_18_remediation_requests", fx.DUCK_FINDINGS, """numbered as (select *,
  row_number() over (partition by project_id, vulnerability_type order by file nulls first,
    line nulls first, severity nulls first, confidence nulls first, description) as n
  from findings where confidence >= 0.7 and vulnerability_type is not null),
typed as (select project_id, vulnerability_type, string_agg(json_object('file', coalesce(file, ''), 'line', line,
   'code_snippet', code_snippet, 'description', description, 'confidence', confidence,
   'data_flow', ['step1', description]), ',' order by n) as items from numbered where n <= 3 group by all)""", body=f"""
select project_id, '[' || string_agg('"' || vulnerability_type || '"', ',' order by vulnerability_type) || ']' || {NL}
  || '{{' || string_agg('"' || vulnerability_type || '":[' || items || ']', ',' order by vulnerability_type) || '}}' || {NL} as prompt
from typed group by project_id""")
FLOW_IDS = FLOWS.replace("2, 0, 0 from call_taints", "2, call_ord, mark_ord from call_order").replace(
    "all_taints as (", """call_order as (
  select c.project_id, c.path, c.variable, c.line_no, t.src as source, c.code, t.name as transformed_from,
         min(c.call_ord * 1000 + t.var_ord) as call_ord, 0 as mark_ord
  from call_writes c join tainted t on t.path = c.path and contains(c.code, t.name)
  where c.variable <> '' and exists (select 1 from vars v where v.path = c.path and v.name = c.variable)
  group by c.project_id, c.path, c.variable, c.line_no, t.src, c.code, t.name),
all_taints as (""", 1)


def numbered_text(source, key, order, limit, title, body, where="true"):
    """First rows of a file as one text, numbered."""
    return f"""(select path, {q(title)} || string_agg(n || '. ' || {body}, '' order by n) as t
      from (select *, row_number() over (partition by {key} order by {order}) as n from {source} where {where}) x
      where n <= {limit} group by path)"""


FLOW_LINES = f"""flow_lines as (
  select p.*, coalesce(c.n, 0) > 0 as clean,
       'Source at line ' || source_line
         || case when p.transformed_from is null then '' else ' -> Transformed from ' || p.transformed_from || ' at line ' || source_line
              || case when f.transformed_from is null then '' else ' -> Originally from ' || f.transformed_from || ' at line ' || f.line_no end end
         || coalesce(' -> ' || s.steps, '') || ' -> Reaches sink at line ' || sink_line as flow_path
  from pairs p left join cleaned c on c.tid = p.tid and c.sid = p.sid
  left join passed s on s.tid = p.tid and s.sid = p.sid
  left join firsts f on f.path = p.path and f.variable = p.transformed_from),
valid_rows as (select *, row_number() over (partition by path order by line_no) as vn from valid_in),
valid_in as (select v.*, cast(coalesce((
    select max(l.line_no) from code_lines l, unnest(regexp_extract_all(v.context, {q(COMPARED)}, 1)) as n(name)
    where l.path = v.path and l.line_no < v.line_no
      and regexp_matches(l.text, '\\b' || n.name || '\\b\\s*=')), greatest(1, line_no - 5)) as integer) as input_line
  from valid v)"""
DIGEST_FLOWS = numbered_text(
    "flow_lines", "path", "sid, tid", 10, "Source-Sink Flows (potential vulnerabilities):\n",
    " || ".join(["source_type", q(" at line "), "source_line", q(" flows to "), "sink_type", q(" at line "), "sink_line",
                 q("\n   Source: "), "source_code", q("\n   Flow Path: "), "flow_path", q("\n   Sink: "), "sink_code",
                 q("\n   Sanitized: "), "case when clean then 'True' else 'False' end", q("\n\n")]))
DIGEST_TAINTS = numbered_text(
    "taint_ids", "path", "tid", 10, "Taint Propagation:\n",
    " || ".join([q("Tainted variable '"), "variable", q("' at line "), "line_no", q(" from "), "source",
                 q("\n   Transformations: \n")]))
DIGEST_VALID = numbered_text(
    "valid_in", "path", "line_no", 5, "\nValidation Attempts (potential bypasses):\n",
    " || ".join([q("Validation at line "), "line_no", q(" for input from line "), "input_line",
                 q("\n   Validation code: "), "code", q("\n   Potential bypass: "),
                 f"case when len(bypasses) = 0 then {q(match.NO_BYPASS)} else array_to_string(bypasses, '; ') end", q("\n\n")]))
DIGEST_ODD = numbered_text(
    "odd", "path", "rule_ord, line_no", 5, "\nSuspicious Patterns:\n",
    " || ".join(["type", q(" at line "), "line_no", q(": "),
                 case_map("type", sc.DESCRIPTION_OF, q(sc.DEFAULT_DESCRIPTION)), q("\n   Code: "), "code", q("\n\n")]))
add("prj_17_file_requests", *TAINTED, SANITIZERS, CHECK_RULES, VALID, BYPASS, FLOW_IDS,
    FLOW_LINES.replace("valid_rows as (select *, row_number() over (partition by path order by line_no) as vn from valid_in),\n", ""),
    SUSPECT, ODD, f"df as {DIGEST_FLOWS}", f"dt as {DIGEST_TAINTS}", f"dv as {DIGEST_VALID}", f"ds as {DIGEST_ODD}",
    body=f"""
select c.project_id, c.path, 'File: ' || c.path || {NL} || 'Language: ' || language || {NL} || {NL} || {NL}
  || 'File Context:' || {NL} || '- Framework: ' || {NL} || '- Dependencies: ' || {NL} || '- File purpose: '
  || {PURPOSE.replace('lower(path)', 'lower(c.path)')} when {contains_any('lower(content)', sc.SECURITY_WORDS)} then 'Security-Related' else 'Unknown' end
  || {NL} || '- API endpoints: ' || array_to_string({SCAN_ENDS}, ', ') || {NL} || {NL}
  || 'Project-Specific Patterns:' || {NL} || '- Custom security functions: ' || {NL} || '- Data transformation functions: '
  || {NL} || '- Validation functions: ' || {NL} || '- Wrapper functions: ' || {NL} || {NL}
  || 'Data Flow Analysis Results:' || {NL} || coalesce(df.t, '') || coalesce(dt.t, '') || coalesce(dv.t, '') || coalesce(ds.t, '')
  || {NL} || 'Code:' || {NL} || {FENCE} || language || {NL} || content || {NL} || {FENCE} || {NL} as prompt
from code_files c left join df on df.path = c.path left join dt on dt.path = c.path
left join dv on dv.path = c.path left join ds on ds.path = c.path""")


# --- files of any length ------------------------------------------------------------------------

_CALL_WRITE = r"""call_sets as (
  select c.path, v.var_ord, v.name, 2 as kind, c.call_ord as wo, c.line_no, c.code as text
  from (select *, regexp_extract(code, '(\w+)\s*=\s*.*\Q' || function || '\E', 1) as variable
        from calls where instr(code, '=') > 0) c
  join vars v on v.path = c.path and v.name = c.variable),
writes as (
  select * from call_sets union all select"""
ORACLES["jn_07_chained_calls"] = ORACLES["itr_01_propagation"].replace("writes as (\n  select", _CALL_WRITE, 1) \
    .replace("validate({a})", "v0 == check({a})")
for _name, _like in (("jn_08_12_long_files", "jn_08_12_flows"), ("jn_13_long_files", "jn_13_enclosing_definition"),
                     ("itr_01_long_files", "itr_01_propagation"), ("jn_01_long_files", "jn_01_indirect_sources")):
    ORACLES[_name] = ORACLES[_like].replace(fx.DUCK_CODE.strip(), fx.DUCK_LONG.strip())
LONG_VARS = [c.replace(fx.DUCK_CODE, fx.DUCK_LONG) for c in VARS]
add("jn_03_long_files", *LONG_VARS, body="""
select project_id, path, var_ord, name, count(*) as uses, sum(line_no)::bigint as line_sum,
       min(context) as first_context, max(context) as last_context, count(distinct ref_name) as ref_names
from (
  select v.project_id, v.path, v.var_ord, v.name, o.line_no, o.initializer as context, o.name as ref_name
  from vars v join vars o on o.path = v.path and contains(o.initializer, v.name)
  union all
  select v.project_id, v.path, v.var_ord, v.name, l.line_no, l.value, l.name
  from vars v join laters l on l.path = v.path and contains(l.value, v.name)) t group by all""")
add("jn_15_long_files", fx.DUCK_LONG, CHECK_RULES, VALID,
    "attempts as materialized (select *, row_number() over () as id from valid0)", f"""compared as (
  select id, path, line_no, unnest(list_distinct(regexp_extract_all(context, {q(COMPARED)}, 1))) as name from attempts)""",
    r"""assigned as (select path, line_no, unnest(list_distinct(regexp_extract_all(text, '(\w+)\s*=', 1))) as name
  from code_lines)""", """near as (select id, max(a.line_no) as found from compared c
  join assigned a on a.path = c.path and a.name = c.name and a.line_no < c.line_no group by id)""", body="""
select project_id, path, line_no, code, cast(coalesce(found, greatest(1, line_no - 5)) as integer) as input_line
from attempts left join near using (id)""")
