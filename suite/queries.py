"""One query per operator of the inventory; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite import fixtures as fx
from tracewell.functions import scalars as sc
from tracewell.functions.expressions import find_all, struct
from tracewell.functions.rows import explode_structs
from tracewell.operators import dataflow, facts, flow_tables, match, project
from tracewell.operators.sizing import scratch_folder, spread_small, written
from tracewell.plans import report, requests
from tracewell.plans import responses as rs
from tracewell.rules import project as custom
from tracewell.rules.catalog import java_regex
from tracewell.sources import corpus, filesource, manifests
from tracewell.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SENTENCE = r"\.\s+[A-Z]\w*"


def query(function):
    QUERIES[function.__name__] = function
    return function


def joined(column, separator=" | "):
    """An array of strings as one text, so that both engines compare the same plain value."""
    return F.array_join(column, separator)


def analysis_of(spark, d, result, patterns=False):
    return dataflow.table(fx.code_files(spark, d), result,
                          patterns=fx.project_patterns(spark, d) if patterns else None)


def documents_as_files(spark, d):
    return spread_small(fx.read(spark, d, "documents")).select(
        F.lit(0).alias("project_id"), F.col("doc_id").cast("string").alias("path"),
        F.lit("unknown").alias("language"), F.col("text").alias("content"))


def pages_as_files(spark, d):
    return spread_small(fx.web_pages(spark, d)).select(
        F.lit(0).alias("project_id"), F.col("page_id").cast("string").alias("path"),
        F.lit("html").alias("language"), F.col("html").alias("content"))


# --- scans and sources ------------------------------------------------------------------------

@query
def src_01_corpus_scan(spark, d):
    return corpus.select_source_files(fx.repo_files(spark, d), max_file_size=100_000).select(
        "project_id", "path", F.col("ext").alias("type"), "size_bytes", "language")


@query
def src_01_packed_corpus(spark, d):
    """The files of the listing, with texts of a length of their own, packed into archives and read back."""
    root = _scratch(spark, "packed")
    text = F.repeat(F.lit("x\r\n"), (F.col("size_bytes") % 300).cast("int"))
    filesource.pack(fx.repo_files(spark, d).select("project_id", "path", F.lit(1.0).alias("mtime"), text.alias("content")),
                    root)
    return corpus.read_corpus(spark, root, max_file_size=600).select(
        "project_id", "path", "ext", "size_bytes", "language", F.length("content").alias("chars"))


@query
def src_02_ignore_filter(spark, d):
    path = F.col("path")
    return fx.repo_files(spark, d).select(
        "project_id", "path", corpus.ignored(path).alias("ignored"),
        corpus.ignored(path, anchor=True).alias("ignored_anchored"))


@query
def src_03_language(spark, d):
    name = sc.basename(F.col("path"))
    return fx.repo_files(spark, d).groupBy(
        sc.extension(name).alias("ext"), sc.language_of(F.col("path")).alias("language")
    ).agg(F.count("*").alias("files"))


@query
def src_04_file_cap(spark, d):
    kept = corpus.select_source_files(fx.repo_files(spark, d), max_file_size=300_000)
    return corpus.first_files(kept, 20).select("project_id", "path", "size_bytes")


@query
def src_05_all_source_files(spark, d):
    kept = corpus.select_source_files(fx.repo_files(spark, d), max_file_size=10**9)
    return kept.groupBy("project_id").agg(F.count("*").alias("files"),
                                          F.min("path").alias("first_path"))


@query
def src_06_decode(spark, d):
    damaged = F.concat(F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8"),
                       F.unhex(F.lit("FF0D")))
    return fx.read(spark, d, "documents").select(
        "doc_id", corpus.decode_text(damaged).alias("t")
    ).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@query
def src_07_head(spark, d):
    top = corpus.head(F.col("text"), 10_240)
    return fx.read(spark, d, "documents").select(
        "doc_id", F.md5(top).alias("digest"), F.length(top).alias("chars"))


@query
def src_08_dependencies(spark, d):
    return manifests.dependencies(fx.root_files(spark, d)).groupBy(
        "project_id", "dependency", "version").agg(F.count("*").alias("files"))


# --- projections ------------------------------------------------------------------------------

@query
def prj_01_lines(spark, d):
    return facts.lines(fx.code_files(spark, d))


@query
def prj_01_document_lines(spark, d):
    return facts.lines(documents_as_files(spark, d)).groupBy("path").agg(
        F.count("*").alias("lines"), F.max("line_no").alias("last_line"),
        F.sum(F.length("text")).alias("chars"))


@query
def prj_02_match_line(spark, d):
    found = find_all("content", java_regex(SENTENCE), {"hit": 0},
                     struct(line_no="_ln", hit="hit"), "struct<line_no:int,hit:string>")
    rows = explode_structs(documents_as_files(spark, d), ["path"], F.expr(found))
    return rows.groupBy("path", "line_no").agg(
        F.count("*").alias("matches"), F.min("hit").alias("first_text"))


@query
def prj_03_04_snippet_context(spark, d):
    files = fx.code_files(spark, d)
    places = facts.lines(files).where(F.contains("text", F.lit("return"))) \
        .select("project_id", "path", "line_no")
    return facts.snippet_at(files, places)


@query
def prj_05_cross_snippets(spark, d):
    files = written(fx.code_files(spark, d).select("project_id", "path", "language", "content"), "files")
    calls = project.first_cross_calls(project.cross_file_calls(files))
    return project.cross_call_snippets(files, calls).select(
        "project_id", "call_ord", "caller_file", "caller_line", "called_entity", "called_file",
        "called_line", "caller_code", "called_code")


@query
def prj_06_cwe(spark, d):
    kind = F.coalesce("vulnerability_type", F.lit("none"))
    return fx.findings(spark, d).groupBy(
        kind.alias("vulnerability_type"), sc.cwe_of(kind).alias("cwe")
    ).agg(F.count("*").alias("findings"))


@query
def prj_07_severity(spark, d):
    kind = F.coalesce("vulnerability_type", F.lit("none"))
    return fx.findings(spark, d).groupBy(
        kind.alias("vulnerability_type"), sc.severity_of(kind).alias("severity_class")
    ).agg(F.count("*").alias("findings"))


@query
def prj_08_09_buckets(spark, d):
    return fx.findings(spark, d).groupBy(
        sc.confidence_bucket(F.coalesce("confidence", F.lit(0.5))).alias("bucket"),
        sc.severity_class(F.col("severity")).alias("css_class")
    ).agg(F.count("*").alias("findings"))


@query
def prj_10_purpose(spark, d):
    return fx.repo_files(spark, d).select(
        "project_id", "path", sc.purpose_of(F.col("path")).alias("purpose"))


@query
def prj_11_paths(spark, d):
    odd = F.concat(F.lit("/r/./a//../"), F.col("path"), F.lit("/../x"))
    return fx.repo_files(spark, d).select(
        "project_id", "path", sc.basename(F.col("path")).alias("base"),
        sc.normalize_path(odd).alias("normal"))


@query
def prj_12_shorten(spark, d):
    short = sc.shorten_middle(F.col("text"))
    return fx.read(spark, d, "documents").select(
        "doc_id", F.length(short).alias("chars"), F.md5(short).alias("digest"))


@query
def prj_13_fingerprint(spark, d):
    return fx.code_files(spark, d).select(
        "path", sc.fingerprint(F.col("path"), F.col("content")).alias("file_hash"))


@query
def prj_14_description(spark, d):
    found = analysis_of(spark, d, "suspicious_patterns")
    return found.groupBy("type", sc.describe(F.col("type")).alias("description")) \
        .agg(F.count("*").alias("rows"))


@query
def prj_15_kind_hint(spark, d):
    return fx.repo_files(spark, d).groupBy(
        sc.kind_hint(sc.basename(F.col("path"))).alias("hint")).agg(F.count("*").alias("files"))


@query
def prj_17_file_requests(spark, d):
    return requests.file_requests(fx.code_files(spark, d), flows=10, taints=10, validations=5, suspicious=5,
                                  dependencies=10)


@query
def prj_18_cross_file_requests(spark, d):
    files = fx.code_files(spark, d)
    calls = project.first_cross_calls(project.cross_file_calls(files))
    found = report.first_findings(fx.findings(spark, d))
    return requests.cross_file_requests(project.cross_call_snippets(files, calls), found)


@query
def prj_18_remediation_requests(spark, d):
    kept = report.confident(fx.findings(spark, d)).where("vulnerability_type is not null")
    return requests.remediation_requests(report.example_findings(kept))


@query
def prj_18_summary_requests(spark, d):
    return requests.summary_requests(fx.root_files(spark, d))


@query
def prj_18_pattern_requests(spark, d):
    files = fx.code_files(spark, d)
    scores = project.file_scores(project.file_metadata(files))
    sampled = project.fallback_files(scores, 5).select("project_id", "path")
    return requests.pattern_requests(files.join(sampled, ["project_id", "path"]))


@query
def prj_18_selection_requests(spark, d):
    files = fx.code_files(spark, d)
    return requests.selection_requests(files, project.file_scores(project.file_metadata(files))).select(
        "project_id", "prompt")


# --- filters ----------------------------------------------------------------------------------

@query
def flt_01_confidence(spark, d):
    return report.confident(fx.findings(spark, d)).groupBy("project_id").agg(
        F.count("*").alias("kept"), F.min("confidence").alias("lowest"))


@query
def flt_02_report_filter(spark, d):
    kept = report.report_filter(fx.findings(spark, d), severity="High", confidence="high")
    return report.by_type(kept)


@query
def flt_03_security_words(spark, d):
    hits = sc.security_words_in(corpus.head(F.col("text")))
    return fx.read(spark, d, "documents").select(
        "doc_id", joined(hits, ",").alias("words"), (F.size(hits) > 0).alias("relevant"))


@query
def flt_04_substring(spark, d):
    return facts.lines(fx.code_files(spark, d)).where(F.contains("text", F.lit("escape("))) \
        .groupBy("project_id").agg(F.count("*").alias("lines"))


@query
def flt_05_regex(spark, d):
    regex = java_regex(r"password\s*=\s*['\"][^'\"]+['\"]", True)
    return facts.lines(fx.code_files(spark, d)).where(F.col("text").rlike(regex)) \
        .groupBy("project_id").agg(F.count("*").alias("lines"))


# --- fact extraction --------------------------------------------------------------------------

@query
def ext_01_imports(spark, d):
    return project.file_metadata(fx.code_files(spark, d)).select(
        "project_id", "path", joined("imports").alias("imports"))


@query
def ext_02_endpoints(spark, d):
    return project.file_metadata(fx.code_files(spark, d)).select(
        "project_id", "path", joined("endpoints").alias("endpoints"))


@query
def ext_03_scan_endpoints(spark, d):
    return project.with_context(fx.code_files(spark, d)).select(
        "project_id", "path", joined("endpoints").alias("endpoints"), "purpose")


@query
def ext_04_critical_functions(spark, d):
    return project.file_metadata(fx.code_files(spark, d)).select(
        "project_id", "path", joined("critical_functions").alias("critical_functions"))


@query
def ext_05_entry_points(spark, d):
    changed = F.col("content")
    for old, new in (("String fn5(", "void main ("), ("fn2(", "main("), ("route(", "app.listen(")):
        changed = F.replace(changed, F.lit(old), F.lit(new))
    return project.entry_points(fx.code_files(spark, d).withColumn("content", changed))


@query
def ext_06_frameworks(spark, d):
    return manifests.frameworks(fx.root_files(spark, d))


@query
def ext_07_captured(spark, d):
    names = sc.captured(F.col("content"), r"(\w*)\s*=[^=]")
    return fx.code_files(spark, d).select("project_id", "path", joined(names).alias("names"))


def _of(frame, *languages):
    return frame.where(F.col("language").isin(*languages))


@query
def ext_08_js_facts(spark, d):
    files = _of(fx.code_files(spark, d), "javascript")
    return facts.declarations(files).select(
        "path", F.col("decl_ord").alias("ord"), "line_no", F.lit("decl").alias("fact"), "kind",
        "name", "value"
    ).unionByName(facts.assignments(files).select(
        "path", F.col("assign_ord").alias("ord"), "line_no", F.lit("assign").alias("fact"),
        F.lit("").alias("kind"), F.col("target").alias("name"), "value"))


def _java_files(spark, d):
    """Java files with lines that hold what the templates lack: class heads, exceptions, fields."""
    changed = F.col("content")
    for old, new in (
            ("import java.io.File;", "public class Kind extends Base implements One, Two {"),
            (") {", ") throws Bad, Worse {"), ("Random r =", "private static final Random r =")):
        changed = F.replace(changed, F.lit(old), F.lit(new))
    return _of(fx.code_files(spark, d), "java").withColumn("content", changed)


@query
def ext_09_java_facts(spark, d):
    return facts.definitions(_java_files(spark, d)).select(
        "path", F.col("def_ord").alias("ord"), "line_no", "kind", "name", "modifier", "is_static",
        "result_type", joined("param_types").alias("param_types"),
        joined("param_names").alias("param_names"), "extends",
        joined("implements").alias("implements"), joined("throws").alias("throws"))


@query
def ext_09_java_variables(spark, d):
    return facts.declarations(_java_files(spark, d)).select(
        "path", "line_no", "kind", "var_type", "name", "value")


@query
def ext_10_generic_facts(spark, d):
    files = _of(fx.code_files(spark, d), "golang")
    return facts.declarations(files).select(
        "path", "line_no", F.lit("decl").alias("fact"), F.col("var_type").alias("kind"), "name",
        "value"
    ).unionByName(facts.definitions(files).select(
        "path", "line_no", F.lit("def").alias("fact"), F.col("result_type").alias("kind"),
        "name", joined("param_names").alias("value")))


@query
def ext_11_python_facts(spark, d):
    files = _of(fx.code_files(spark, d), "python")
    return facts.assignments(files).select(
        "path", "line_no", F.lit("assign").alias("fact"), F.col("target").alias("name"), "value"
    ).unionByName(facts.definitions(files).select(
        "path", "line_no", F.lit("def").alias("fact"), "name",
        joined("param_names").alias("value"))
    ).unionByName(facts.imports(files).select(
        "path", "line_no", F.lit("import").alias("fact"),
        F.coalesce("module", F.lit("")).alias("name"), joined("names").alias("value")))


@query
def ext_11_python_statements(spark, d):
    files = _of(fx.code_files(spark, d), "python")
    for old, new in (("import subprocess", fx.LONG_IMPORT), ("):", fx.LONG_HEAD)):
        files = files.withColumn("content", F.replace("content", F.lit(old), F.lit(new)))
    return facts.imports(files).select(
        "path", "line_no", F.lit("import").alias("fact"), F.coalesce("module", F.lit("")).alias("name"),
        joined("names").alias("parts"), joined("aliases").alias("aliases")
    ).unionByName(facts.definitions(files).select(
        "path", "line_no", F.lit("def").alias("fact"), "name", joined("param_names").alias("parts"),
        F.lit("").alias("aliases")))


@query
def ext_12_variables(spark, d):
    return facts.variables(fx.code_files(spark, d)).select(
        "project_id", "path", "var_ord", "name", "line_no", "initializer", "assigned_value",
        F.size("later_assigns").alias("later"))


@query
def ext_13_usages(spark, d):
    return facts.usages(fx.code_files(spark, d))


@query
def ext_14_calls(spark, d):
    return facts.calls(fx.code_files(spark, d)).select(
        "project_id", "path", "call_ord", "line_no", "function", joined("args").alias("args"),
        "code")


@query
def ext_15_definitions(spark, d):
    return facts.definitions(fx.code_files(spark, d)).select(
        "project_id", "path", "def_ord", "line_no", "name")


# --- rules and matching -----------------------------------------------------------------------

@query
def rul_04_custom_rules(spark, d):
    merged = custom.merge_samples(fx.project_patterns(spark, d))
    return custom.custom_rules(merged)


@query
def rul_05_merged_patterns(spark, d):
    return custom.merge_samples(fx.project_patterns(spark, d)).select(
        "project_id", "kind", F.coalesce("category", F.lit("")).alias("category"), "name",
        F.when(F.col("kind") == "custom_function", F.coalesce("impact", F.lit("")))
        .otherwise("").alias("impact"))


@query
def mat_01_quick_scan(spark, d):
    return match.quick_scan(fx.code_files(spark, d)).select(
        "project_id", "path", "rule_type", "line_no", "pattern", "code")


@query
def mat_01_documents(spark, d):
    return match.quick_scan(documents_as_files(spark, d)).groupBy(
        "path", "rule_type", "pattern").agg(F.count("*").alias("matches"),
                                            F.min("line_no").alias("first_line"))


@query
def mat_02_web_scan(spark, d):
    return match.web_scan(pages_as_files(spark, d)).groupBy(
        "path", "rule_type", "pattern").agg(F.count("*").alias("matches"),
                                            F.min("line_no").alias("first_line"))


@query
def mat_03_sources(spark, d):
    found = analysis_of(spark, d, "sources").where("parent_line is null")
    return found.select("project_id", "path", "line_no", "source_type", "source_code",
                        "source_pattern", "context")


@query
def mat_04_sinks(spark, d):
    return analysis_of(spark, d, "sinks").select(
        "project_id", "path", "line_no", "sink_type", "sink_code", "sink_pattern", "context")


@query
def mat_05_sanitizers(spark, d):
    return analysis_of(spark, d, "sanitizers").select(
        "project_id", "path", "line_no", "sanitizer_type", "sanitizer_code", "sanitizer_pattern",
        F.coalesce("sanitized_variable", F.lit("")).alias("sanitized_variable"), "context")


@query
def mat_06_08_validations(spark, d):
    return analysis_of(spark, d, "validation_attempts").select(
        "project_id", "path", "line_no", "code", "context", joined("bypasses").alias("bypasses"))


@query
def mat_09_11_suspicious(spark, d):
    return analysis_of(spark, d, "suspicious_patterns").select(
        "project_id", "path", "type", "line_no", "code", "pattern", "context")


@query
def mat_10_11_pages(spark, d):
    files = facts.with_lines(pages_as_files(spark, d)).withColumn(
        "suspicious_names", F.lit(None).cast("array<string>"))
    found = explode_structs(files, ["path"], F.expr(match.suspicious_expr()))
    return found.groupBy("path", "type", "pattern").agg(F.count("*").alias("lines"))


# --- joins ------------------------------------------------------------------------------------

@query
def jn_01_indirect_sources(spark, d):
    found = analysis_of(spark, d, "sources").where("parent_line is not null")
    return found.select("project_id", "path", "line_no", "source_type", "source_code",
                        "source_pattern", "derived_variable", "parent_line", "parent_pattern")


@query
def jn_02_wrapper_sinks(spark, d):
    found = analysis_of(spark, d, "sinks", True)
    return found.where("wrapped_sink is not null").select(
        "project_id", "path", "line_no", "sink_type", "sink_code", "sink_pattern", "wrapped_sink")


@query
def jn_03_references(spark, d):
    return facts.references(fx.code_files(spark, d))


@query
def jn_04_assignments(spark, d):
    return facts.assignments_to(fx.code_files(spark, d))


@query
def jn_05_taint_seeds(spark, d):
    return analysis_of(spark, d, "taints").where("hop = 0").select(
        "project_id", "path", "variable", "line_no", "source", "code")


@query
def jn_07_call_taints(spark, d):
    return analysis_of(spark, d, "taints").where("hop is null").select(
        "project_id", "path", "variable", "line_no", "source", "code", "transformed_from")


@query
def itr_01_propagation(spark, d):
    return analysis_of(spark, d, "taints").where("hop > 0").select(
        "project_id", "path", "variable", "line_no", "source", "code", "transformed_from", "hop")


@query
def jn_06_transformations(spark, d):
    found = analysis_of(spark, d, "taints", True)
    return found.where(F.size("transformations") > 0).groupBy("project_id", "variable").agg(
        F.count("*").alias("rows"), F.max(joined("transformations")).alias("transformations"))


@query
def jn_08_12_flows(spark, d):
    return analysis_of(spark, d, "flows").select(
        "project_id", "path", "source_type", "source_line", "source_code", "sink_type",
        "sink_line", "sink_code", "sanitized",
        F.size("sanitizers").alias("sanitizer_count"), "variable",
        joined("flow_path", " -> ").alias("flow_path"),
        joined("validation_bypass").alias("validation_bypass"), "sink_after_source")


@query
def jn_13_enclosing_definition(spark, d):
    return analysis_of(spark, d, "call_edges").select(
        "project_id", "path", "call_ord", "callee", "line_no", "caller", "caller_line")


@query
def jn_14_call_graph(spark, d):
    return analysis_of(spark, d, "call_graph").select(
        "project_id", "path", "name", "line_no", joined("calls").alias("calls"),
        joined(F.array_sort("called_by")).alias("called_by"))


@query
def jn_15_input_line(spark, d):
    return analysis_of(spark, d, "validation_attempts").select(
        "project_id", "path", "line_no", "code", "input_line")


@query
def jn_16_cross_file_calls(spark, d):
    return project.cross_file_calls(fx.code_files(spark, d)).select(
        "project_id", "caller_file", "caller_line", "called_entity", "called_file", "called_line")


@query
def jn_17_file_tiers(spark, d):
    files = fx.code_files(spark, d).select("project_id", "path")
    return report.file_tiers(files, fx.findings(spark, d))


def _scan_state(spark, d):
    """Files with a modification time, and saved results for most of them, some out of date."""
    files = fx.code_files(spark, d).withColumn(
        "mtime", (F.col("size_bytes") % 97).cast("double"))
    scans = state.with_hash(files).where(F.col("size_bytes") % 10 != 0).select(
        F.col("project_id").cast("string").alias("project_id"), "file_hash", F.col("path").alias("file_path"),
        F.when(F.col("size_bytes") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime"))
        .alias("last_modified"), F.lit(1.0).alias("last_scanned"),
        F.lit("[]").alias("vulnerabilities"), F.lit("r1").alias("rules_version"))
    return files, scans


def _saved_selections(files):
    """Saved file lists of every other project."""
    return state.structure_hash(files).where(F.col("project_id") % 2 == 0).select(
        "project_id", "structure_hash", F.lit('["a.py","b.py"]').alias("critical_files"),
        F.lit(1.0).alias("last_scanned"), F.lit("r1").alias("rules_version"))


def _metadata(spark, d):
    return fx.read(spark, d, "events").select(
        F.col("event_type").alias("key"), F.to_json(F.struct("event_id")).alias("value"),
        F.col("event_id").cast("double").alias("last_updated"))


@query
def jn_18_files_to_scan(spark, d):
    files, scans = _scan_state(spark, d)
    return state.to_scan(files, scans, "r1").select("project_id", "path", "file_hash")


@query
def jn_18_reused(spark, d):
    files, scans = _scan_state(spark, d)
    return state.reused(files, scans, "r1").select("project_id", "path", "vulnerabilities")


@query
def jn_19_append_missing(spark, d):
    scores = project.file_scores(project.file_metadata(fx.code_files(spark, d)))
    chosen = project.fallback_files(scores, 3).withColumnRenamed("rank", "ord")
    return project.append_missing(chosen, scores)


@query
def jn_20_recommendations(spark, d):
    found = fx.findings(spark, d)
    advice = found.where("vulnerability_type is not null") \
        .select("project_id", "vulnerability_type").distinct().groupBy("project_id").agg(
            F.to_json(F.array_sort(F.collect_list(F.struct(
                "vulnerability_type", F.lit("why").alias("risk_explanation"),
                F.array(F.lit("stated.py")).alias("affected_files"))))).alias("response"))
    return rs.parse_recommendations(advice, report.affected_files(found)).select(
        "project_id", "vulnerability_type", "risk_explanation",
        F.size("affected_files").alias("files"), F.md5(joined("affected_files")).alias("digest"))


@query
def jn_21_context(spark, d):
    files = fx.code_files(spark, d)
    context = manifests.project_context(fx.root_files(spark, d))
    out = project.with_context(files, context)
    return out.select("project_id", "path", "purpose", "entry_point", "security_relevant",
                      joined(F.array_sort(F.map_keys("frameworks"))).alias("frameworks"),
                      joined(F.array_sort(F.map_keys("dependencies"))).alias("dependencies"))


# Files of any length: the results of the queries above, from tables instead of arrays on a file row.

LONG_FILE = 1_000       # lines; files from here on are answered by tables


def long_analysis_of(spark, d, result):
    return flow_tables.table(fx.long_files(spark, d, True), result, lines=LONG_FILE)


@query
def jn_01_long_files(spark, d):
    return long_analysis_of(spark, d, "sources").where("parent_line is not null").select(
        "project_id", "path", "line_no", "source_type", "source_code", "source_pattern", "derived_variable",
        "parent_line", "parent_pattern")


@query
def jn_03_long_files(spark, d):
    tables = flow_tables.FlowTables(fx.long_files(spark, d, True), result="references")
    keys = ["project_id", "path", "name"]
    found = tables.references(by_name=True).groupBy(*keys).agg(
        F.count("*").alias("uses"), F.sum("line_no").alias("line_sum"), F.min("context").alias("first_context"),
        F.max("context").alias("last_context"), F.countDistinct("ref_name").alias("ref_names"))
    return tables.variables.select(*keys, "var_ord").join(found, keys).select(
        "project_id", "path", "var_ord", "name", "uses", "line_sum", "first_context", "last_context", "ref_names")


@query
def itr_01_long_files(spark, d):
    return long_analysis_of(spark, d, "taints").where("hop > 0").select(
        "project_id", "path", "variable", "line_no", "source", "code", "transformed_from", "hop")


@query
def jn_08_12_long_files(spark, d):
    return long_analysis_of(spark, d, "flows").select(
        "project_id", "path", "source_type", "source_line", "source_code", "sink_type",
        "sink_line", "sink_code", "sanitized", F.size("sanitizers").alias("sanitizer_count"), "variable",
        joined("flow_path", " -> ").alias("flow_path"),
        joined("validation_bypass").alias("validation_bypass"), "sink_after_source")


@query
def jn_13_long_files(spark, d):
    return long_analysis_of(spark, d, "call_edges").select(
        "project_id", "path", "call_ord", "callee", "line_no", "caller", "caller_line")


@query
def jn_15_long_files(spark, d):
    return long_analysis_of(spark, d, "validation_attempts").select(
        "project_id", "path", "line_no", "code", "input_line")


@query
def jn_07_chained_calls(spark, d):
    """Taint that goes on through the values of called functions; some lines compare with such a value."""
    files = fx.code_files(spark, d)
    files = files.withColumn("content", F.replace("content", F.lit("validate("), F.lit("v0 == check(")))
    return dataflow.table(files, "taints", chain_calls=True).where("hop > 0").select(
        "project_id", "path", "variable", "line_no", "source", "code", "transformed_from", "hop")


# --- aggregates, rankings, sets ---------------------------------------------------------------

@query
def ag_01_severity(spark, d):
    return report.severity_breakdown(fx.findings(spark, d))


@query
def ag_02_types(spark, d):
    return report.finding_types(fx.findings(spark, d)).select(
        "project_id", "unique_vulnerability_types",
        joined("vulnerability_types").alias("vulnerability_types"))


@query
def ag_03_11_risk(spark, d):
    scanned = fx.code_files(spark, d).select("project_id", "path")
    kept = report.confident(fx.findings(spark, d))
    return report.with_risk_score(report.totals(kept, scanned))


@query
def ag_04_by_type(spark, d):
    return report.by_type(fx.findings(spark, d))


@query
def ag_05_type_severity(spark, d):
    return report.type_by_severity(fx.findings(spark, d))


@query
def ag_06_by_file(spark, d):
    return report.by_file(fx.findings(spark, d))


@query
def ag_07_share(spark, d):
    return report.severity_share(fx.findings(spark, d))


@query
def ag_08_affected_files(spark, d):
    return report.affected_files(fx.findings(spark, d)).select(
        "project_id", "vulnerability_type", F.size("affected_files").alias("files"),
        F.md5(joined("affected_files")).alias("digest"))


@query
def ag_09_file_score(spark, d):
    scores = project.file_scores(project.file_metadata(fx.code_files(spark, d)))
    return scores.select("project_id", "path", "score", joined("reasons").alias("reasons"))


@query
def ag_10_fallback_score(spark, d):
    return project.fallback_scores(corpus.select_source_files(fx.repo_files(spark, d)))


@query
def ag_12_structure_hash(spark, d):
    return state.structure_hash(fx.code_files(spark, d))


@query
def ag_13_state_counts(spark, d):
    files, scans = _scan_state(spark, d)
    rows = {"file_scans": scans, "project_scans": _saved_selections(files), "metadata": _metadata(spark, d)}
    return state.row_counts({name: state.latest(frame, state.TABLES[name][0], state.CLOCK[name])
                             for name, frame in rows.items()})


@query
def ag_14_summary(spark, d):
    scanned = fx.code_files(spark, d).select("project_id", "path")
    kept = report.confident(fx.findings(spark, d))
    return report.summary(kept, scanned).select(
        "project_id", "files_scanned", "vulnerabilities_found", "unique_vulnerability_types",
        "risk_score", F.col("severity_breakdown.Critical").alias("critical"),
        F.col("severity_breakdown.Low").alias("low"),
        joined("vulnerability_types").alias("vulnerability_types"),
        F.size("critical_files").alias("critical_files"))


@query
def tk_01_top_files(spark, d):
    return project.top_files(project.file_scores(project.file_metadata(fx.code_files(spark, d))))


@query
def tk_02_fallback_files(spark, d):
    files = corpus.select_source_files(fx.repo_files(spark, d))
    return project.fallback_files(project.fallback_scores(files))


@query
def tk_03_top_finding_files(spark, d):
    return report.top_finding_files(fx.findings(spark, d))


@query
def tk_04_examples(spark, d):
    return report.example_findings(fx.findings(spark, d)).select(
        "project_id", "vulnerability_type", "example_ord", "file", "line", "description")


@query
def tk_05_first_per_file(spark, d):
    found = dataflow.analyze(fx.code_files(spark, d), results=["suspicious_patterns"])
    first = found.withColumn("first", F.slice("suspicious_patterns", 1, 5))
    return dataflow.rows_of(first, "first", "ord").select(
        "project_id", "path", "ord", "type", "line_no", "pattern")


@query
def tk_06_first_per_project(spark, d):
    return report.first_findings(fx.findings(spark, d)).select(
        "project_id", "finding_ord", "file", "line", "vulnerability_type")


@query
def tk_07_finding_files(spark, d):
    return report.files_with_findings(fx.findings(spark, d))


@query
def set_01_union(spark, d):
    found = fx.findings(spark, d)
    cross = found.select("project_id", "file", "vulnerability_type", "severity")
    return report.union_findings(found, cross).groupBy("project_id").agg(
        F.count("*").alias("findings"), F.count("description").alias("described"))


@query
def set_02_03_lists(spark, d):
    """Distinct names of a file, and the sink types it does not reach."""
    a = dataflow.analyze(fx.code_files(spark, d), results=["sinks", "function_calls"])
    kinds = F.array(*[F.lit(k) for k in ("xss", "sql_injection", "command_injection")])
    found = F.array_distinct(F.transform("sinks", lambda s: s.sink_type))
    return a.select(
        "project_id", "path",
        joined(F.array_sort(F.array_distinct(F.transform(
            "function_calls", lambda c: c.function)))).alias("functions"),
        joined(F.array_sort(F.array_except(kinds, found))).alias("missing"))


# --- sinks, responses, state ------------------------------------------------------------------

def _scratch(spark, name):
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def snk_01_json_round_trip(spark, d):
    path = _scratch(spark, "json")
    found = fx.findings(spark, d).drop("data_flow")
    report.write_json(found, path)
    return spark.read.schema(found.schema).json(path).select(*found.columns)


@query
def snk_03_report_tables(spark, d):
    path = _scratch(spark, "report")
    files = fx.code_files(spark, d).select("project_id", "path")
    report.write_report_tables(report.confident(fx.findings(spark, d)), files, path)
    counts = [spark.read.parquet(f"{path}/{t}").agg(F.count("*").alias("rows")).select(
        F.lit(t).alias("name"), "rows") for t in ("summary", "by_type", "by_file", "file_tiers")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query
def inc_04_clear(spark, d):
    """State tables after results were saved for all projects, cleared, and saved for some."""
    files, _ = _scan_state(spark, d)
    store = state.ScanState(spark, _scratch(spark, "state"), buckets=16)
    none = fx.findings(spark, d).where("false")
    store.save_file_results(files, none, 1.0, "r1")
    store.clear()
    store.save_file_results(files.where("project_id < 5"), none, 2.0, "r1")
    return store.stats()


@query
def snk_02_csv_rows(spark, d):
    rows = report.csv_rows(fx.findings(spark, d))
    return rows.toDF(*[c.lower().replace(" ", "_") for c in rows.columns])


@query
def jsn_01_03_findings(spark, d):
    return rs.parse_findings(spread_small(fx.responses(spark, d))).select(
        "project_id", "file", "parse_path", "finding_ord", "line", "vulnerability_type",
        "description", "severity", "confidence", "cwe_id",
        joined("data_flow").alias("data_flow"))


@query
def jsn_01_conversations(spark, d):
    chats = fx.read(spark, d, "conversations").select(
        F.col("conv_id").alias("project_id"), F.col("turn").cast("string").alias("path"),
        F.concat(F.lit("Issue 1: Line "), F.col("turn"), F.lit(" "), F.col("text"),
                 F.lit(" XSS")).alias("response"))
    return rs.parse_findings(chats).select(
        "project_id", "file", "parse_path", "line", "vulnerability_type")


@query
def jsn_04_cross_findings(spark, d):
    calls = project.cross_file_calls(fx.code_files(spark, d))
    per_pair = calls.groupBy("project_id", "caller_file", "called_file").agg(
        F.min("called_entity").alias("entity"))
    answer = per_pair.select("project_id", F.to_json(F.array(F.struct(
        F.array("caller_file", "called_file").alias("files_involved"),
        F.array("entity").alias("functions_involved"),
        F.lit("SQL Injection").alias("vulnerability_type"), F.lit(0.8).alias("confidence"),
    ))).alias("response"))
    return rs.parse_cross_findings(answer).select(
        "project_id", "file", "line", "cwe_id", "code_snippet", "confidence",
        joined("functions_involved").alias("functions_involved"))


@query
def jsn_05_patterns(spark, d):
    merged = fx.project_patterns(spark, d).where("kind = 'custom_function'") \
        .groupBy("project_id", "name").agg(
            F.max_by("impact", F.struct("file_ord", "impact")).alias("impact"))
    answer = merged.select(
        "project_id", F.lit(0).alias("file_ord"), F.concat(
            F.lit("Sure: "), F.to_json(F.struct(
                F.map_from_arrays(F.array("name"), F.array(F.struct(
                    F.col("impact").alias("potential_security_impact")))).alias("custom_functions"),
                F.array(F.concat("name", F.lit("_t"))).alias("data_transformations"),
            )), F.lit(" ok")).alias("response"))
    return rs.parse_patterns(answer).select("project_id", "kind", "name", "impact")


@query
def jsn_07_selection(spark, d):
    lists = fx.code_files(spark, d).select("project_id", "path", F.concat(
        F.lit('["'), F.col("path"), F.lit('", "other.py"]')).alias("response"))
    odd = F.when(F.col("path").like("%.go"), F.concat(F.lit("Files: "), F.col("response"))) \
        .otherwise(F.col("response"))
    return rs.parse_selection(lists.select(F.col("path").alias("project_id"),
                                           odd.alias("response")))


@query
def inc_01_upsert(spark, d):
    _, scans = _scan_state(spark, d)
    newer = scans.where("last_modified < 50").withColumn("last_scanned", F.lit(2.0)) \
        .withColumn("vulnerabilities", F.lit("[1]"))
    return state.upsert(scans, newer, "file_scans").select(
        "file_hash", "file_path", "last_scanned", "vulnerabilities")


@query
def inc_02_cached_selection(spark, d):
    files = fx.code_files(spark, d)
    return state.cached_selection(state.structure_hash(files), _saved_selections(files), "r1").select(
        "project_id", joined("critical_files").alias("critical_files"))


@query
def inc_03_metadata(spark, d):
    return state.latest(_metadata(spark, d), ["key"], "last_updated").select(
        "key", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))
