"""Texts handed to a model between the stages: digests of the analysis, one row per request.

Only the data part is built; instructions are the caller's. First-n slices, where asked for, are taken
from the per-file arrays, so no ranking is needed for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import shorten_middle
from tracewell.operators.dataflow import analyze
from tracewell.operators.facts import KEYS
from tracewell.operators.project import with_context
from tracewell.operators.ranges import paged
from tracewell.plans.report import PAGE_BYTES
from tracewell.sources.corpus import head
from tracewell.sources.manifests import SUMMARY_NAMES

DIGESTED = ("flows", "taints", "validation_attempts", "suspicious_patterns")
PATTERN_LISTS = {
    "Custom security functions": "security_names",
    "Data transformation functions": "transform_names",
    "Validation functions": "validation_names",
    "Wrapper functions": "wrappers",
}


def _first(items: str | Column, n: int | None) -> Column:
    """The first ``n`` elements, or all."""
    column = F.col(items) if isinstance(items, str) else items
    return column if n is None else F.slice(column, 1, n)


def _section(title: str, items: Column, line) -> Column:
    """Title and one numbered text per item; empty when there are no items."""
    body = F.array_join(F.transform(items, lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), line(x))), "")
    return F.when(F.size(items) > 0, F.concat(F.lit(title), body)).otherwise("")


def _join(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def dataflow_digest(flows: int | None = None, taints: int | None = None, validations: int | None = None,
                    suspicious: int | None = None) -> Column:
    """Flows, taints, validations and suspicious lines of an analysed file as text: all, or the first n."""
    flow_text = _section(
        "Source-Sink Flows (potential vulnerabilities):\n", _first("flows", flows),
        lambda f: _join(
            f.source_type, " at line ", f.source_line, " flows to ", f.sink_type, " at line ",
            f.sink_line, "\n   Source: ", f.source_code, "\n   Flow Path: ",
            F.array_join(f.flow_path, " -> "), "\n   Sink: ", f.sink_code, "\n   Sanitized: ",
            F.initcap(f.sanitized.cast("string")), "\n\n"))
    taint_text = _section(
        "Taint Propagation:\n", _first("taints", taints),
        lambda t: _join(
            "Tainted variable '", t.variable, "' at line ", t.line_no, " from ", t.source,
            "\n   Transformations: ", F.array_join(t.transformations, ", "), "\n"))
    checks = _section(
        "\nValidation Attempts (potential bypasses):\n",
        _first("validation_attempts", validations),
        lambda v: _join(
            "Validation at line ", v.line_no, " for input from line ", v.input_line,
            "\n   Validation code: ", v.code, "\n   Potential bypass: ",
            F.when(F.size(v.bypasses) == 0, "No obvious bypasses detected")
            .otherwise(F.array_join(v.bypasses, "; ")), "\n\n"))
    odd = _section(
        "\nSuspicious Patterns:\n", _first("suspicious_patterns", suspicious),
        lambda s: _join(s.type, " at line ", s.line_no, ": ", s.description, "\n   Code: ",
                        s.code, "\n\n"))
    return _join("Data Flow Analysis Results:\n", flow_text, taint_text, checks, odd)


def file_requests(files: DataFrame, context: DataFrame | None = None,
                  patterns: DataFrame | None = None, instructions: str = "",
                  max_chars: int | None = None, flows: int | None = None, taints: int | None = None,
                  validations: int | None = None, suspicious: int | None = None,
                  dependencies: int | None = None) -> DataFrame:
    """One request per file: context, digest and code, its middle cut out beyond ``max_chars``.

    Flows to dependencies are all named unless only the first n are asked for.
    Everything stays on the file row, so no join is needed beyond the per-project lookups.
    """
    code = F.col("content")
    if max_chars is not None:
        code = shorten_middle(code, max_chars)
    own = ["content", "hint", "purpose", "endpoints"]
    shared = [] if context is None else ["frameworks", "dependencies"]
    analysed = analyze(with_context(files, context), patterns, DIGESTED,
                       keep=[*own, *shared, *PATTERN_LISTS.values()])

    def keys(name, n=None):
        if context is None:
            return F.lit("")
        names = F.array_sort(F.map_keys(name))
        return F.coalesce(F.array_join(_first(names, n), ", "), F.lit(""))

    nothing = F.array().cast("array<string>")
    known = [part for title, column in PATTERN_LISTS.items() for part in (
        f"\n- {title}: ", F.array_join(F.coalesce(column, nothing), ", "))]
    prompt = _join(
        "File: ", F.col("path"), "\nLanguage: ", F.col("language"), "\n", F.col("hint"),
        "\n\nFile Context:\n- Framework: ", keys("frameworks"), "\n- Dependencies: ",
        keys("dependencies", dependencies), "\n- File purpose: ", F.col("purpose"),
        "\n- API endpoints: ", F.array_join("endpoints", ", "),
        "\n\nProject-Specific Patterns:", *known, "\n\n", dataflow_digest(flows, taints, validations, suspicious),
        "\nCode:\n```", F.col("language"), "\n", code, "\n```\n",
        instructions)
    return analysed.select(*KEYS, prompt.alias("prompt"))


def pattern_requests(sampled: DataFrame, instructions: str = "",
                     max_chars: int | None = None) -> DataFrame:
    """Sampled files with their code, or its first ``max_chars`` characters."""
    prompt = _join("File: ", F.col("path"), "\n\nCode:\n```", F.col("language"), "\n",
                   head(F.col("content"), max_chars), "\n```\n", instructions)
    return sampled.select(*KEYS, prompt.alias("prompt"))


def cross_file_requests(calls: DataFrame, findings: DataFrame,
                        instructions: str = "") -> DataFrame:
    """First calls with snippets and first findings of a project (both already cut to five)."""
    call = F.struct("call_ord", "caller_file", "caller_line", "called_entity", "called_file",
                    "called_line", "caller_code", "called_code")
    per_calls = calls.groupBy("project_id").agg(F.array_sort(F.collect_list(call)).alias("c"))
    per_finds = findings.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(
        "finding_ord", "vulnerability_type", "file", "line", "description"))).alias("v"))
    call_text = _section("Cross-File Function Calls:\n", F.col("c"), lambda c: _join(
        "File '", c.caller_file, "' line ", c.caller_line, " calls '", c.called_entity,
        "' from file '", c.called_file, "' line ", c.called_line,
        "\n   Caller code:\n```\n", c.caller_code, "\n```\n   Called code:\n```\n",
        c.called_code, "\n```\n\n"))
    found = F.coalesce("v", F.array().cast(
        "array<struct<finding_ord:int,vulnerability_type:string,file:string,line:int,"
        "description:string>>"))
    find_text = _section("Previously Identified Vulnerabilities:\n", found, lambda v: _join(
        F.coalesce(v.vulnerability_type, F.lit("None")), " in ", F.coalesce(v.file, F.lit("None")),
        " line ", F.coalesce(v.line.cast("string"), F.lit("None")), "\n   Description: ",
        F.coalesce(v.description, F.lit("None")), "\n\n"))
    return per_calls.join(per_finds, "project_id", "left").select(
        "project_id", _join(call_text, find_text, instructions).alias("prompt"))


def remediation_requests(examples: DataFrame, instructions: str = "") -> DataFrame:
    """Finding types of a project and their example findings as JSON."""
    empty = {"file": F.lit(""), "line": F.lit(0), "code_snippet": F.lit(""),
             "description": F.lit(""), "confidence": F.lit(0.0),
             "data_flow": F.array().cast("array<string>")}
    item = F.struct(*[F.coalesce(c, v).alias(c) for c, v in empty.items()])
    per_type = examples.groupBy("project_id", "vulnerability_type").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("example_ord", item.alias("item")))),
        lambda e: e.item).alias("items"))
    grouped = per_type.groupBy("project_id").agg(F.array_sort(F.collect_list(
        F.struct("vulnerability_type", "items"))).alias("t"))
    types = F.to_json(F.transform("t", lambda e: e.vulnerability_type))
    by_type = F.to_json(F.map_from_entries(F.transform(
        "t", lambda e: F.struct(e.vulnerability_type, e["items"]))))
    return grouped.select("project_id", _join(types, "\n", by_type, "\n", instructions)
                          .alias("prompt"))


def selection_requests(listing: DataFrame, scored: DataFrame, instructions: str = "",
                       page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``project_id, page, prompt``: the listing of a project and its scored paths, best first.

    Both lists are cut into pages of ``page_bytes``: a project with a long listing gets a request per page.
    """
    entry = F.to_json(F.struct("path", F.col("ext").alias("type"), F.col("size_bytes").alias("size"), "language"))
    best = scored.select("project_id", "path", "score")

    def pages(rows, order, text, name):
        return paged(rows, ["project_id"], order, text, page_bytes).groupBy("project_id", "page").agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "entry"))), lambda e: e.entry), ",").alias(name))

    tree = pages(listing.select("project_id", "path", "ext", "size_bytes", "language"), [F.asc("path")], entry, "tree")
    listed = pages(best, [F.desc("score"), F.asc("path")],
                   F.regexp_replace(F.to_json(F.array("path")), r"^\[|\]$", ""), "best")
    known = listing.select("project_id").distinct()
    both = tree.join(listed.join(known, "project_id", "left_semi"), ["project_id", "page"], "full")
    return both.select("project_id", "page", _join(
        "Project Structure:\n[", F.coalesce("tree", F.lit("")), "]",
        "\n\nAlready Identified Files With Security Indicators:\n[",
        F.coalesce("best", F.lit("")), "]\n", instructions).alias("prompt"))


def summary_requests(root_files: DataFrame, instructions: str = "",
                     max_chars: int | None = None) -> DataFrame:
    """Names of root files and the texts (or their heads) of the descriptive ones."""
    order = F.array_position(F.array(*[F.lit(n) for n in SUMMARY_NAMES]), F.col("name"))
    shown = F.when(order > 0, F.struct(order.alias("o"), _join(
        "\nContent of ", F.col("name"), ":\n", head(F.col("content"), max_chars), "\n").alias("t")))
    grouped = root_files.groupBy("project_id").agg(
        F.array_sort(F.collect_set("name")).alias("names"),
        F.array_sort(F.collect_list(shown)).alias("heads"))
    return grouped.select("project_id", _join(
        "Project root files: ", F.array_join("names", ", "), "\n\n",
        F.array_join(F.transform("heads", lambda h: h.t), ""), "\n", instructions)
        .alias("prompt"))
