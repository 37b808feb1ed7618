"""Parsing of model responses into tables.

Parsing is permissive by element: an array is read as an array of JSON texts, each element is then
read on its own, and elements that are no objects are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.rows import explode_structs
from tracewell.functions.scalars import cwe_of, stripped

STRICT = {"allowSingleQuotes": "false"}
FINDING_TEXT = ("line string, vulnerability_type string, description string, severity string, "
                "confidence string, code_snippet string, cwe_id string, data_flow array<string>, "
                "remediation string")
CROSS_TEXT = ("files_involved array<string>, functions_involved array<string>, "
              "vulnerability_type string, description string, severity string, "
              "confidence string, cwe_id string, remediation string")
PATTERNS = ("custom_functions map<string,struct<purpose:string,potential_security_impact:string,"
            "parameters:array<string>,called_by:array<string>,calls:array<string>>>, "
            "data_transformations array<string>, validation_functions array<string>, "
            "wrapper_functions array<string>, security_patterns map<string,array<string>>")
RECOMMENDATION = ("vulnerability_type string, risk_explanation string, "
                  "vulnerable_code_patterns string, secure_code_examples string, "
                  "best_practices string, security_references array<string>, root_causes string")

# Shapes looked for in a response that is not clean JSON, and texts filled in.
ARRAY_BLOCK = r"(?s)(\[\s*\{.*\}\s*\])"
EMPTY_ARRAY = r"\[\s*\]"
TEXT_FINDING = (r"(?s)(Vulnerability|Issue|Problem) \d+:.*?Line (\d+).*?(SQL Injection|XSS|"
                r"Command Injection|Path Traversal|Insecure Deserialization|Weak Cryptography|"
                r"Code Injection)")
TEXT_DESCRIPTION = "Extracted from non-JSON response"
TEXT_REMEDIATION = "See detailed scanner logs for more information"
DEFAULTS = {
    "vulnerability_type": "Unknown", "description": "No description provided",
    "severity": "Medium", "code_snippet": "", "cwe_id": "", "remediation": "",
}
CROSS_HEADING = "Cross-file vulnerability between files:\n"


def _wrapped(value: Column) -> Column:
    """The JSON values in ``value`` as texts; exactly one when it is one valid document."""
    return F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", STRICT)


def _is_json(value: Column) -> Column:
    return F.coalesce(F.size(_wrapped(value)) == 1, F.lit(False))


def _elements(value: Column) -> Column:
    return F.from_json(value, "array<string>", STRICT)


def _objects(elements: Column, schema: str) -> Column:
    """Elements that are objects, each read on its own."""
    texts = F.filter(elements, lambda e: F.coalesce(F.startswith(e, F.lit("{")), F.lit(False)))
    return F.transform(texts, lambda e: F.from_json(e, schema, STRICT))


def parse_findings(responses: DataFrame) -> DataFrame:
    """Findings from ``responses(project_id, path, response)``, with the branch that gave them."""
    body = stripped(F.coalesce(F.col("response"), F.lit("")))
    block = F.regexp_extract(F.col("body"), ARRAY_BLOCK, 1)
    opens = F.col("body").startswith("[") | F.col("body").startswith("{")
    laddered = responses.withColumn("body", body).withColumn("block", block).withColumn(
        "parse_path",
        F.when(F.col("body") == "", "blank")
        .when(opens & _is_json(F.col("body")),
              F.when(F.col("body").startswith("["), "clean").otherwise("object"))
        .when((F.col("block") != "") & _is_json(F.col("block")), "block")
        .when(F.col("body").rlike(EMPTY_ARRAY), "empty")
        .when(F.col("body").rlike(TEXT_FINDING), "text")
        .otherwise("none"))
    source = F.when(F.col("parse_path") == "clean", F.col("body")) \
        .when(F.col("parse_path") == "block", F.col("block"))
    parsed = _objects(_elements(source), FINDING_TEXT)
    lines = F.regexp_extract_all("body", F.lit(TEXT_FINDING), F.lit(2))
    kinds = F.regexp_extract_all("body", F.lit(TEXT_FINDING), F.lit(3))

    def from_text(line, i):
        return F.struct(
            line.alias("line"), F.get(kinds, i).alias("vulnerability_type"),
            F.lit(TEXT_DESCRIPTION).alias("description"), F.lit("Medium").alias("severity"),
            F.lit("0.5").alias("confidence"), F.lit("").alias("code_snippet"),
            F.lit(None).cast("string").alias("cwe_id"),
            F.lit(None).cast("array<string>").alias("data_flow"),
            F.lit(TEXT_REMEDIATION).alias("remediation"))

    rows = laddered.withColumn(
        "found", F.when(F.col("parse_path") == "text", F.transform(lines, from_text))
        .otherwise(parsed))
    found = explode_structs(rows, ["project_id", "path", "parse_path"], "found", "finding_ord")
    return _with_defaults(found.withColumnRenamed("path", "file"))


def _with_defaults(found: DataFrame) -> DataFrame:
    """Fill missing fields of cleanly parsed findings and back-fill the weakness number."""
    clean = F.col("parse_path") == "clean"
    filled = found.withColumns({
        name: F.when(clean, F.coalesce(F.col(name), F.lit(value))).otherwise(F.col(name))
        for name, value in DEFAULTS.items()
    }).withColumns({
        "line": F.when(clean, F.coalesce(F.expr("try_cast(line as int)"), F.lit(0)))
        .otherwise(F.expr("try_cast(line as int)")),
        "confidence": F.when(
            clean & F.col("confidence").isNull(), F.lit(0.5)
        ).otherwise(F.expr("try_cast(confidence as double)")),
    })
    wants = (clean & (F.col("cwe_id") == "") & (F.col("vulnerability_type") != "Unknown")) \
        | (F.col("parse_path") == "text")
    return filled.withColumn("cwe_id", F.when(
        wants, F.coalesce(cwe_of(F.col("vulnerability_type")), F.col("cwe_id"))
    ).otherwise(F.col("cwe_id")))


def ladder(responses: DataFrame) -> DataFrame:
    """Findings per branch of the ladder."""
    return parse_findings(responses).groupBy("parse_path").agg(F.count("*").alias("findings"))


def parse_cross_findings(responses: DataFrame) -> DataFrame:
    """Cross-file findings of ``responses(project_id, response)``; anything but JSON gives none."""
    body = F.col("response")
    rows = responses.withColumn("found", F.when(
        _is_json(body) & stripped(body).startswith("["), _objects(_elements(body), CROSS_TEXT)))
    found = explode_structs(rows, ["project_id"], "found", "finding_ord")
    files = F.coalesce("files_involved", F.array().cast("array<string>"))
    snippet = F.concat(F.lit(CROSS_HEADING), F.array_join(F.transform(
        files, lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), ""))
    blank = F.coalesce(F.col("cwe_id"), F.lit("")) == ""
    typed = F.coalesce(F.col("vulnerability_type"), F.lit("")) != ""
    return found.withColumns({
        "code_snippet": snippet, "line": F.lit(0),
        "file": F.get(files, F.lit(0)),
        "confidence": F.expr("try_cast(confidence as double)"),
        "cwe_id": F.when(blank & typed, F.coalesce(cwe_of(F.col("vulnerability_type")), "cwe_id"))
        .otherwise(F.col("cwe_id")),
    })


def parse_patterns(responses: DataFrame) -> DataFrame:
    """Pattern responses (``project_id, file_ord, response``) as ``project_patterns`` rows.

    ``pattern_ord`` is the place in the response, so that merging has a total order.
    """
    body = stripped(F.col("response"))
    outer = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    source = F.when(_is_json(body), body).when((outer != "") & _is_json(outer), outer)
    read = responses.withColumn("_p", F.from_json(source, PATTERNS, STRICT))

    def entry(kind, category, name, impact):
        return F.struct(F.lit(kind).alias("kind"), category.alias("category"), name.alias("name"),
                        impact.alias("impact"))

    none = F.lit(None).cast("string")

    def plain(field, kind):
        return F.transform(F.coalesce(F.col(f"_p.{field}"), F.array().cast("array<string>")),
                           lambda n: entry(kind, none, n, none))

    custom = F.transform(
        F.map_entries("_p.custom_functions"),
        lambda e: entry("custom_function", none, e.key, e.value.potential_security_impact))
    secure = F.flatten(F.transform(
        F.map_entries("_p.security_patterns"),
        lambda e: F.transform(e.value, lambda n: entry("security_pattern", e.key, n, none))))
    nothing = F.array().cast(
        "array<struct<kind:string,category:string,name:string,impact:string>>")
    rows = read.withColumn("_rows", F.concat(
        F.coalesce(custom, nothing), plain("data_transformations", "data_transformation"),
        plain("validation_functions", "validation_function"),
        plain("wrapper_functions", "wrapper_function"), F.coalesce(secure, nothing)))
    return explode_structs(rows, ["project_id", "file_ord"], "_rows", "pattern_ord")


def parse_recommendations(responses: DataFrame, affected: DataFrame) -> DataFrame:
    """Recommendations with the affected files found in the data instead of the stated ones."""
    body = F.col("response")
    rows = responses.withColumn("found", F.when(
        _is_json(body) & stripped(body).startswith("["),
        _objects(_elements(body), RECOMMENDATION)))
    found = explode_structs(rows, ["project_id"], "found", "rec_ord")
    return found.join(affected, ["project_id", "vulnerability_type"], "left").withColumn(
        "affected_files", F.coalesce("affected_files", F.array().cast("array<string>")))


def parse_selection(responses: DataFrame) -> DataFrame:
    """File lists: the response must be one JSON array; its texts in order."""
    body = F.col("response")
    paths = F.when(_is_json(body) & stripped(body).startswith("["), _elements(body))
    numbered = responses.select("project_id", F.posexplode_outer(paths).alias("_o", "path")) \
        .where(F.col("path").isNotNull())
    return numbered.groupBy("project_id", "path").agg((F.min("_o") + 1).alias("ord"))
