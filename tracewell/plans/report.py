"""Filters, aggregates, rankings and sinks over findings.

``findings(project_id, file, line, vulnerability_type, description, severity, confidence,
code_snippet, cwe_id, data_flow, remediation)``; scanned files are ``scanned(project_id, path)``.
Counts are combined before their shuffle, so a project that holds most findings costs one small
row per task; distinct files are counted after reducing to one row per project and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.scalars import basename, confidence_bucket
from tracewell.operators.ranges import paged
from tracewell.operators.sizing import written

# Severities, their weights in the risk score, report columns and count tiers.
SEVERITIES = ["Critical", "High", "Medium", "Low"]
WEIGHTS = {"Critical": 10, "High": 7, "Medium": 4, "Low": 1}
CSV_COLUMNS = {
    "File": "file", "Line": "line", "Vulnerability Type": "vulnerability_type",
    "Severity": "severity", "Confidence": "confidence", "Description": "description",
    "CWE": "cwe_id", "Code Snippet": "code_snippet", "Remediation": "remediation",
}
CONFIDENCE_THRESHOLD = 0.7
SPREAD = 8
PAGE_BYTES = 1 << 20    # of a list that goes into one row


def union_findings(per_file: DataFrame, cross_file: DataFrame) -> DataFrame:
    return per_file.unionByName(cross_file, allowMissingColumns=True)


def confident(findings: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    return findings.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def file_label() -> Column:
    name = basename(F.col("file"))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(name)


def type_label() -> Column:
    return F.coalesce("vulnerability_type", F.lit("Unknown"))


def report_filter(findings: DataFrame, severity: str = "all", confidence: str = "all",
                  file: str = "all") -> DataFrame:
    """Report filter: every condition must hold, ``all`` lets everything pass."""
    kept = findings
    if severity != "all":
        kept = kept.where(F.coalesce("severity", F.lit("Medium")) == severity)
    if confidence != "all":
        kept = kept.where(
            confidence_bucket(F.coalesce("confidence", F.lit(0.5))) == confidence)
    if file != "all":
        kept = kept.where(file_label() == file)
    return kept


def severity_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id").agg(*[
        F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def finding_types(findings: DataFrame) -> DataFrame:
    per_type = findings.select("project_id", type_label().alias("t")).distinct()
    return per_type.groupBy("project_id").agg(
        F.count("*").alias("unique_vulnerability_types"),
        F.array_sort(F.collect_list("t")).alias("vulnerability_types"))


def weight() -> Column:
    """What a finding adds to the risk."""
    value_of = F
    for name, value in WEIGHTS.items():
        value_of = value_of.when(F.coalesce("severity", F.lit("Low")) == name, value)
    return value_of.otherwise(1)


def totals(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """Scanned files, findings, files with findings and severity weight per project.

    Projects count that have either; findings of a project without a scanned file are kept.
    """
    per_file = findings.groupBy("project_id", F.coalesce("file", F.lit("")).alias("f")).agg(
        F.count("*").alias("n"), F.sum(weight()).alias("w"))
    found = per_file.groupBy("project_id").agg(
        F.sum("n").alias("vulnerabilities_found"), F.count("*").alias("files_with_findings"),
        F.sum("w").alias("severity_weight"))
    counted = scanned.groupBy("project_id").agg(F.count("*").alias("files_scanned"))
    joined = counted.join(found, "project_id", "full")
    return joined.select("project_id", *[
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        for c in ("files_scanned", "vulnerabilities_found", "files_with_findings", "severity_weight")])


def with_risk_score(counted: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.col("files_scanned")).cast("double")
    raw = F.col("severity_weight").cast("double") / n * 25.0 \
        + F.col("files_with_findings").cast("double") / n * 75.0
    return counted.withColumn(
        "risk_score", F.least(F.lit(100), F.floor(raw).cast("bigint")).cast("int"))


def by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", type_label().alias("vulnerability_type")) \
        .agg(F.count("*").alias("findings"))


def type_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", type_label().alias("vulnerability_type")).agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", file_label().alias("file")) \
        .agg(F.count("*").alias("findings"))


def severity_share(findings: DataFrame) -> DataFrame:
    """Percent of each severity that occurs, per project."""
    wide = severity_breakdown(findings)
    total = sum((F.col(s.lower()) for s in SEVERITIES[1:]), F.col("critical"))
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s.lower()).alias("n"))
                      for s in SEVERITIES])
    return wide.select("project_id", total.alias("total"), F.explode(pairs).alias("p")) \
        .where("p.n > 0").select(
            "project_id", "p.severity",
            F.col("p.n").alias("findings"),
            (F.col("p.n").cast("double") / F.col("total").cast("double") * 100.0).alias("percent"))


def affected_files(findings: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Distinct files per type in pages: ``project_id, vulnerability_type, page, affected_files``.

    A list of up to ``page_bytes`` is page 0 alone; a longer one goes on in further rows.
    """
    once = findings.select("project_id", "vulnerability_type",
                           F.coalesce("file", F.lit("")).alias("f")).distinct()
    keys = ["project_id", "vulnerability_type"]
    return paged(once, keys, [F.asc("f")], F.col("f"), page_bytes).groupBy(*keys, "page").agg(
        F.array_sort(F.collect_list("f")).alias("affected_files"))


def top_finding_files(findings: DataFrame, n: int = 5) -> DataFrame:
    order = W.partitionBy("project_id").orderBy(F.desc("findings"), "file")
    return by_file(findings).withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= n)


def example_findings(findings: DataFrame, n: int = 3) -> DataFrame:
    """The first findings of each type by file and line."""
    order = W.partitionBy("project_id", "vulnerability_type").orderBy(
        "file", "line", "severity", "confidence", "description")
    return findings.withColumn("example_ord", F.row_number().over(order)) \
        .where(F.col("example_ord") <= n)


def first_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    order = W.partitionBy("project_id").orderBy(
        "file", "line", "vulnerability_type", "severity", "confidence", "description")
    return findings.withColumn("finding_ord", F.row_number().over(order)) \
        .where(F.col("finding_ord") <= n)


def files_with_findings(findings: DataFrame) -> DataFrame:
    return findings.select("project_id", basename(F.col("file")).alias("file")) \
        .where(F.coalesce("file", F.lit("")) != "").distinct()


def file_tiers(selected: DataFrame, findings: DataFrame) -> DataFrame:
    """Finding count and colour tier of each selected file."""
    counted = findings.groupBy("project_id", F.col("file").alias("path")) \
        .agg(F.count("*").alias("findings"))
    n = F.coalesce("findings", F.lit(0)).cast("bigint")
    return selected.join(counted, ["project_id", "path"], "left").select(
        "project_id", "path", n.alias("findings"),
        F.when(n > 5, "danger").when(n > 2, "warning").when(n > 0, "info").otherwise("")
        .alias("tier"))


def summary(findings: DataFrame, scanned: DataFrame, recommendations: DataFrame | None = None,
            duration_seconds: float | None = None, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One record per project with totals, risk, breakdown and lists.

    Findings are read once. The scanned files of a project are listed in pages of ``page_bytes``; a project with
    more has further records (``page`` 1 and so on) with the same totals.
    """
    nothing = F.array().cast("array<string>")
    each = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    per_file = findings.groupBy("project_id", F.coalesce("file", F.lit("")).alias("f"), type_label().alias("t")).agg(
        F.count("*").alias("n"), F.sum(weight()).alias("w"), *each)
    found = per_file.groupBy("project_id").agg(
        F.sum("n").alias("vulnerabilities_found"), F.count_distinct("f").alias("files_with_findings"),
        F.sum("w").alias("severity_weight"), F.array_sort(F.collect_set("t")).alias("vulnerability_types"),
        *[F.sum(s.lower()).alias(s.lower()) for s in SEVERITIES])
    counted = scanned.groupBy("project_id").agg(F.count("*").alias("files_scanned")).join(found, "project_id", "full")
    out = with_risk_score(counted.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in (
        "files_scanned", "vulnerabilities_found", "files_with_findings", "severity_weight")})) \
        .withColumn("unique_vulnerability_types", F.size(F.coalesce("vulnerability_types", nothing)))
    paths = paged(scanned.select("project_id", "path").distinct(), ["project_id"], [F.asc("path")], F.col("path"),
                  page_bytes).groupBy("project_id", "page").agg(F.array_sort(F.collect_list("path")).alias("critical_files"))
    out = out.join(paths, "project_id", "left").withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
    zero = {s.lower(): F.coalesce(s.lower(), F.lit(0)).cast("bigint") for s in SEVERITIES}
    columns = [
        "project_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        .alias("scan_date"), "files_scanned", "vulnerabilities_found",
        F.coalesce("unique_vulnerability_types", F.lit(0)).cast("bigint")
        .alias("unique_vulnerability_types"), "risk_score",
        F.struct(*[zero[s.lower()].alias(s) for s in SEVERITIES]).alias("severity_breakdown"),
        F.coalesce("critical_files", nothing).alias("critical_files"),
        F.coalesce("vulnerability_types", nothing).alias("vulnerability_types"),
        F.lit(duration_seconds).cast("double").alias("scan_duration_seconds"), "page"]
    if recommendations is not None:
        listed = recommendations.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(
            "vulnerability_type", "risk_explanation", "affected_files"))).alias("recommendations"))
        out = out.join(listed, "project_id", "left")
        columns.append("recommendations")
    return out.select(*columns)


# --- sinks ------------------------------------------------------------------------------------

def csv_rows(findings: DataFrame) -> DataFrame:
    """The nine report columns as text, missing values empty."""
    return findings.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(label)
        for label, c in CSV_COLUMNS.items()])


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).option("quote", '"') \
        .option("escape", '"').option("emptyValue", "").csv(path)


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines in one folder per project, in at most ``SPREAD`` files each."""
    part = F.pmod(F.xxhash64(*findings.columns[:3]), F.lit(SPREAD))
    findings.repartition("project_id", part).write.mode("overwrite").partitionBy("project_id").json(path)


def write_report_tables(findings: DataFrame, scanned: DataFrame, path: str) -> None:
    """The data behind the report page, one Parquet table each; findings and files are computed once."""
    findings, scanned = written(findings, "findings"), written(scanned.select("project_id", "path"), "scanned")
    for name, frame in {
        "summary": summary(findings, scanned), "by_type": by_type(findings),
        "type_by_severity": type_by_severity(findings), "by_file": by_file(findings),
        "severity_share": severity_share(findings), "top_files": top_finding_files(findings),
        "files_with_findings": files_with_findings(findings),
        "file_tiers": file_tiers(scanned, findings),
    }.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
