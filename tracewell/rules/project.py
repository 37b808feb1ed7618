"""Project-specific rules: a user table of named functions turned into extra rules per project.

``project_patterns(project_id, kind, category, name, impact, file_ord, pattern_ord)`` with kinds
``custom_function`` (has an impact text), ``data_transformation``, ``validation_function``,
``wrapper_function`` and ``security_pattern`` (has a category).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expressions import null
from tracewell.operators.match import RULE
from tracewell.operators.sizing import lookup_join

SECURITY_CATEGORIES = ("authentication", "authorization", "encryption", "sanitization")
EXTRA = {
    "custom_rules": f"array<{RULE}>",
    "wrappers": "array<string>",
    "validation_names": "array<string>",
    "suspicious_names": "array<string>",
    "transform_names": "array<string>",
    "security_names": "array<string>",
}


def _has(*words: str):
    impact = F.lower(F.coalesce(F.col("impact"), F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | F.contains(impact, F.lit(word))
    return found


def merge_samples(patterns: DataFrame, sample_files: int | None = None) -> DataFrame:
    """Each pattern name once: the last place in the last file wins. ``sample_files`` cuts the files."""
    known = (F.col("kind") != "security_pattern") | F.col("category").isin(*SECURITY_CATEGORIES)
    if sample_files is not None:
        known = known & (F.col("file_ord") < sample_files)
    return patterns.where(known) \
        .groupBy("project_id", "kind", "category", "name") \
        .agg(F.max_by("impact", F.struct("file_ord", "pattern_ord")).alias("impact"))


def custom_rules(merged: DataFrame) -> DataFrame:
    """``project_id, role, rule_type, name`` for every rule a merged pattern gives rise to."""
    custom = F.col("kind") == "custom_function"
    runs = custom & _has("execute", "query", "sensitive", "critical")
    eased = custom & _has("validation", "sanitize", "secure", "transform", "encode")
    def rule(role, rule_type):
        return F.struct(F.lit(role).alias("role"), F.lit(rule_type).alias("rule_type"))

    checks = F.col("kind") == "validation_function"
    secured = (F.col("kind") == "security_pattern") & (F.col("category") == "sanitization")
    candidates = F.array(
        F.when(custom & _has("input", "user data", "request"), rule("source", "custom_input")),
        F.when(runs & _has("sql", "database"), rule("sink", "custom_sql"))
        .when(runs & _has("command", "exec"), rule("sink", "custom_command"))
        .when(runs & _has("output", "render"), rule("sink", "custom_output")),
        F.when(eased & _has("sanitize", "validate"), rule("sanitizer", "custom_sanitization")),
        F.when(checks, rule("sanitizer", "custom_validation")),
        F.when(secured, rule("sanitizer", "custom_sanitization")),
        F.when(custom & _has("unsafe", "vulnerable", "risky"),
               rule("suspicious", "custom_suspicious")),
        F.when(checks, rule("validation", "validation")),
        F.when(F.col("kind") == "wrapper_function", rule("wrapper", "wrapper")),
        F.when(F.col("kind") == "data_transformation", rule("transform", "transform")))
    return merged.select("project_id", "name", F.explode(F.array_compact(candidates)).alias("_r")) \
        .select("project_id", "_r.role", "_r.rule_type", "name")


def rules_per_project(patterns: DataFrame) -> DataFrame:
    merged = merge_samples(patterns)
    rules = custom_rules(merged).unionByName(
        merged.where(F.col("kind") == "security_pattern").select(
            "project_id", F.lit("security").alias("role"), F.lit("security").alias("rule_type"),
            "name"))

    def names(role):
        return F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("name"))))

    literal = F.when(
        F.col("role").isin("source", "sink", "sanitizer"),
        F.struct("role", "rule_type", F.lit(1000).alias("rule_ord"),
                 F.col("name").alias("pattern")))
    return rules.groupBy("project_id").agg(
        F.array_sort(F.collect_list(literal)).alias("custom_rules"),
        names("wrapper").alias("wrappers"), names("validation").alias("validation_names"),
        names("suspicious").alias("suspicious_names"), names("transform").alias("transform_names"),
        names("security").alias("security_names"))


def attach(files: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """Add the project's extra rules to every file row (null when there are none)."""
    if patterns is None:
        return files.withColumns({n: F.expr(null(t)) for n, t in EXTRA.items()})
    return lookup_join(files, rules_per_project(patterns), ["project_id"], "path")
