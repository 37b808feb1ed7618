"""Corpus scan: project files from storage into one table, filtered before content is touched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.scalars import LANGUAGE_OF, basename, extension, lookup
from tracewell.sources.filesource import read_files

# Names and suffixes that are not scanned.
IGNORE_PATTERNS = [
    r"\.git", r"\.svn", r"\.hg", r"\.bzr",
    r"node_modules", r"venv", r"__pycache__", r"env",
    r"dist", r"build", r"target", r"out", r"output",
    r"\.pyc$", r"\.min\.js$", r"\.min\.css$", r"\.bundle\.js$",
    r"\.jpg$", r"\.jpeg$", r"\.png$", r"\.gif$", r"\.ico$", r"\.svg$",
    r"\.pdf$", r"\.zip$", r"\.tar$", r"\.gz$", r"\.rar$", r"\.exe$",
]


def ignored(path: Column, patterns: Sequence[str] | None = None, anchor: bool = False) -> Column:
    """True when a pattern is found in any directory name or the file name of a relative path.

    With ``anchor`` a pattern without ``$`` must be a whole name, so ``out`` no longer hits
    ``routes``.
    """
    patterns = IGNORE_PATTERNS if patterns is None else patterns
    if not patterns:
        return F.lit(False)
    if anchor:
        patterns = [p if p.endswith("$") else f"^(?:{p})$" for p in patterns]
    any_pattern = "|".join(f"(?:{p})" for p in patterns)
    parts = F.split(path, "/")
    directories = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    return F.exists(parts, lambda part: part.rlike(any_pattern)) | directories.rlike(any_pattern)


def select_source_files(listing: DataFrame, max_file_size: int | None = None,
                        ignore_patterns: Sequence[str] | None = None,
                        anchor: bool = False) -> DataFrame:
    """Keep rows of ``listing(project_id, path, size_bytes, ...)`` that are source files."""
    fits = F.lit(True) if max_file_size is None else F.col("size_bytes") <= max_file_size
    named = listing.withColumn("name", basename(F.col("path"))) \
        .withColumn("ext", extension(F.col("name"))) \
        .withColumn("language", lookup(F.col("ext"), LANGUAGE_OF))
    return named.where(
        F.col("language").isNotNull()
        & fits
        & ~ignored(F.col("path"), ignore_patterns, anchor))


def first_files(files: DataFrame, max_files: int) -> DataFrame:
    """At most ``max_files`` per project by path; Spark trims each partition before the shuffle."""
    order = W.partitionBy("project_id").orderBy("path")
    return files.withColumn("_rank", F.row_number().over(order)) \
        .where(F.col("_rank") <= max_files).drop("_rank")


def decode_text(content: Column) -> Column:
    """Bytes to text: invalid bytes dropped, CRLF and CR folded to LF."""
    valid = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.replace(F.replace(valid, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def scannable(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Drop empty files, and those over a character cap if one is given."""
    size = F.length("content")
    return files.where(size > 0 if max_chars is None else (size > 0) & (size <= max_chars))


def head(content: Column, chars: int | None = None) -> Column:
    """The whole text, or its first ``chars`` characters."""
    return content if chars is None else F.left(content, F.lit(chars))


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """``root/<project>/...`` as ``project_id, path, size_bytes, mtime, content`` (bytes), by Spark's own reader.

    For storage that only Spark opens: the driver lists all folders, and only kinds without a language are left out
    before they are read. ``filesource.read_files`` reads less.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", f"*.{{{','.join(LANGUAGE_OF)}}}").load(root)
    prefix = root.rstrip("/") + "/"
    inner = F.substring(F.col("path"), F.instr(F.col("path"), prefix) + len(prefix), 1_000_000)
    return raw.select(
        F.substring_index(inner, "/", 1).alias("project_id"),
        F.regexp_extract(inner, r"^[^/]*/(.*)$", 1).alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").cast("double").alias("mtime"),
        "content")


def read_corpus(spark: SparkSession, root: str, max_file_size: int | None = None,
                max_files: int | None = None, ignore_patterns: Sequence[str] | None = None,
                anchor: bool = False, slices: int = 1, spark_only: bool = False) -> DataFrame:
    """Files of all projects under ``root`` (folders or archives), decoded, one row each.

    Ignored, oversized and empty files are never opened; ``slices`` tasks share a project's folder. With
    ``spark_only`` Spark's own reader is used instead, for storage that nothing else opens. The file cap is found
    on a listing without ``content``: a project over the cap gets its last kept path, and reading compares
    with it. Content is never shuffled.
    """
    patterns = IGNORE_PATTERNS if ignore_patterns is None else list(ignore_patterns)

    def listed(content: bool) -> DataFrame:
        if spark_only:
            found = read_listing(spark, root)
            return found if content else found.drop("content")
        return read_files(spark, root, patterns, anchor, list(LANGUAGE_OF), max_file_size, slices, content)

    files = select_source_files(listed(True), max_file_size, ignore_patterns, anchor)
    if max_files is not None:
        names = select_source_files(listed(False), max_file_size, ignore_patterns, anchor)
        order = W.partitionBy("project_id").orderBy("path")
        last = names.select("project_id", "path", F.row_number().over(order).alias("_rank")) \
            .where(F.col("_rank") == max_files) \
            .select("project_id", F.col("path").alias("_last"))
        files = files.join(last, "project_id", "left") \
            .where(F.col("_last").isNull() | (F.col("path") <= F.col("_last")))
    return files.select("project_id", "path", "name", "ext", "language", "size_bytes", "mtime",
                        decode_text(F.col("content")).alias("content"))
