"""Incremental scans: state tables that let unchanged files keep their results.

A table is dealt into buckets by a hash of its keys. A save decides on keys alone which saved rows are
superseded, writes the buckets it touches as a new version, and names it in a small table of commits, last of
all. A reader takes the last committed version of each bucket, so a save that did not end does not
count, and buckets without news keep their files. Saved payload is read and written, but not shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scalars import fingerprint
from tracewell.operators.sizing import only_wanted, written

TABLES = {
    "file_scans": (["project_id", "file_hash"], "project_id string, file_hash string, "
                   "file_path string, last_modified double, last_scanned double, vulnerabilities string, rules_version string"),
    "project_scans": (["project_id"], "project_id string, structure_hash string, "
                      "critical_files string, last_scanned double, rules_version string"),
    "metadata": (["key"], "key string, value string, last_updated double"),
}
CLOCK = {"file_scans": "last_scanned", "project_scans": "last_scanned",
         "metadata": "last_updated"}


BUCKETS = 256
COMMIT = "bucket int, number bigint, folder string"


def latest(rows: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """The newest row per key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(clock, *[c for c in others if c != clock]))
        .alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """The rows of ``old`` (one per key) with those of ``new`` that are as new or newer in their place.

    Keys and clocks decide. Old rows whose key is not in a bitmap of the superseded ones stay where they are
    read; only the few others are compared by an exact join.
    """
    keys, clock = TABLES[table][0], CLOCK[table]
    once = latest(new, keys, clock)
    before = old.select(*keys, F.col(clock).alias("_before"))
    wins = F.col("_before").isNull() | (F.col(clock) >= F.col("_before"))
    taken = written(once.join(before, keys, "left").where(wins).drop("_before").select(*old.columns), "news")
    gone = taken.select(*keys)
    doubtful = only_wanted(old, gone, keys).join(gone, keys, "left_anti")
    return only_wanted(old, gone, keys, keep=False).unionByName(doubtful).unionByName(taken)


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", fingerprint(F.col("path"), F.col("content")))


def _matches(scans: DataFrame, rules_version: str, *payload: str) -> DataFrame:
    """Keys (project as text, hash, modification time) of current results, with what is asked for.

    ``scans`` has one row per key, as ``ScanState.read`` gives it.
    """
    return scans.where(F.col("rules_version") == rules_version).select(
        F.col("project_id").alias("_project"), "file_hash", F.col("last_modified").alias("mtime"), *payload)


def _keyed(files: DataFrame) -> DataFrame:
    """Files by hash, without their content: only keys meet the saved results."""
    return with_hash(files).drop("content").withColumn("_project", F.col("project_id").cast("string"))


def to_scan(files: DataFrame, scans: DataFrame, rules_version: str) -> DataFrame:
    """Files (without content) whose fingerprint or modification time has no saved result.

    ``rules_version`` must name all that results depend on, project rules included.
    """
    known = _matches(scans, rules_version)
    return _keyed(files).join(known, ["_project", "file_hash", "mtime"], "left_anti").drop("_project")


def reused(files: DataFrame, scans: DataFrame, rules_version: str) -> DataFrame:
    """Files with a saved result, and that result."""
    known = _matches(scans, rules_version, "vulnerabilities")
    return _keyed(files).join(known, ["_project", "file_hash", "mtime"]).drop("_project")


def structure_hash(files: DataFrame) -> DataFrame:
    """Fingerprint of a project's listing, independent of row order.

    Paths are hashed to buckets first and each bucket is reduced on its own, so that no task sorts
    the listing of a whole project.
    """
    entry = F.concat_ws("|", "path", F.col("size_bytes").cast("string"), "language")
    bucket = F.left(F.md5("path"), F.lit(3))
    parts = files.groupBy("project_id", bucket.alias("b")).agg(
        F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("h"))
    return parts.groupBy("project_id").agg(F.md5(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("b", "h"))), lambda p: p.h), "\n"))
        .alias("structure_hash"))


def cached_selection(hashes: DataFrame, scans: DataFrame, rules_version: str) -> DataFrame:
    """Saved file lists of projects whose listing is unchanged."""
    current = scans.where(F.col("rules_version") == rules_version)
    return hashes.join(current, ["project_id", "structure_hash"]).select(
        "project_id", "structure_hash",
        F.from_json("critical_files", "array<string>").alias("critical_files"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows`` of the latest rows of state tables."""
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
              for t, rows in tables.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionAll(part)
    return out


class ScanState:
    """State tables under one folder of shared storage; ``buckets`` must stay the same for a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _commits(self, table: str) -> dict[int, tuple[int, str | None]]:
        """Number and folder of the last save of each bucket (no folder: cleared); ``BUCKETS`` entries at most."""
        try:
            commits = self.spark.read.schema(COMMIT).parquet(f"{self._path(table)}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        last = commits.groupBy("bucket").agg(F.max(F.struct("number", "folder")).alias("last")).collect()
        return {r.bucket: (r.last.number, r.last.folder) for r in last}

    def _rows(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        _, schema = TABLES[table]
        paths = [f"{self._path(table)}/data/{folder}/bucket={b}" for b, (_, folder) in sorted(self._commits(table).items())
                 if folder and (buckets is None or b in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        """The latest row per key; empty when nothing was saved yet."""
        return self._rows(table)

    def save(self, table: str, rows: DataFrame) -> None:
        """Puts ``rows`` in the place of saved rows of their keys that are not newer."""
        keys, schema = TABLES[table]
        names = self.spark.createDataFrame([], schema).columns
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        new = written(rows.select(*names, bucket.alias("bucket")), "saving")
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}
        if touched:
            folder = uuid.uuid4().hex
            upsert(self._rows(table, touched), new.repartition("bucket").drop("bucket"), table) \
                .withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self._path(table)}/data/{folder}")
            self._commit(table, touched, folder)

    def _commit(self, table: str, buckets: set[int], folder: str | None) -> None:
        number = 1 + max((n for n, _ in self._commits(table).values()), default=0)
        self.spark.createDataFrame([(b, number, folder) for b in buckets], COMMIT).coalesce(1) \
            .write.mode("append").parquet(f"{self._path(table)}/commits")

    def save_file_results(self, files: DataFrame, findings: DataFrame, now: float,
                          rules_version: str) -> None:
        """Save findings per file as JSON; scanned files without findings are saved as ``[]``."""
        fields = [c for c in findings.columns if c not in ("project_id", "file")]
        per_file = findings.groupBy("project_id", F.col("file").alias("path")).agg(
            F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("vulnerabilities"))
        rows = with_hash(files).drop("content").join(per_file, ["project_id", "path"], "left")
        self.save("file_scans", rows.select(
            F.col("project_id").cast("string").alias("project_id"), "file_hash", F.col("path").alias("file_path"), F.col("mtime").alias("last_modified"),
            F.lit(float(now)).alias("last_scanned"),
            F.coalesce("vulnerabilities", F.lit("[]")).alias("vulnerabilities"),
            F.lit(rules_version).alias("rules_version")))

    def save_selection(self, selected: DataFrame, hashes: DataFrame, now: float,
                       rules_version: str) -> None:
        lists = selected.groupBy("project_id").agg(F.to_json(F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda r: r.path))
            .alias("critical_files"))
        self.save("project_scans", lists.join(hashes, "project_id").select(
            F.col("project_id").cast("string").alias("project_id"), "structure_hash",
            "critical_files", F.lit(float(now)).alias("last_scanned"),
            F.lit(rules_version).alias("rules_version")))

    def put(self, key: str, value: str, now: float) -> None:
        """Save one JSON text under a key."""
        self.save("metadata", self.spark.createDataFrame(
            [(key, value, float(now))], TABLES["metadata"][1]))

    def get(self, key: str) -> DataFrame:
        return self.read("metadata").where(F.col("key") == key).select("value")

    def clear(self) -> None:
        """Empties all tables."""
        for table in TABLES:
            buckets = set(self._commits(table))
            if buckets:
                self._commit(table, buckets, None)

    def compact(self, root: str) -> ScanState:
        """Write the current rows under another folder, without the files of earlier versions."""
        other = ScanState(self.spark, root, self.buckets)
        for table in TABLES:
            other.save(table, self.read(table))
        return other

    def stats(self) -> DataFrame:
        """Row count per table."""
        return row_counts({t: self.read(t) for t in TABLES})
