"""Project manifests: dependencies and frameworks from well-known root files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Root files that describe a project.
MANIFEST_NAMES = ["package.json", "pom.xml", "build.gradle", "requirements.txt", "Gemfile",
                  "composer.json", "Cargo.toml", ".gitignore"]
SUMMARY_NAMES = ["README.md", "package.json", "pom.xml", "requirements.txt", "setup.py",
                 "build.gradle", "Gemfile", "composer.json"]
PACKAGE_FRAMEWORKS = ["react", "angular", "vue", "express"]
POM_FRAMEWORKS = ["spring-boot", "spring-security"]
REQUIREMENT_FRAMEWORKS = ["django", "flask"]


def manifests(root_files: DataFrame) -> DataFrame:
    """Rows of ``root_files(project_id, name, content)`` that are manifests."""
    return root_files.where(F.col("name").isin(*MANIFEST_NAMES))


def with_dependencies(root_files: DataFrame) -> DataFrame:
    """Manifests with a ``dependencies`` map; for a name in both parts the development one wins."""
    def part(key):
        return (f"coalesce(from_json(get_json_object(content, '$.{key}'), 'map<string,string>'), "
                "cast(map() as map<string,string>))")

    merged = F.expr(
        "map_from_entries(array_sort(concat("
        f"filter(map_entries({part('dependencies')}), e -> "
        f"not map_contains_key({part('devDependencies')}, e.key)), "
        f"map_entries({part('devDependencies')}))))")
    empty = F.expr("cast(map() as map<string,string>)")
    return manifests(root_files).withColumn(
        "dependencies", F.when(F.col("name") == "package.json", merged).otherwise(empty))


def dependencies(root_files: DataFrame) -> DataFrame:
    return with_dependencies(root_files).select(
        "project_id", F.explode("dependencies").alias("dependency", "version"))


def frameworks(root_files: DataFrame) -> DataFrame:
    """``project_id, framework, version``; found-by-text frameworks have version ``true``."""
    read = with_dependencies(root_files)

    def entry(name, version):
        return F.struct(F.lit(name).alias("framework"), version.cast("string").alias("version"))

    body, found = F.col("content"), []
    for name in PACKAGE_FRAMEWORKS:
        version = F.try_element_at("dependencies", F.lit(name))
        found.append(F.when(F.map_contains_key("dependencies", name), entry(name, version)))
    for file, names, gate in (
        ("pom.xml", POM_FRAMEWORKS, F.contains(body, F.lit("<artifactId>"))),
        ("requirements.txt", REQUIREMENT_FRAMEWORKS, F.lit(True)),
    ):
        for name in names:
            hit = (F.col("name") == file) & gate & F.contains(body, F.lit(name))
            found.append(F.when(hit, entry(name, F.lit("true"))))
    return read.select("project_id", F.explode(F.array_compact(F.array(*found))).alias("_f")) \
        .select("project_id", "_f.framework", "_f.version").distinct()


def project_context(root_files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """One row per project: frameworks, dependencies, manifest names (and entry points)."""
    def as_map(frame, key, value, name):
        once = frame.groupBy("project_id", key).agg(F.max(value).alias(value))
        pairs = F.array_sort(F.collect_list(F.struct(key, value)))
        return once.groupBy("project_id").agg(F.map_from_entries(pairs).alias(name))

    names = manifests(root_files).groupBy("project_id").agg(
        F.array_sort(F.collect_set("name")).alias("config_files"))
    out = names.join(as_map(frameworks(root_files), "framework", "version", "frameworks"),
                     "project_id", "left") \
        .join(as_map(dependencies(root_files), "dependency", "version", "dependencies"),
              "project_id", "left")
    if entries is not None:
        out = out.join(entries.groupBy("project_id").agg(
            F.array_sort(F.collect_set("path")).alias("entry_points")), "project_id", "left")
    return out
