import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as sc
from tracewell.operators import facts
from tracewell.operators.sizing import drop_listed, lookup_join
from tracewell.sources import corpus, filesource, manifests


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_read_corpus(spark, tmp_path):
    root = tmp_path / "code"
    for path, data in {
        "p1/src/a.py": b"a = 1\r\nb\xff = 2\r", "p1/node_modules/x.js": b"x", "p1/big.py": b"x" * 200,
        "p1/.py": b"x", "p1/A.PY": b"x", "p1/lib.min.js": b"x", "p1/routes/r.js": b"r",
        "p2/z.go": b"", "p2/b.rb": b"puts 1",
    }.items():
        target = root / path
        os.makedirs(target.parent, exist_ok=True)
        target.write_bytes(data)
    got = {(r.project_id, r.path): r for r in corpus.read_corpus(spark, str(root), 100).collect()}
    assert set(got) == {("p1", "src/a.py"), ("p2", "b.rb")}  # Spark lists no empty files
    a = got["p1", "src/a.py"]
    assert a.content == "a = 1\nb = 2\n" and a.language == "python" and a.size_bytes == 14
    anchored = corpus.read_corpus(spark, str(root), 100, max_files=None, anchor=True)
    assert {r.path for r in anchored.collect()} == {"src/a.py", "b.rb", "routes/r.js"}
    capped = corpus.read_corpus(spark, str(root), 100, max_files=1).collect()
    assert {(r.project_id, r.path) for r in capped} == {("p1", "src/a.py"), ("p2", "b.rb")}
    assert corpus.scannable(corpus.read_corpus(spark, str(root), 100), 6).count() == 1


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "code"
    for path, data in {
        "p1/src/a.py": b"a = 1\r\nb\xff = 2\r", "p1/node_modules/deep/x.js": b"x", "p1/big.py": b"x" * 200,
        "p1/.py": b"x", "p1/notes.txt": b"x", "p1/lib.min.js": b"x", "p1/routes/r.js": b"r", "p1/src/in/b.py": b"bb",
        "p2/z.go": b"", "p2/b.rb": b"puts 1", "p2/.git/hooks/h.py": b"h", "loose.py": b"not in a project",
    }.items():
        target = root / path
        os.makedirs(target.parent, exist_ok=True)
        target.write_bytes(data)
    return str(root)


def test_ignored_files_are_never_opened(tree, monkeypatch):
    opened, listed = [], []
    options = {"path": tree, "ignore": json.dumps(corpus.IGNORE_PATTERNS), "extensions": '["py", "js", "go", "rb"]',
               "maxsize": "100", "slices": "2"}
    reader = filesource.CorpusReader(options)
    monkeypatch.setattr(reader, "_opened", lambda system, path: opened.append(path) or b"")
    monkeypatch.setattr(reader.wanted, "enters", lambda f, g=reader.wanted.enters: g(f) and (listed.append(f) or True))
    parts = reader.partitions()
    assert len(parts) == 4
    for part in parts:
        list(reader.read(part))
    assert sorted(p.removeprefix(tree + "/") for p in opened) == ["p1/src/a.py", "p1/src/in/b.py", "p2/b.rb"]
    assert set(listed) == {"src", "in"}     # node_modules and .git are not entered, and "routes" holds "out"


def test_archives_and_slices_give_the_same_files(spark, tree, tmp_path):
    plain = corpus.read_corpus(spark, tree, 100, anchor=True)
    rows = {tuple(r) for r in plain.drop("mtime").collect()}
    assert {r[1] for r in rows} == {"src/a.py", "src/in/b.py", "routes/r.js", "b.rb"}
    sliced = corpus.read_corpus(spark, tree, 100, anchor=True, slices=3)
    assert {tuple(r) for r in sliced.drop("mtime").collect()} == rows
    by_spark = corpus.read_corpus(spark, tree, 100, anchor=True, spark_only=True)
    assert {tuple(r) for r in by_spark.drop("mtime").collect()} == rows
    packed = str(tmp_path / "packed")
    filesource.pack(filesource.read_files(spark, tree, []).repartition(3), packed)
    assert all(n.endswith(".tar") and "@" in n for n in os.listdir(packed))
    unpacked = corpus.read_corpus(spark, packed, 100, anchor=True)
    assert {tuple(r) for r in unpacked.drop("mtime").collect()} == rows
    capped = corpus.read_corpus(spark, packed, 100, max_files=1, anchor=True)
    assert {r.path for r in capped.collect()} == {"b.rb", "routes/r.js"}


def test_language_and_extension(spark):
    cases = {".py": "unknown", "A.PY": "unknown", "a.py": "python", "x/y.z/b.tsx": "typescript",
             "noext": "unknown", ".env.js": "javascript", "a.tar.go": "golang", "x.": "unknown"}
    rows = spark.createDataFrame([(c,) for c in cases], "p string") \
        .select("p", sc.language_of(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in rows} == cases


def test_ignore_default_and_anchored(spark):
    rows = spark.createDataFrame([("routes/a.js",), ("environment.py",), ("out/a.js",), ("s/a.js",)],
                                 "p string")
    got = {r[0]: (r[1], r[2]) for r in rows.select(
        "p", corpus.ignored(F.col("p")), corpus.ignored(F.col("p"), anchor=True)).collect()}
    assert got == {"routes/a.js": (True, False), "environment.py": (True, False),
                   "out/a.js": (True, True), "s/a.js": (False, False)}


def test_lines_keep_the_last_empty_one(files_of):
    rows = facts.lines(files_of({"a.py": "x\n\ty \n"})).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in rows] == [(1, "x"), (2, "\ty "), (3, "")]


def test_severity_cwe_and_buckets(spark):
    cases = {
        "nosql_injection": ("Critical", "CWE-943"), "nosql injection (x)": ("Critical", "CWE-89"),
        "hardcoded_credentials": ("Low", None), "XSS": ("High", "CWE-79"), "": ("Low", "CWE-89"),
        "Insecure Deserialization": ("Critical", "CWE-502"), "race": ("Low", "CWE-362")}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(
        "t", sc.severity_of(F.col("t")), sc.cwe_of(F.col("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases
    rows = spark.createDataFrame([(0.8,), (0.5,), (0.49,)], "c double")
    assert [r[0] for r in rows.select(sc.confidence_bucket(F.col("c"))).collect()] == [
        "high", "medium", "low"]


def test_text_helpers(spark):
    assert one(spark, "a/./b/../c//d", sc.normalize_path) == "/a/c/d"
    assert one(spark, "/../x", sc.normalize_path) == "/x"
    assert one(spark, "y" * 12_001, lambda c: F.length(sc.shorten_middle(c))) == 12_000 + len(
        sc.TRUNCATED)
    assert one(spark, " a = 1; \tb\v= 2", lambda c: sc.captured(c, r"(\s*\w+\s*)=")) == ["a", "b"]
    assert one(spark, "ab\ncd\n", lambda c: sc.line_at(c, F.lit(4))) == 2
    assert one(spark, "a.YAML", sc.kind_hint).startswith("This is a configuration file")


def test_manifests(spark):
    rows = spark.createDataFrame([
        (1, "package.json", '{"dependencies":{"react":"1","a":"2"},"devDependencies":{"react":"9"}}'),
        (1, "pom.xml", "<artifactId>x</artifactId> spring-boot"), (2, "pom.xml", "spring-boot"),
        (2, "requirements.txt", "flask"), (2, "other.txt", "django"), (3, "package.json", "{bad")],
        "project_id int, name string, content string")
    assert {(r.dependency, r.version) for r in manifests.dependencies(rows).collect()} == {
        ("react", "9"), ("a", "2")}
    assert {tuple(r) for r in manifests.frameworks(rows).collect()} == {
        (1, "react", "9"), (1, "spring-boot", "true"), (2, "flask", "true")}
    context = {r.project_id: r for r in manifests.project_context(rows).collect()}
    assert context[1].config_files == ["package.json", "pom.xml"]
    assert context[3].frameworks is None


def test_lookup_join_salted_equals_broadcast(spark, monkeypatch):
    big = spark.range(2000).select(
        F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).alias("project_id"),
        F.concat(F.lit("f"), "id").alias("path"))
    table = spark.createDataFrame([(1, "a"), (1600, "b")], "project_id bigint, v string")
    want = sorted(map(str, lookup_join(big, table, ["project_id"], "path").collect()))
    monkeypatch.setattr("tracewell.operators.sizing.rows_within", lambda *a: None)
    salted = lookup_join(big, table, ["project_id"], "path").select("project_id", "path", "v")
    assert sorted(map(str, salted.collect())) == want
    assert drop_listed(big, table.select("project_id"), ["project_id"]).count() == 499


def test_oversized_file_is_left_out_before_it_is_gathered(spark, tmp_path):
    from suite import fixtures as fx
    spark.range(6000).select(
        F.when(F.col("id") < 3000, 8).otherwise(F.col("id") * 2).alias("l_orderkey"),
        (F.col("id") * 7).alias("l_partkey"), (F.col("id") * 3).alias("l_suppkey"),
        F.lit(1).alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    small_ones = fx.code_files(spark, str(tmp_path)).collect()
    assert max(r.size_bytes for r in small_ones) < 100_000
    hot = [r for r in small_ones if r.path.startswith("p1/src/f1.")]
    n_lines = sum(r.content.count("\n") + 1 for r in small_ones)
    assert (n_lines == 6000) == bool(hot)
