import os

import duckdb
import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


# Documents with every awkward case: null ids and texts, blanks, repeats, and names that clash.
EXTRA = "doc_id bigint, text string, lang string, source string, key long, node string, band int, n_words string"


@pytest.fixture(scope="session")
def awkward(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, line), (2, line), (2, line), (3, None), (4, ""), (5, " \t\n "), (6, "Word"), (None, line),
            (None, None), (7, line.upper() + " tail"), (8, "x" * 300_000), (9, ("long text " * 9_000)),
            (10, "w1 w2 w3 w4"), (11, "W1 w2\nw3 w4"), (12, "ß ü 漢字   é")]
    return spark.createDataFrame(
        [(i, t, None if i == 3 else "en", None if i == 4 else "src1", 1, "n", 2, "w") for i, t in rows], EXTRA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], EXTRA)


# Every name that an operator uses for a column of its own, or has used.
CLASHING = ("_row x y fold score predicted _text _matches _n_words n_hit matches _id id taken epoch domain _q0 _q1 _p0 _p1 _leaf "
            "_ordinal shard_id _h0 _h1 _size _shard _n _copy copies _order _range _key key row _runs spans node band check root "
            "kept n_shingles block text_key first at tie bits digest part part_ n_rows sequence_id start length").split()


@pytest.fixture(scope="session")
def clashing(spark, data):
    """Documents of the smallest data with a column of each such name, and one with a dot."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)], F.lit("d").alias("a.b"))
