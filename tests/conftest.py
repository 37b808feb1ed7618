import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[*]").appName("tracewell-tests") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false") \
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC") \
        .getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FILES = "project_id bigint, path string, language string, content string"


@pytest.fixture(scope="session")
def files_of(spark):
    """``files_of({path: text})``: file rows of project 1, language by extension."""
    names = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java",
             "go": "golang", "html": "html", "txt": "unknown"}

    def build(texts, project=1):
        rows = [(project, p, names[p.rsplit(".", 1)[1]], t) for p, t in texts.items()]
        return spark.createDataFrame(rows, FILES)

    return build
