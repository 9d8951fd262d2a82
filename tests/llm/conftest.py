import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail" for i in range(20_000))
    rows = [(1, "alpha beta gamma", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, long, "de", "b", 9), (5, "alpha beta gamma", "en", "b", 1), (5, "alpha beta gamma", "en", "b", 1), (6, "  two  spaces \n\n tab\tend ", "fr", None, 2), (None, "no id", "en", "a", 3)]
    wide = spark.createDataFrame(rows, DOCS)
    return wide.selectExpr("*", "1 as size", "'x' as hilbert", "2 as _part", "0.5D as score", "'s' as bands", "7 as position")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
