import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"word{i % 977} ünï{i % 13}" for i in range(30000))
    line = "A line that is long enough to be counted, and common"
    rows = [
        (1, f"{line}\nfirst words here", "en", "a", 1),
        (2, f"  {line.upper()}\t\nsecond", "en", "a", 1),
        (3, f"{line}\r\nthird", None, "a", None),
        (4, f"x\n{line}", "de", None, 1),
        (9, f"{line}\n{line}\nlast holder", "de", "b", 1),
        (5, None, None, None, None),
        (6, "", "en", "a", 0),
        (None, f"{line}\nno id", "en", "a", 1),
        (7, long, "en", "a", 1),
        (8, "same text twice here with ten words in it now", "en", "a", 1),
        (8, "same text twice here with ten words in it now", "en", "a", 1),
        (10, " \n\t\n", "en", "a", 1),
        (11, "<|endoftext|> and <|startoftext|>x it's Ⅷ Ǆ ﬁ é   　 ÀÉ 漢字 \U0001f600", "en", "a", 1),
    ]
    x = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("ids", "part", "n", "at", "h", "hi", "lo", "owner", "_n_lines", "_n_dropped", "_w", "_e", "_d", "_f", "_l", "_rid", "_id", "row", "rate", "stratum", "n_words", "pieces", "start"):
        x = x.selectExpr("*", f"'clash' as {c}")
    return x


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
