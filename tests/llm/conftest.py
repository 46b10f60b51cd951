import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment["PYTHONPATH"] = ROOT
    yield s


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and wordless texts, repeated rows and ids, one long text, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(6000))
    rows = [
        (1, None, "s", "en"), (2, "", "s", None), (3, " \n\t ", None, "en"), (4, "one two three four five six seven", "s", "en"),
        (4, "one two three four five six seven", "s", "en"), (5, "ONE two three four five six seven", "t", "de"), (5, "other text of this id", "t", "de"),
        (None, "a text without an id, which is not so long", "s", "en"), (7, long, "s", "en"), (8, long + " end", "s", "en"), (9, "a  b\n\n c é\U0001f600 ", "t", "fr"), (10, None, None, None),
    ]
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], "doc_id long, text string, source string, lang string, size string, n_words int, kept int")
