import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment["PYTHONPATH"] = ROOT
    yield s


@pytest.fixture
def engine(spark, tmp_path):
    from lodestone.engine import Engine

    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture
def corpus(engine):
    from lodestone.embed import HashingEmbedder

    engine.catalog.create_corpus("notes", HashingEmbedder(), "short texts")
    return "notes"
