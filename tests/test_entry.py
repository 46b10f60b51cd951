"""The driver's contract: every query runs, and equals its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in __import__("lodestone.registry").registry.QUERIES)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    got = db.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(str([plain(x) for x in r]) for r in rows) == sorted(str([plain(r[i]) for i in order]) for r in got.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["chunk_id", "score"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
def test_queries_over_whole_tables(spark, db):
    queries = entry.queries()
    assert queries["sqlite_date_parse_all"](spark, SF).count() == db.execute("SELECT count(*) FROM events").fetchone()[0]
    assert queries["mean_pool_all_by_label"](spark, SF).select("label").distinct().count() == db.execute("SELECT count(DISTINCT label) FROM embeddings").fetchone()[0]
