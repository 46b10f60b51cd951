"""Lexical, dense and fused search; BM25 against SQLite's FTS5."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.errors import EngineError
from lodestone.functions import fts
from lodestone.operators import bm25, fusion, search, vectors

TEXTS = ["Čarobnjak iz Oza je knjiga o čarobnjaku", "Druga knjiga, bez njega", "Ћирилица остаје цела", "the cat sat on the mat", "the dog and the cat, the cat", "", "x² É é naïve"]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, f"c{i % 2}", t) for i, t in enumerate(texts)], "chunk_id long, corpus string, text string")


@pytest.mark.parametrize("query", ["carobnjak knjiga", "Ћирилица", "the cat the", "NAIVE x²", "dog knjiga mat"])
def test_bm25_equals_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", enumerate(TEXTS))
    match = " OR ".join(f'"{w}"' for w in query.split())
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {r["chunk_id"]: r["score"] for r in bm25.search(table(spark), query, 50).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
    again = {r["chunk_id"]: r["score"] for r in bm25.search_postings(*bm25.build_postings(table(spark)), query, 50).collect()}
    assert again == pytest.approx(got)


def test_scope_is_applied_after_statistics(spark):
    all_ = {r["chunk_id"]: r["score"] for r in bm25.search(table(spark), "cat", 9).collect()}
    one = {r["chunk_id"]: r["score"] for r in bm25.search(table(spark), "cat", 9, F.col("corpus") == "c0", extra=("corpus",)).collect()}
    assert one == {4: all_[4]} and len(all_) == 2


def test_match_expression(spark):
    df = spark.createDataFrame([("one two three",), ("  ",), ("a-b, c!",)], "q string")
    assert [r[0] for r in df.select(fts.match_expression(F.col("q"))).collect()] == ['"one" OR "two" OR "three"', "", '"a" OR "b" OR "c"']


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["score"] for r in vectors.knn(df, [1.0, 0.0], 9).collect()}
    assert got == pytest.approx({1: 1.0, 4: 0.6, 3: 0.5, 2: 0.0})
    n = {r["vec_id"]: r["v"] for r in df.select("vec_id", vectors.normalize(F.transform("embedding", lambda x: x * 3)).alias("v")).collect()}
    assert n[3] == [0.0, 0.0] and n[4] == pytest.approx([0.6, 0.8])
    batch = vectors.batch_knn(df, df.filter("vec_id = 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 2).collect()
    assert [(r["vec_id"], r["rank"]) for r in sorted(batch, key=lambda r: r["rank"])] == [(4, 1), (1, 2)]


def test_pooling():
    assert vectors.pool_output(np.array([[1, 2], [3, 4]]), np.ones(2), 2).tolist() == [1, 2]
    x = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]])
    assert vectors.pool_output(x, np.array([1, 1, 0]), 2).tolist() == [2, 3]
    assert vectors.pool_output(x, np.zeros(3), 2).tolist() == [0, 0]
    assert vectors.pool_output(np.arange(5.0), np.ones(1), 3).tolist() == [0, 1, 2]


def lists(spark, *ranked):
    frames = [spark.createDataFrame([(k, float(s)) for k, s in r], "k long, score double") for r in ranked]
    return [fusion.ranked(f, i, "k") for i, f in enumerate(frames)]


def test_rrf(spark):
    got = [(r["k"], r["score"]) for r in fusion.fuse(lists(spark, [(1, 9), (2, 8)], [(2, 1), (3, 0.5)]), 5, "k").collect()]
    assert [k for k, _ in got] == [2, 1, 3]
    assert [s for _, s in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62])
    alone = [(r["k"], r["score"]) for r in fusion.fuse(lists(spark, [], [(7, 0.9), (8, 0.8), (9, 0.7)]), 2, "k").collect()]
    assert alone == [(7, 0.9), (8, 0.8)]
    assert fusion.fuse(lists(spark, [], []), 2, "k").collect() == [] and fusion.pool(5) == 50 and fusion.pool(80) == 80


def test_arguments(spark):
    for mode, k in (("other", 3), ("dense", 0)):
        with pytest.raises(EngineError):
            search.check(mode, k)
