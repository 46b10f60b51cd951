"""Composite search over chunk and vector tables: dense, lexical or both, one corpus or all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CorpusNotFound, EngineError
from . import bm25, fusion, vectors

MODES = ("dense", "hybrid", "lexical")


def check(mode: str, k: int) -> None:
    if mode not in MODES:
        raise EngineError(f"'{mode}' is no search mode: use one of {', '.join(MODES)}.")
    if k < 1:
        raise EngineError("At least one result must be asked for.")


def lexical_scores(chunks: DataFrame, query: str, corpus: str | None = None) -> DataFrame:
    """chunk_id, corpus, score of all chunks (chunk_id, corpus, text) with a term of the query, of one corpus or
    all; statistics are those of all corpora."""
    return bm25.scores(chunks, query, None if corpus is None else F.col("corpus") == corpus, "chunk_id", extra=("corpus",))


def search(lexical: DataFrame | None, embeddings: DataFrame | None, vector: list[float] | None, k: int, mode: str = "dense", corpus: str | None = None) -> DataFrame:
    """The k best chunks: chunk_id, score.  corpus None: all corpora, ranked together.

    lexical: chunk_id, corpus, score of the query, from texts or an index.  embeddings: chunk_id, corpus,
    embedding of length one.  Lists are cut to the pool before they are fused.  The dense list of one
    corpus is in order of distance, that of all in order of the score.
    """
    check(mode, k)
    scope, lists = None if corpus is None else F.col("corpus") == corpus, []
    if mode != "lexical":
        near = vectors.knn(embeddings, vector, fusion.pool(k), scope, "chunk_id")
        lists.append(fusion.ranked(near, 0, "chunk_id", "distance", ascending=True) if corpus is not None else fusion.ranked(near, 0, "chunk_id"))
    if mode != "dense":
        best = bm25.best(lexical, fusion.pool(k))
        lists.append(fusion.ranked(best, 1, "chunk_id"))
    return fusion.fuse(lists, k, "chunk_id")


def search_grouped(lexical: DataFrame | None, dense: list[tuple[DataFrame, list[float]]], k: int, mode: str = "hybrid") -> DataFrame:
    """The k best chunks of each corpus by itself: corpus, chunk_id, score.

    One pass ranks all corpora at once.  lexical: chunk_id, corpus, score.  dense: per model, the embeddings
    (chunk_id, corpus, embedding) of its corpora and the query's vector.
    """
    check(mode, k)
    n, lists = fusion.pool(k), []

    def first(rows: DataFrame, *order) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("corpus").orderBy(*order, "chunk_id"))
        return rows.withColumn("_r", rank).filter(F.col("_r") <= n)

    if mode != "lexical":
        near = None
        for embeddings, vector in dense:
            dist = vectors.distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
            own = embeddings.select("corpus", "chunk_id", dist.alias("distance"))
            near = own if near is None else near.unionByName(own)
        near = first(near, "distance").withColumn("score", vectors.score(F.col("distance")))
        lists.append(fusion.ranked(near, 0, "chunk_id", "distance", ascending=True, within=("corpus",)))
    if mode != "dense":
        lists.append(fusion.ranked(first(lexical.select("corpus", "chunk_id", "score"), F.desc("score")), 1, "chunk_id", within=("corpus",)))
    return fusion.fuse(lists, k, "chunk_id", within=("corpus",))


def with_texts(found: DataFrame, chunks: DataFrame, files: DataFrame, corpora: DataFrame) -> DataFrame:
    """Results with text, path, corpus name and position: the found rows are few and go to the tables."""
    return (chunks.select("id", "file_id", "text", "position").join(F.broadcast(found), F.col("id") == F.col("chunk_id"))
            .join(files.select(F.col("id").alias("_f"), "path", "corpus_id"), F.col("file_id") == F.col("_f"))
            .join(corpora.select(F.col("id").alias("_c"), F.col("name").alias("corpus")), F.col("corpus_id") == F.col("_c"))
            .select("chunk_id", "text", "path", "corpus", "position", F.col("score").cast("float").alias("score"))
            .orderBy(F.desc("score"), "chunk_id"))


def must_exist(corpora: DataFrame, name: str):
    row = corpora.filter(F.col("name") == name).head()
    if row is None:
        raise CorpusNotFound(name)
    return row
