"""Vectors: normalisation, distance, exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v) -> Column:
    """Of length one; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def distance(a, b) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def score(dist: Column) -> Column:
    """Cosine of unit vectors, not below zero."""
    return F.greatest(F.lit(0.0), 1 - dist * dist / 2)


def knn(vectors: DataFrame, query: list[float], k: int, scope: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest vectors of a unit query: vec_id, distance, score.  Ties in order of the id.

    The query is a literal; each task keeps its k best before anything is shuffled.
    """
    rows = vectors if scope is None else vectors.filter(scope)
    dist = distance(F.col(embedding), F.array(*[F.lit(float(x)) for x in query]))
    near = rows.select(F.col(vec_id), dist.alias("distance")).orderBy("distance", vec_id).limit(k)
    return near.withColumn("score", score(F.col("distance")))


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows (id, vector) packed into blocks of so many: ids and values as bytes."""

    def run(batches):
        ids, values, n = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(values).tobytes()])], names=[f"{name}_ids", f"{name}_values"])

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids.append(part.column(0).to_numpy())
                values.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                n += part.num_rows
                if n >= size:
                    yield block()
                    ids, values, n = [], [], 0
        if n:
            yield block()

    return rows.mapInArrow(run, f"{name}_ids binary, {name}_values binary")


def _nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int):
    """Per query its k nearest rows of v: a product finds who can be among them, and their distances are then
    taken exactly, ties in order of the id."""
    near = (v * v).sum(1)[None, :] - 2 * (q @ v.T)
    if k < len(v):
        last = np.partition(near, k - 1, axis=1)[:, k - 1]
        near = near <= (last + 1e-9 * (1 + np.abs(last)))[:, None]
    else:
        near = np.ones(near.shape, bool)
    for x, some in zip(q, near):
        some = np.flatnonzero(some)
        d = np.sqrt(((v[some] - x) ** 2).sum(1))
        best = np.lexsort((ids[some], d))[:k]
        yield ids[some[best]], d[best]


#: Bytes of packed queries that may be broadcast; beyond it, blocks of both sides are paired by Spark.
BROADCAST_BYTES = 64 << 20


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query", vec_id: str = "vec_id", embedding: str = "embedding", block: int = 1024) -> DataFrame:
    """The k nearest vectors of every query, exactly: query_id, vec_id, rank, distance, score.

    A stated query set against all vectors, in blocks: each block of queries meets each block of vectors in
    one product, and a task hands on the k best it has seen of each query.  Queries never come to the driver.
    """
    q = _blocks(queries.select(F.col(query_id).cast("long"), query), "q", block)
    v = _blocks(vectors.select(F.col(vec_id).cast("long"), embedding), "v", 4 * block)
    small = (q.agg(F.sum(F.octet_length("q_values"))).first()[0] or 0) <= BROADCAST_BYTES
    pairs = v.crossJoin(F.broadcast(q) if small else q)

    def run(batches):
        kept: dict[bytes, list] = {}
        for batch in batches:
            for q_ids, q_values, v_ids, v_values in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_values", "v_ids", "v_values"))):
                own, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(v_ids, np.int64)
                found = _nearest(np.frombuffer(q_values).reshape(len(own), -1), np.frombuffer(v_values).reshape(len(ids), -1), ids, k)
                before = kept.get(q_ids)
                if before:
                    found = [(np.concatenate(x), np.concatenate(y)) for x, y in (zip(a, b) for a, b in zip(before, found))]
                    found = [(x[o], y[o]) for x, y in found for o in (np.lexsort((x, y))[:k],)]
                kept[q_ids] = list(found)
        for q_ids, found in kept.items():
            n = [len(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(q_ids, np.int64), n)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([y for _, y in found]))], names=["query_id", "vec_id", "distance"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("score", score(F.col("distance")))


def mean_pool(rows: DataFrame, key: str, embedding: str = "embedding", mask: Column | None = None) -> DataFrame:
    """Mean of the vectors of each key over rows whose mask is set: key, dim, value."""
    used = rows if mask is None else rows.filter(mask)
    flat = used.select(key, F.posexplode(embedding).alias("dim", "x"))
    return flat.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def pool_output(values: np.ndarray, mask: np.ndarray, dimensions: int) -> np.ndarray:
    """Vector of a model's output: of two axes the first row, of three the masked mean over tokens (zeros
    without a token), else the first numbers."""
    if values.ndim == 2:
        return values[0]
    if values.ndim == 3:
        m = mask.astype(bool)[: values.shape[1]]
        return values[0][: len(m)][m].mean(0) if m.any() else np.zeros(values.shape[2], values.dtype)
    return values.ravel()[:dimensions]
