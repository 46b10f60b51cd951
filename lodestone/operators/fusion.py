"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the fusion: the constant, and the least candidates a list is asked for.
RRF_K, POOL = 60, 50


def pool(k: int) -> int:
    return max(k, POOL)


def ranked(rows: DataFrame, list_no: int, key: str, by: str = "score", ascending: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """A list as rows (within, key, list_no, rank, score), rank from 1, ties in order of the key."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    rank = F.row_number().over(Window.partitionBy(*within, F.lit(list_no)).orderBy(order, key))
    return rows.select(*within, key, F.lit(list_no).alias("list_no"), rank.alias("rank"), F.col("score").cast("double").alias("score"))


def fuse(lists: list[DataFrame], k: int, key: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The k best of the lists' union by the sum of 1 / (60 + rank): within, key, score.

    No list with rows gives no rows; a single one passes through with its own scores.  With ``within``
    each of its values is fused by itself.  Lists are as long as a pool, so windows here are small.
    """
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    by = [F.col(c) for c in within]
    own = Window.partitionBy(*(by or [F.lit(0)]))  # so a list is made once, for its ranks and for the number of lists
    known = rows.withColumn("_lists", F.size(F.collect_set("list_no").over(own)))
    summed = known.groupBy(*by, key).agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("rrf"), F.min_by("score", "list_no").alias("own"), F.max("_lists").alias("_lists"))
    out = summed.select(*by, key, F.when(F.col("_lists") == 1, F.col("own")).otherwise(F.col("rrf")).alias("score"))
    if not within:
        return out.orderBy(F.desc("score"), key).limit(k)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), key))
    return out.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
