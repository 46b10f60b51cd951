"""Corpus pipeline: quality rules, line dedup, near-duplicate join, source mix, packing.

Each stage takes what its predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import lines, mixing, packing, quality, similarity
from lodestone.llm.common import row_hash, unused
from lodestone.llm.queries import PACK_END_ID, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality.kept_documents(quality.ledger(docs), "web-1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars is that of the new text.  Copies of a text
    count once, so that their group comes whole to the near-duplicates, which keep one of it."""
    return lines.drop_boilerplate(docs, by_text=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, and of rows with that id
    the one of the least hash."""
    d, h, own = unused(docs.columns, "doc_", "h_", "row_")
    first = similarity.near_duplicates(docs).filter("first").select(F.col("doc_id").alias(d), F.col("h").alias(h))
    keyed = docs.withColumn(own, row_hash(docs))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns)  # rows that are the same


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each pass, cut where a source's quota ends."""
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), packing.CAPACITY, PACK_END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizer has no SQL; the whole run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what a stage returns is written before the next reads it."""
    from lodestone.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
