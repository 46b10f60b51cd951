"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule has the golden-ratio point frac(t * phi); the point falls into one source's
interval of the cumulative shares, and slots of a source are ranked in order of t.  Each source's
documents, in shuffled order, form a stream of words that is cut into blocks of equal size; the slot of
rank r takes block r, and blocks after the end of the stream start it again.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, row_hash, task, unused, written

_WORDS = re.compile(WORD)

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and times a source may be used, in percent and passes.
SHARE_PERCENT, PASSES = 150, 2
#: floor(2**32 / golden ratio), made odd: t times it, modulo 2**32, is the golden-ratio sequence.
_GOLDEN = 2654435769
#: Blocks of the whole mix at the least, and words of a block at the most.
_BLOCKS, _BLOCK_WORDS = 1 << 18, 1 << 16
_CHUNK = 4096
#: Rows of sources that may be broadcast; where there are more, Spark joins them like any table.
BROADCAST_SOURCES = 100_000


def water_fill(sizes: list[int], weights: list[float], total: float, passes: int = PASSES) -> list[float]:
    """Targets in proportion to weight, none above passes * size, the excess shared again by weight."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, float(passes * sum(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= passes * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        w_full = {i: left * weights[i] / w for i in full}
        for i in full:
            target[i] = float(passes * sizes[i])
        left = max(0.0, left - sum(target[i] for i in w_full))
        open_ = [i for i in open_ if i not in w_full]
    return target


def plan(sized: DataFrame) -> tuple[DataFrame, int]:
    """Per source: size, target, quota (words to take), slots; and the block size.

    One row per source comes to the driver, a few numbers and its name.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("s")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["s"] or 0) for r in rows]
    targets = water_fill(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(rows))], sum(sizes) * SHARE_PERCENT / 100)
    block = max(1, min(_BLOCK_WORDS, -(-int(sum(targets)) // _BLOCKS)))
    out, lo = [], 0
    for k, (r, s, t) in enumerate(zip(rows, sizes, targets)):
        quota = min(PASSES * s, round(t))
        slots = -(-quota // block)
        out.append((k, r["source"], s, float(t), quota, lo, lo + slots))
        lo += slots
    spark = sized.sparkSession
    return spark.createDataFrame(out, "src int, source string, source_size long, target double, quota long, lo long, hi long"), block


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """Slots (t, src, rank) of the mix.

    3 * n_slots points are drawn: an interval of 1 / n_slots holds a point of any 2.62 * n_slots
    successive ones, so each source gets its slots; what is beyond them is dropped.  Ranks come from
    counts of chunks of t, so no task sees all slots of a source.
    """
    spark = sources.sparkSession
    cuts = sorted((r["lo"], r["hi"], r["src"]) for r in sources.select("lo", "hi", "src").collect())
    cuts = [c for c in cuts if c[1] > c[0]]
    ends, owner = np.array([c[1] for c in cuts], np.int64), np.array([c[2] for c in cuts], np.int32)

    def draw(batches):
        for batch in batches:
            t = batch.column(0).to_numpy()
            point = ((t % (1 << 31)) * _GOLDEN) % (1 << 32)
            at = np.floor(point / float(1 << 32) * n_slots).astype(np.int64)
            src = owner[np.searchsorted(ends, at, "right")]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(src), pa.array(t // _CHUNK)], names=["t", "src", "c"])

    slots = spark.range(0, 3 * n_slots).mapInArrow(task(draw), "t long, src int, c long")
    counts = slots.groupBy("src", "c").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("src", "c").orderBy("t")) - 1
    ranked = slots.withColumn("i", inner).join(base, ["src", "c"]).select("t", "src", (F.col("base") + F.col("i")).alias("rank"))
    want = sources.select("src", (F.col("hi") - F.col("lo")).alias("slots"))
    return ranked.join(_hinted(want, len(cuts)), "src").filter(F.col("rank") < F.col("slots")).drop("slots")


def _hinted(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def _streams(sized: DataFrame, seed: int) -> DataFrame:
    """Place of each document in its source's shuffled stream (``pos``), without a task per source.

    The shuffle key is a hash; its high bits deal a source into buckets of some thousand rows, and sums
    of buckets give the places before.
    """
    n = max(1, sized.count())
    bits = max(0, min(30, (n // 2048).bit_length()))
    d = sized.withColumn("_k", F.xxhash64(F.lit(seed), "doc_id", "_h")).withColumn("_b", F.shiftrightunsigned("_k", 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("src", "_b").agg(F.sum("size").alias("s")).select("src", "_b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("src", "_b").orderBy("_k", "doc_id", "_h", "_row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["src", "_b"])
    return d.withColumn("pos", F.col("_base") + F.col("_in")).drop("_k", "_b", "_base", "_in")


def mix(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix of all documents: (documents, pieces).

    documents: _row, doc_id, size, source_size, target, taken.  pieces: t, _row, doc_id, h (hash of the
    whole row), p, size, first, words: in slot t of the mix stand so many words of the document's pass p from
    word ``first`` on.
    Only sizes and keys are shuffled, never texts.  Null text: size 0, taken 0.  Null source: a source of its
    own, last.  Repeated rows and doc_ids are documents of their own, told apart by ``_row``.  Empty
    table: no rows.  Other columns only tell rows apart.
    """
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), row_hash(docs).alias("_h")).withColumn("_row", F.monotonically_increasing_id())
    d = written(d, "sizes")
    sources, block = plan(d)
    sources = written(sources.coalesce(1), "sources")
    n_slots, n_sources = sources.agg(F.max("hi"), F.count("*")).first()
    n_slots = n_slots or 0
    known = d.join(_hinted(sources.select("src", F.col("source").alias("_s"), "source_size", "target", "quota"), n_sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    placed = _streams(known, seed)
    passes = F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))
    spans = placed.withColumn("p", passes).withColumn("a", F.col("pos") + F.col("p") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota"))).filter("a < b")
    spans = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    lo, hi = F.greatest("a", F.col("rank") * block), F.least("b", (F.col("rank") + 1) * block)
    spans = spans.select("src", "rank", "_row", "doc_id", F.col("_h").alias("h"), "p", "size", (lo - F.col("a")).alias("first"), (hi - lo).alias("words"))
    pieces = spans.join(schedule(sources, n_slots), ["src", "rank"]).select("t", "_row", "doc_id", "h", "p", "size", "first", "words")
    taken = pieces.groupBy("_row").agg(F.sum("words").alias("taken"))
    out = known.join(taken, "_row", "left").select("_row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return out, pieces


def mixed_documents(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows of docs as the mix takes them: one row for each pass over a document, none where it takes no
    words, and the text cut after its last word taken where the source's quota ends within it.

    Rows that differ in any column are documents of their own, with their own columns; rows that are the
    same in all are counted.
    """
    _, pieces = mix(docs, seed, doc_id, text, source)
    each = pieces.groupBy("_row", "doc_id", "h", "p", "size").agg(F.sum("words").alias("words"))
    names = docs.columns
    own, d, h, size, words, n = unused(names, "hash_", "doc_", "h_", "size_", "words_", "n_")
    taken = written(each.groupBy(F.col("doc_id").alias(d), F.col("h").alias(h), "p", F.col("size").alias(size), F.col("words").alias(words)).agg(F.count("*").alias(n)).drop("p"), "taken")
    keyed = docs.withColumn(own, row_hash(docs)).dropDuplicates([doc_id, own])  # rows that are the same
    rows = keyed.join(taken, F.col(f"`{doc_id}`").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)))
    rows = rows.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))

    def cut(batches):
        for batch in batches:
            most, all_ = batch.column(words).to_numpy(), batch.column(size).to_numpy()
            texts = batch.column(text)
            if (most < all_).any():
                texts = texts.to_pylist()
                for i in np.flatnonzero(most < all_):
                    texts[i] = texts[i][:next(itertools.islice(_WORDS.finditer(texts[i]), int(most[i]) - 1, None)).end()]
                texts = pa.array(texts, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([texts if c == text else batch.column(c) for c in names], names=names)

    return rows.select(*(f"`{c}`" for c in names), words, size).mapInArrow(task(cut), docs.schema)
