"""BM25 over chunks, with statistics of the whole index and a scope applied afterwards."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fts

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def query_terms(query: str) -> Counter:
    """Folded terms of a query and how often each occurs."""
    import re
    import unicodedata

    parts, word = [], ""
    for c in query + " ":
        if unicodedata.category(c)[0] in "LMN":
            word += c
        elif word:
            parts.append(word)
            word = ""
    out: Counter = Counter()
    for p in parts:
        out.update(re.findall(r"[^\W_]+", fts.fold_python(p)))
    return out


def term_counts(chunks: DataFrame, terms: list[str], key: str = "chunk_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One pass over the texts: key, extra columns, length in tokens, and the count of each term."""
    own = chunks.select(key, *extra, fts.tokens(F.col(text)).alias("_t"))
    counts = F.array(*[F.size(F.filter("_t", _is(t))) for t in terms])
    return own.select(key, *extra, F.size("_t").alias("len"), counts.alias("tf"))


def _is(term: str):
    return lambda x: x == F.lit(term)


def _score(n_terms: int, repeats: list[int]) -> Column:
    total = F.lit(0.0)
    for i in range(n_terms):
        f, df, n = F.col("tf")[i].cast("double"), F.col("df")[i].cast("double"), F.col("n").cast("double")
        idf = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        total = total + repeats[i] * F.when(f > 0, part).otherwise(F.lit(0.0))
    return total


def scores(chunks: DataFrame, query: str, scope: Column | None = None, key: str = "chunk_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """All chunks with a term of the query: key, extra columns, score.  No terms, no rows.

    Texts are read and tokenised once: what is kept of a chunk, its length and one count per term, is
    dealt out once by the key, and both the statistics (one row) and the scores read that exchange.  So
    nothing but the finished score may be filtered: any other filter would be moved below the exchange of
    one of the two, and the texts be read again.
    """
    terms = query_terms(query)
    names, repeats = list(terms), list(terms.values())
    if not names:
        return chunks.select(key, *extra).withColumn("score", F.lit(0.0)).limit(0)
    counted = term_counts(chunks, names, key, text, extra).repartition(key, *extra)
    found = F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(names))])
    stats = counted.agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("avgdl"), found.alias("df"))
    score = _score(len(names), repeats)
    if scope is not None:
        score = F.when(scope, score)
    return counted.crossJoin(F.broadcast(stats)).select(key, *extra, score.alias("score")).filter("score > 0")  # stats: one row


def search(chunks: DataFrame, query: str, k: int, scope: Column | None = None, key: str = "chunk_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """The k best chunks: key, extra columns, score.  Ties in order of the key."""
    return best(scores(chunks, query, scope, key, text, extra), k, key)


def best(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def build_postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The inverted index: postings (term, key, extra columns, tf, and len, the chunk's tokens) and lengths
    (key, extra columns, len), to be written once and reused."""
    own = chunks.select(key, *extra, fts.tokens(F.col(text)).alias("_t")).select("*", F.size("_t").alias("len"))
    postings = own.select(key, *extra, "len", F.explode("_t").alias("term")).groupBy("term", key, *extra, "len").agg(F.count("*").cast("int").alias("tf"))
    return postings, own.drop("_t")


def index_size(lengths: DataFrame) -> DataFrame:
    """Statistics of an index, one row: n chunks, and avgdl, their mean length."""
    return lengths.agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("avgdl"))


def index_scores(postings: DataFrame, size: DataFrame, query: str, scope: Column | None = None, key: str = "chunk_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """The same scores from an index: only the query's postings are read.  size: n, avgdl, one row."""
    terms = query_terms(query)
    if not terms:
        return postings.select(key, *extra).withColumn("score", F.lit(0.0)).limit(0)
    own = postings.filter(F.col("term").isin(list(terms)))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    repeat = F.create_map(*[x for t, c in terms.items() for x in (F.lit(t), F.lit(c))])
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    part = F.element_at(repeat, F.col("term")) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    hits = own if scope is None else own.filter(scope)
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # df: a row per query term; size: one row
    return rows.groupBy(key, *extra).agg(F.sum(part).alias("score"))


def search_postings(postings: DataFrame, lengths: DataFrame, query: str, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best chunks from an index."""
    return best(index_scores(postings, index_size(lengths), query, None, key), k, key)
