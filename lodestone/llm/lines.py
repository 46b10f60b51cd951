"""Line dedup by site-relative frequency.

Lines are grouped by site; the documents of a site that contain a line are divided by the documents of
the site, and lines above a boilerplate ratio are dropped from its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, unused, written

#: A line is boilerplate if it stands in over so many percent of a site's documents, and in so many at least.
RATIO_PERCENT, LEAST = 5, 5
#: Boilerplate lines that may be broadcast; beyond it the lines of all documents are joined instead.
BROADCAST_ROWS = 100_000


def _lines(text: str) -> Column:
    """Lines of a text as structs: as they are, and without the white space around them.  Empty there: no
    word, never counted or dropped."""
    return F.transform(F.split(F.col(f"`{text}`"), "\\n", -1), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(_SPACE)).alias("bare")))


def _with_word(lines: Column) -> Column:
    return F.filter(lines, lambda x: x["bare"] != "")


def boilerplate(docs: DataFrame, percent: int = RATIO_PERCENT, least: int = LEAST, text: str = "text", site: str = "source", by_text: bool = False) -> DataFrame:
    """Lines to drop: site, key (hash of the line without white space around it), n_docs, n_site.

    Distinct lines of a document are counted once.  With ``by_text``, documents of a site with the same
    lines (white space around them and empty lines aside) count as one, so copies of a text don't make
    its lines boilerplate.  Counts are summed in every task before the shuffle, so a line, text or site
    that a third of all rows share costs a row per task.
    """
    keys = F.transform(_with_word(F.col("l")), lambda x: F.xxhash64(x["bare"]))
    own = F.col(f"`{site}`").cast("string")
    rows = docs.select(own.alias("site"), _lines(text).alias("l")).select("site", keys.alias("keys"))
    sites = docs.select(own.alias("s"))
    if by_text:
        rows = written(rows.withColumn("text", F.xxhash64("keys")).dropDuplicates(["site", "text"]).drop("text"), "texts")
        sites = rows.select(F.col("site").alias("s"))
    found = rows.select("site", F.explode(F.array_distinct("keys")).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n_docs"))
    sites = sites.groupBy("s").agg(F.count("*").alias("n_site"))
    return found.filter(F.col("n_docs") >= least).join(sites, F.col("site").eqNullSafe(F.col("s"))).filter(F.col("n_docs") * 100 > F.col("n_site") * percent).drop("s")


def _tables(found: DataFrame, site: str, table: str) -> DataFrame:
    """Per site its keys as a hash table: as many slots as keys, key k in slot k modulo their number."""
    size = found.groupBy("site").agg(F.count("*").cast("int").alias("n"))
    slots = found.join(size.withColumnRenamed("site", "s"), F.col("site").eqNullSafe(F.col("s"))).groupBy("site", "n", F.pmod("key", F.col("n")).cast("int").alias("b")).agg(F.collect_list("key").alias("keys"))
    filled = slots.groupBy("site", "n").agg(F.map_from_entries(F.collect_list(F.struct("b", "keys"))).alias("m"))
    return filled.select(F.col("site").alias(site), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.coalesce(F.col("m")[b], F.array().cast("array<bigint>"))).alias(table))


def _has(table: Column, key: Column) -> Column:
    return F.array_contains(F.get(table, F.pmod(key, F.size(table)).cast("int")), key)


def drop_boilerplate(docs: DataFrame, percent: int = RATIO_PERCENT, least: int = LEAST, text: str = "text", site: str = "source", by_text: bool = False) -> DataFrame:
    """docs with ``text`` without its site's boilerplate lines, and n_lines, n_dropped (lines with a word).

    Rows stay, even if no line is left.  Null text stays null and has no lines; null sites are one site;
    repeated rows count as documents of their own, unless ``by_text``; an empty table stays empty; columns
    named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    l, rest, keys, at, row, i, x, key, drop = unused([*docs.columns, "n_lines", "n_dropped", "site", "key", "n_docs", "n_site"], "l_", "rest_", "keys_", "site_", "row_", "i_", "x_", "key_", "drop_")
    found = written(boilerplate(docs, percent, least, text, site, by_text), "lines")
    d = docs.withColumn(l, _lines(text))
    if found.count() <= BROADCAST_ROWS:
        own = F.broadcast(_tables(found, at, keys))
        d = d.join(own, F.col(f"`{site}`").cast("string").eqNullSafe(F.col(at)), "left").drop(at)
        left = F.filter(l, lambda v: (v["bare"] == "") | ~_has(F.col(keys), F.xxhash64(v["bare"])))
        d = d.withColumn(rest, F.when(F.col(keys).isNull(), F.col(l)).otherwise(left))
    else:
        rows = written(d.withColumn(row, F.monotonically_increasing_id()), "rows")
        parts = rows.select(row, F.col(f"`{site}`").cast("string").alias(at), F.posexplode(l).alias(i, x)).withColumn(key, F.when(F.col(x)["bare"] != "", F.xxhash64(F.col(x)["bare"])))
        known = found.select("site", F.col("key").alias("known"), F.lit(True).alias(drop))
        kept = parts.join(known, F.col(at).eqNullSafe(F.col("site")) & (F.col(key) == F.col("known")), "left").filter(F.col(drop).isNull())
        kept = kept.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(i, x))), lambda v: v[x]).alias(rest))
        d = rows.join(kept, row, "left").withColumn(rest, F.coalesce(rest, F.slice(l, 1, 0))).drop(row)
    n = lambda lines: F.greatest(F.size(lines), F.lit(0)).cast("long")  # noqa: E731  null text: no lines
    d = d.withColumns({"n_lines": n(_with_word(F.col(l))), "n_dropped": n(F.col(l)) - n(F.col(rest))})
    out = F.array_join(F.transform(rest, lambda v: v["line"]), "\n")
    return d.withColumn(text, out).select(*(f"`{c}`" for c in docs.columns), "n_lines", "n_dropped")
