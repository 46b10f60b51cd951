"""Winnowing fingerprints of whole documents, in DataFrame expressions only.

Every k-gram of code points is hashed; in every window of w successive grams the smallest hash is
selected, the rightmost of equal ones, and its position is kept.  Two texts that share a passage of
k + w - 1 code points share a selected hash, at the same place of the passage; shorter than k they
share nothing unless whole.  A text with fewer than k code points is one gram, an empty one has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Code points of a gram, and grams of a window.
K, W = 12, 32
#: Windows handled at a time; only what they select is kept, so a very long text needs little more memory.
_BLOCK = 2048
_PLACES = (1 << 31) - 1
#: Ranges of doc_id that documents are dealt into at the most: a bound of what the driver and plans hold.
#: Beyond it, ranges hold more rows; windows over them spill and give the same rows.
MOST_BUCKETS = 1 << 16


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside a lambda a repeated expression is evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_minima(values: Column, n: Column, w: int) -> Column:
    """Minima of all windows of w neighbours, by doubling the width; n: number of windows."""
    def wider(step: int):
        return lambda x: F.zip_with(x, F.slice(x, F.lit(step + 1), F.lit(_BLOCK + w)), lambda a, b: F.least(a, b))

    width, out = 1, values
    while width < w:
        step = min(width, w - width)
        out = _let(out, wider(step))
        width += step
    return F.slice(out, F.lit(1), n)


def selected(text: Column, k: int = K, w: int = W) -> Column:
    """Array of (hash << 31) + (2**31 - 1 - position) of the selected grams, in order of position.

    One number holds both, so the smallest is the smallest hash and, among equal ones, the rightmost.
    """
    # four bytes for each code point, so a gram is a slice of known place
    n_chars = F.length(text)
    n_grams = F.greatest(n_chars - (k - 1), F.least(n_chars, F.lit(1)))
    bound = F.struct(F.encode(text, "UTF-32").alias("units"), n_grams.alias("n_grams"))

    def whole(x: Column) -> Column:
        n_grams = x["n_grams"]
        n_windows = F.greatest(n_grams - (w - 1), F.least(n_grams, F.lit(1)))

        def gram(i: Column) -> Column:
            h = F.xxhash64(F.substring(x["units"], i * 4 + 1, F.lit(4 * k))).bitwiseAND(0xFFFFFFFF)
            return F.shiftleft(h, 31).bitwiseOR(F.lit(_PLACES) - i)

        def block(b: Column) -> Column:
            first = b * _BLOCK
            n = F.least(F.lit(_BLOCK), n_windows - first)
            grams = F.transform(F.sequence(first, F.least(first + n + (w - 1), n_grams) - 1), gram)
            return F.array_distinct(_window_minima(grams, n, w))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n_windows - 1) / _BLOCK).cast("int")), block))

    return F.when(n_grams > 0, F.array_distinct(_let(bound, whole))).otherwise(F.array().cast("array<bigint>"))


def hashes(sel: Column) -> Column:
    return F.transform(sel, lambda x: F.shiftright(x, 31))


def positions(sel: Column) -> Column:
    return F.transform(sel, lambda x: (F.lit(_PLACES) - x.bitwiseAND(_PLACES)).cast("int"))


def as_string(sel: Column) -> Column:
    """The hashes in order of position, eight hexadecimal digits each."""
    return F.array_join(F.transform(sel, lambda x: F.lpad(F.lower(F.hex(F.shiftright(x, 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, k: int = K, w: int = W, text: str = "text") -> DataFrame:
    """docs with n_chars, hashes array<bigint> and positions array<int> of the selected grams.

    Row by row, without a shuffle.  Null text is empty, and an empty text selects nothing.  Repeated
    rows have equal fingerprints; an empty table stays empty; columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.drop("n_chars", "hashes", "positions", "_sel").withColumn("n_chars", F.length(t).cast("long")).withColumn("_sel", selected(t, k, w))
    return d.withColumns({"hashes": hashes(F.col("_sel")), "positions": positions(F.col("_sel"))}).drop("_sel")


def _shifted(sel: Column, by: Column) -> Column:
    """Selections of a text that starts ``by`` code points later."""
    return F.transform(sel, lambda x: x - by)


def _bounds(ids: DataFrame, rows: int) -> tuple[list[int], int]:
    """Ascending bounds that deal the ids into buckets of about ``rows`` rows, MOST_BUCKETS at most, an id of
    many rows several times; and the buckets that null ids need."""
    n, known = ids.agg(F.count("*"), F.count("doc_id")).first()
    rows = max(rows, -(-n // MOST_BUCKETS))
    if known // rows < 1:
        return [], (n - known) // rows
    n_cuts = known // rows
    cuts = ids.agg(F.percentile_approx("doc_id", [i / (n_cuts + 1) for i in range(1, n_cuts + 1)], 20 * (n_cuts + 1))).first()[0]
    return sorted(cuts or []), (n - known) // rows


def _further(listed: Column, below: Column, step: int):
    return lambda x: F.when(F.get(listed, x + (step - 1)) < below, x + step).otherwise(x)


def _below(value: Column, bounds: list[int]) -> Column:
    """How many of the bounds are below the value, by bisection; null: 0."""
    at = F.lit(0)
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    step = 1 << max(0, len(bounds).bit_length() - 1)
    while bounds and step:
        at = _let(at, _further(listed, value, step))
        step //= 2
    return at


def _bucket(value: Column, h: Column, bounds: list[int], n_null: int) -> Column:
    """The bucket of a row in the order of (id, hash): how many bounds are not above the id; an id that is a
    bound several times, and null ids, which come first, are dealt by ranges of the hash."""
    share = h / F.lit(float(1 << 64)) + 0.5
    upto = _below(value + 1, bounds)
    if len(set(bounds)) < len(bounds):
        low = _below(value, bounds)
        upto = F.when(upto - low > 1, low + 1 + F.least(F.floor(share * (upto - low)).cast("int"), upto - low - 1)).otherwise(upto)
    if n_null:
        upto = F.when(value.isNull(), F.least(F.floor(share * (n_null + 1)).cast("int"), F.lit(n_null)) - n_null).otherwise(upto)
    return upto


def compared_with_next(docs: DataFrame, k: int = K, w: int = W, doc_id: str = "doc_id", text: str = "text", rows: int = 1000) -> DataFrame:
    """Each text, its edited text (the last quarter replaced by the start of the next text) and the next
    text, by their fingerprints: doc_id, n_chars, edited (text), sel, edited_sel, near_edited, near_next.

    Documents are dealt by ranges of (doc_id, hash) into buckets, each followed by a copy of the first row of the
    next one, so "next" is a neighbour in a sorted bucket; after the last document comes the first.
    Texts are shuffled once.  Windows that a text shares with its edited text are hashed once.
    Null text: empty.  Null doc_id: first.  Rows with one id stand in order of their texts' hashes, each a
    document of its own.  Empty table: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("h"))
    ids = written(docs.select("doc_id", "h"), "ids")
    bucket = _bucket(F.col("doc_id"), F.col("h"), *_bounds(ids, rows))
    firsts = ids.withColumn("b", bucket).groupBy("b").agg(F.min(F.struct("doc_id", "h")).alias("f")).orderBy("b").collect()
    ghosts = [(r["f"]["doc_id"], r["f"]["h"], firsts[i - 1]["b"]) for i, r in enumerate(firsts)]  # one row a bucket
    ghosts = spark.createDataFrame(ghosts or [(None, 0, 0)], "g_id long, g_h long, g_b int")
    own = docs.withColumn("b", bucket)
    copies = own.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h"))).select("doc_id", "t", "h", F.col("g_b").alias("b"), F.lit(1).alias("ghost"))
    dealt = own.select("doc_id", "t", "h", "b", F.lit(0).alias("ghost")).unionByName(copies).repartition("b")
    # sorted while rows are texts only; projections keep the order, so the window sorts nothing again
    by = ["ghost", F.col("doc_id").asc_nulls_first(), "h"]
    dealt = dealt.sortWithinPartitions("b", *by)

    span = k + w - 1
    n = F.length("t")
    q = F.floor(n / 4).cast("int")
    # windows that start at least `cut` code points in reach into the replaced part
    d = dealt.withColumns({"n": n, "q": q, "cut": F.greatest(n - q - (span - 1), F.lit(0))})
    d = d.withColumn("shared", F.when(F.col("cut") > 0, selected(F.left("t", F.col("n") - F.col("q")), k, w)).otherwise(F.array().cast("array<bigint>")))
    tail = _tail(F.substring("t", F.col("cut") + 1, F.col("n")), k, w)
    d = d.withColumn("sel", F.array_distinct(F.concat("shared", _shifted(tail, F.col("cut")))))
    d = d.withColumn("hashes", F.array_distinct(hashes(F.col("sel"))))
    order = Window.partitionBy("b").orderBy(*by)
    d = d.withColumn("next", F.lead(F.struct("t", "hashes")).over(order)).filter("ghost = 0")
    d = d.withColumn("edited", F.concat(F.left("t", F.col("n") - F.col("q")), F.left("next.t", F.col("q"))))
    tail = _tail(F.substring("edited", F.col("cut") + 1, F.col("n")), k, w)
    d = d.withColumn("edited_sel", F.array_distinct(F.concat("shared", _shifted(tail, F.col("cut")))))
    near = {"near_edited": likeness(F.col("hashes"), F.array_distinct(hashes(F.col("edited_sel")))), "near_next": likeness(F.col("hashes"), F.col("next.hashes"))}
    return d.withColumns(near).select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited", "sel", "edited_sel", *near)


def _tail(text: Column, k: int, w: int) -> Column:
    """Selections of the part after ``cut``; where windows are shared, a part too short for one adds none."""
    return F.when((F.col("cut") > 0) & (F.length(text) < k + w - 1), F.array().cast("array<bigint>")).otherwise(selected(text, k, w))
