"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``ledger`` evaluates every rule once per document and stores the measurements and one bit per failed
rule.  A policy is a named, versioned mask of the rules that reject a document; applying another policy
or asking what a rule alone removes reads the bits, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, _SPACE, unused

#: Rules in the order of their bits: a document fails where the condition holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": tuple(RULES),
    "web-lenient-1": (*BASE, "symbols"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: windows sorted by hash, equal neighbours kept, the
    union of their word ranges measured from the sorted starts."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(n >= 4, F.array_sort(windows))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements.  Names that docs already has are replaced.  3-word windows are told apart by
    64-bit hashes."""
    docs = docs.drop(*(m for m in MEASURES if m != text))
    t, words, kept, win, at = unused([*docs.columns, *MEASURES], "t_", "words_", "lines_", "win_", "at_")
    d = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    squeezed = F.translate(t, _SPACE, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    d = d.withColumns({
        words: F.regexp_extract_all(t, F.lit(f"({WORD})"), 1), kept: lines,
        "word_chars": F.length(squeezed).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
    }).drop(t)
    d = d.withColumns({
        "n_words": F.size(words).cast("long"), "n_lines": F.size(kept).cast("long"),
        "n_dup_lines": (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"),
        win: _repeat_words(F.col(words)),
    }).drop(words, kept)
    w = F.col(win)
    hit = F.filter(w, lambda x, k: (F.get(w, k + 1)["h"] == x["h"]) | (F.get(w, k - 1)["h"] == x["h"]))
    d = d.withColumn(at, F.array_sort(F.transform(hit, lambda x: x["i"]))).drop(win)
    a = F.col(at)
    covered = F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(at)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its measurements and ``failed_bits`` (bit k: rule k of RULES failed).

    Row-wise and without a shuffle, so hot sources do not matter.  Null or empty text: no words, no
    lines, so only few_words fails.  Repeated rows are judged each for itself; an empty table gives an
    empty ledger; columns of docs named like a measurement or failed_bits are replaced.
    """
    d = measured(docs.drop("failed_bits"), text)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    # The row number is there for the optimiser alone: without it, a filter on the bits would be moved
    # below the measurements with all of their expressions copied into it, many times over.
    return d.withColumn("failed_bits", F.when(F.monotonically_increasing_id() >= 0, out.cast("int")))


def apply_policy(led: DataFrame, policy: str = "web-1") -> DataFrame:
    """Add ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failed_bits").bitwiseAND(mask(POLICIES[policy])) == 0)


def kept_documents(led: DataFrame, policy: str = "web-1") -> DataFrame:
    """Rows of the ledger that the policy keeps."""
    return apply_policy(led, policy).filter("kept").drop("kept")


def ablation(led: DataFrame, policy: str = "web-1") -> DataFrame:
    """Per rule of the policy: documents it fails, and documents only it rejects (kept without it).

    One aggregation over the stored bits, with partial sums in every task.
    """
    names, m = list(RULES), mask(POLICIES[policy])
    bit = {r: 1 << names.index(r) for r in POLICIES[policy]}
    bits = F.col("failed_bits").bitwiseAND(m)
    aggs = [F.count("*").alias("n")]
    for r, b in bit.items():
        aggs += [F.count_if(bits.bitwiseAND(b) != 0).alias(f"f_{r}"), F.count_if(bits == b).alias(f"o_{r}")]
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), F.col("n").alias("n_docs")) for r in bit]
    return led.agg(*aggs).select(F.inline(F.array(*rows)))
