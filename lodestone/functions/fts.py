"""Tokens of the lexical index and of queries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
TERM_GAP = r"[^\p{L}\p{M}\p{N}]+"


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters.  Other scripts keep their marks, and
    letters without a decomposition stay."""
    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(cp)
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and c == c.lower():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_MARKED, _BASE = _folds()


def fold(text) -> Column:
    return F.translate(F.lower(text), _MARKED, _BASE)


def tokens(text) -> Column:
    """Lower-cased, folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), 1)


def query_terms(query) -> Column:
    """Terms of a query as written: runs of letters, marks and digits."""
    return F.filter(F.split(query, TERM_GAP), lambda x: F.length(x) > 0)


def match_expression(query) -> Column:
    """Quoted terms joined by OR; empty if there are none."""
    return F.array_join(F.transform(query_terms(query), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")


def fold_python(text: str) -> str:
    return text.lower().translate(str.maketrans(_MARKED, _BASE))
