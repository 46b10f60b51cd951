"""Overlapping chunks with exact offsets in UTF-16 units."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CHUNK_STRUCT

LEGACY_BUDGET, LEGACY_OVERLAP = 2048, 205
_SENTENCE = re.compile(r"[.!?] ")


def budget(max_input_tokens: int) -> tuple[int, int]:
    """Budget and overlap in UTF-16 units for a model of so many tokens."""
    size = max_input_tokens * 4 * 9 // 10
    return size, size // 10


def _strip(text: str) -> str:
    return text.strip("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85                 　")


def _units(text: str) -> list[int] | None:
    """Offset of each code point in UTF-16 units, and the end; None where they are the same."""
    if not text or max(text) <= "￿":
        return None
    out, at = [], 0
    for c in text:
        out.append(at)
        at += 2 if c > "￿" else 1
    return [*out, at]


def chunk_text(text: str | None, size: int = LEGACY_BUDGET, overlap: int = LEGACY_OVERLAP) -> list[dict]:
    """Chunks of a text, each cut at the last blank line, line end or sentence end of its last fifth, or at its full size."""
    if not text:
        return []
    units = _units(text)
    total = units[-1] if units else len(text)

    def point(u: int) -> int:  # code point that holds unit u
        if not units:
            return u
        return min(len(text), bisect.bisect_right(units, u) - 1)

    out, start = [], 0
    while start < total:
        end = min(start + size, total)
        cut = end
        if end < total:
            a, b = point(max(start + 1, end - size // 5)), point(end)
            if (i := text.rfind("\n\n", a, b)) >= 0:
                at = i + 2
            elif (i := text.rfind("\n", a, b)) >= 0:
                at = i + 1
            else:
                last = None
                for last in _SENTENCE.finditer(text, a, b):
                    pass
                at = last.start() + 1 if last else -1
            if at >= 0:
                cut = units[at] if units else at
        body = _strip(text[point(start):point(cut)])
        if body:
            out.append({"text": body, "position": len(out), "start_offset": start, "end_offset": cut})
        if cut >= total:
            break
        start = cut - overlap
    return out


def chunks(text, size: int = LEGACY_BUDGET, overlap: int = LEGACY_OVERLAP) -> Column:
    """Array of chunk structs of a text column, in Arrow batches."""

    @F.pandas_udf(CHUNK_STRUCT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: chunk_text(t, size, overlap))

    return run(text)


def chunk_table(files: DataFrame, size: int, overlap: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per chunk: the kept columns, then text, position, start_offset, end_offset."""
    listed = files.select(*keep, chunks(F.col(text), size, overlap).alias("_c"))
    return listed.select(*keep, F.inline("_c"))
