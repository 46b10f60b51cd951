"""Removal of long byte strings that occur more than once, by sparse suffix sorting.

Every string of ``length`` bytes holds an anchor: the gram of least hash among its grams, the rightmost of
equal ones, which depends on the string alone.  So two places of one string have an anchor at one offset,
and it is enough to compare what stands around anchors of one gram:

1. Grams that are an anchor at one place only are dropped.  Anchors whose whole surroundings (all strings
   that hold the gram) have the hash of another anchor's are repeated in full; in each batch one of them
   stands for the others.
2. For the others, the bytes to the right and, reversed, those to the left are sorted with deep-shallow
   sorting.  A string that starts i bytes before the gram is repeated if another anchor agrees in i bytes
   to the left and in the rest to the right: both are intervals of the sorted orders.  A gram of very many
   anchors is split by the bytes next to it: for a range lo to hi of i, only anchors that agree in lo bytes
   to the left and length - hi to the right can share a string, so these bytes divide the gram's group.

Equal texts are one text with a count.  Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import gram_hashes, joined, mix, running, substring_hashes
from .common import group_task, task, written
from .suffixes import deep_shallow
from .tokens import slices

LENGTH, GRAM = 200, 32
#: Anchors in a fragment of step 1, surroundings compared by a task in step 2, and bytes scanned at a time.
FRAGMENT, GROUP, SCAN_BYTES = 1_500_000, 20_000, 1_500_000
#: Anchors beyond which a group is split by the bytes next to its gram, and ranges that it is split into.
HOT, RANGES = 20_000, 8
_PLACE = (1 << 24) - 1
_PIECE = 1 << 22


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in the joined texts, ascending, and the hashes of their grams."""
    w = length - gram + 1
    n_windows = np.zeros(len(data) + 1, np.int64)
    size = np.diff(bounds)
    long = size >= length
    np.add.at(n_windows, bounds[:-1][long], 1)
    np.add.at(n_windows, bounds[1:][long] - length + 1, -1)
    inside = np.cumsum(n_windows)[:-1] > 0  # windows that start here end within their text
    places, hashes = [], []
    for a in range(0, len(data), _PIECE):  # places within a piece fit the low bits
        part = data[a:a + _PIECE + length - 1]
        if len(part) < length or not inside[a:a + _PIECE].any():
            continue
        h = mix(gram_hashes(running(part), gram))
        v = (h & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(h), dtype=np.uint64))
        n = len(v) - w + 1
        rows = -(-len(v) // w)
        block = np.full(rows * w, ~np.uint64(0))
        block[:len(v)] = v
        block = block.reshape(rows, w)
        ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(block, axis=1).ravel()
        low = np.minimum(ahead[:n], behind[w - 1:w - 1 + n])
        at = np.unique(_PLACE - (low[inside[a:a + n]] & np.uint64(_PLACE)).astype(np.int64))
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _surroundings(at: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each place, and the bounds of the strings that hold its gram, within the text."""
    doc = np.searchsorted(bounds, at, "right") - 1
    return doc, np.maximum(at - (length - gram), bounds[doc]), np.minimum(at + length, bounds[doc + 1])


def _scan(texts: DataFrame, n_fragments: int, length: int, gram: int) -> DataFrame:
    """Rows (frag, payload) with the anchors of one batch: text keys, counts, places, gram and context hashes.
    Of anchors with the same hashes in a batch one is sent, marked as one of several; the others go as rows of
    the batch's task (frag < 0)."""

    def run(batches):
        seen: set[int] = set()
        own = -1 - TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "t", SCAN_BYTES):
                key = part.column("key").to_numpy()
                fresh = np.array([k not in seen and not seen.add(k) for k in key.tolist()], bool)
                part, key = part.filter(pa.array(fresh)), key[fresh]
                data, bounds = joined(part.column("t"))
                at, h = anchors(data, bounds, length, gram)
                if not len(at):
                    continue
                doc, lo, hi = _surroundings(at, bounds, length, gram)
                sums = running(data)
                around = mix(substring_hashes(sums, lo, hi) + mix(((at - lo) * 1024 + hi - at).astype(np.uint64)))
                place = at - bounds[doc]
                order = np.lexsort((around, h))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (around[order][1:] != around[order][:-1])
                first = np.empty(len(h), bool)
                first[order] = new
                several = np.empty(len(h), bool)
                several[order] = np.diff(np.append(np.flatnonzero(new), len(h)))[np.cumsum(new) - 1] > 1
                frag = np.where(first, (h % np.uint64(n_fragments)).astype(np.int64), -1)
                order = np.argsort(frag, kind="stable")
                ends = np.searchsorted(frag[order], np.arange(-1, n_fragments + 1))
                frags, rows = [], []
                for f in np.flatnonzero(np.diff(ends)).tolist():
                    o = order[ends[f]:ends[f + 1]]
                    counts = np.bincount(doc[o], minlength=len(key))
                    used = np.flatnonzero(counts)
                    frags.append(f - 1 if f else own)
                    rows.append(np.array([len(used), len(o)], np.int64).tobytes() + key[used].tobytes() + counts[used].tobytes() + (place[o] * 2 + several[o]).tobytes() + (h[o].tobytes() + around[o].tobytes() if f else b""))
                yield pa.RecordBatch.from_arrays([pa.array(frags, pa.int32()), pa.array(rows, pa.binary())], names=["frag", "payload"])

    return texts.mapInArrow(task(run), "frag int, payload binary")


def _by_text(text: np.ndarray, place: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((place, text))
    text, packed = text[order], (place * 4 + kind)[order]
    cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, int)
    return pd.DataFrame({"key": text[cut], "places": [x.tobytes() for x in np.split(packed, cut[1:])] if len(cut) else []})


def _repeated(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Per text the places of anchors whose surroundings are repeated (full), and of those to compare."""
    parts = []
    for p in pdf["payload"]:
        k, n = np.frombuffer(p, np.int64, 2)
        body = np.frombuffer(p, np.int64, -1, 16)
        parts.append((np.repeat(body[:k], body[k:2 * k]), body[2 * k:2 * k + n], body[2 * k + n:2 * k + 2 * n].view(np.uint64), body[2 * k + 2 * n:].view(np.uint64)))
    text, place, h, around = (np.concatenate(x) for x in zip(*parts))
    if key[0] < 0:  # others of the batch stand for them
        return _by_text(text, place >> 1, np.ones(len(text), np.int64))
    several, place = place & 1, place >> 1
    order = np.lexsort((1 - several, place, text, around, h))
    text, place, h, around, several = text[order], place[order], h[order], around[order], several[order]
    new = np.ones(len(h), bool)  # one anchor of each text and place
    new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    text, place, h, around, several = text[new], place[new], h[new], around[new], several[new]
    h_start = np.ones(len(h), bool)
    h_start[1:] = h[1:] != h[:-1]
    c_start = h_start.copy()
    c_start[1:] |= around[1:] != around[:-1]
    h_of, c_of = np.cumsum(h_start) - 1, np.cumsum(c_start) - 1
    full = (np.bincount(c_of) + np.bincount(c_of, several))[c_of] > 1
    contexts = np.bincount(h_of, c_start)[h_of]
    compare = c_start & (contexts > 1)  # one anchor of each context, where a gram has two or more
    # a gram whose contexts are all repeated in full has nothing to find out
    open_ = np.bincount(h_of, compare & ~full)[h_of] > 0
    kind = np.where(full, 1, 0) + np.where(compare & open_, 2, 0)
    use = kind > 0
    return _by_text(text[use], place[use], kind[use])


def _contexts(marked: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (h, key, place, left, right, single) of the anchors to compare; left is reversed."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("t")[i].as_py().encode()
                packed = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("parts")[i].as_py()]))
                packed = packed[(packed & 2) > 0]
                if not len(packed):
                    continue
                place = packed >> 2
                h = mix(gram_hashes(running(np.frombuffer(data, np.uint8)), gram))[place].view(np.int64)
                left = [data[max(0, p - (length - gram)):p][::-1] for p in place.tolist()]
                right = [data[p:p + length] for p in place.tolist()]
                k = len(place)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(k, batch.column("key")[i].as_py())), pa.array(place), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array((packed & 1) == 0)], names=["h", "key", "place", "left", "right", "single"])

    return marked.mapInArrow(task(run), "h long, key long, place long, left binary, right binary, single boolean")


def _table(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    return out, np.fromiter(map(len, strings), np.int64, len(strings))


def _compare(length: int, gram: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Per single anchor the union (a, b) of the repeated strings that hold its gram and start lo to hi
        bytes before it."""
        empty = pd.DataFrame({"key": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        single, lo, hi = pdf["single"].to_numpy(), pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
        side = length - gram
        right, r_len = _table(list(pdf["right"]), -(-length // 8) * 8)
        left, l_len = _table(list(pdf["left"]), -(-side // 8) * 8)
        skip = gram // 8 * 8
        parts = np.column_stack([pdf["part"].to_numpy(), lo, np.ascontiguousarray(right[:, :skip]).view(np.int64)])
        order = np.lexsort(parts.T)  # groups by the bytes of the gram, not by its hash
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.concatenate([[False], (parts[order][1:] != parts[order][:-1]).any(1)]))
        r_order, r_common = deep_shallow(right, r_len, group, skip=skip)
        l_order, l_common = deep_shallow(left, l_len, group)
        n = len(group)
        most, least = np.full(n, -1), np.full(n, length + 1)
        r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
        for i in range(int(lo.min()), int(hi.max()) + 1):
            r_class[r_order] = np.cumsum(r_common < length - i)
            l_class[l_order] = np.cumsum(l_common < i)
            both = r_class * (n + 1) + l_class
            order = np.argsort(both, kind="stable")
            s = both[order]
            same = s[1:] == s[:-1]
            hit = np.zeros(n, bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            hit &= (lo <= i) & (i <= hi)
            most[hit] = i
            least[hit & (least > length)] = i
        use = single & (most >= 0)
        if not use.any():
            return empty
        place = pdf["place"].to_numpy()[use]
        return pd.DataFrame({"key": pdf["key"].to_numpy()[use], "a": place - most[use], "b": place + length - least[use]})

    return run


def _equal(rows: DataFrame, length: int) -> DataFrame:
    """The same where only one string of each anchor is left to look at, for groups of any size: the string's
    bytes are the key, and its first and last places are found in every task before the shuffle."""
    place = F.struct("key", F.col("place").alias("at"))
    rows = rows.select("key", "place", "lo", "single", F.expr("substring(left, 1, lo)").alias("l"), F.expr(f"substring(right, 1, {length} - lo)").alias("r"))
    often = rows.groupBy("lo", "l", "r").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x != y").select("lo", "l", "r")
    return rows.filter("single").join(often, ["lo", "l", "r"]).select("key", (F.col("place") - F.col("lo")).alias("a"), (F.col("place") - F.col("lo") + length).alias("b"))


def _spans(around: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, a, b): unions of repeated strings around single anchors."""
    found, width = [], length - gram + 1
    todo = around.withColumns({"lo": F.lit(0), "hi": F.lit(width - 1), "part": F.col("h")})
    while True:
        sizes = written(todo.groupBy("part", "lo").agg(F.count("*").alias("n")), "sizes")
        big = sizes.filter(F.col("n") > HOT).select("part", "lo")
        some = not big.isEmpty()
        n_groups = max(1, -(-(sizes.filter(F.col("n") <= HOT).agg(F.sum("n")).first()[0] or 0) // GROUP))
        rest = todo.join(big, ["part", "lo"], "left_anti") if some else todo
        found.append(rest.groupBy(F.pmod(F.xxhash64("part", "lo"), F.lit(n_groups)).alias("g")).applyInPandas(group_task(_compare(length, gram)), "key long, a long, b long"))
        if not some:
            break
        large = todo.join(big, ["part", "lo"], "left_semi")
        if width == 1:
            found.append(_equal(large, length))
            break
        width = -(-width // RANGES)
        ranges = large.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(width)))).withColumn("hi", F.least("hi", F.col("lo") + (width - 1)))
        near, far = F.expr("substring(left, 1, lo)"), F.expr(f"substring(right, 1, {length} - hi)")
        ranges = ranges.filter((F.octet_length("left") >= F.col("lo")) & (F.octet_length("right") >= length - F.col("hi")))
        todo = written(ranges.withColumn("part", F.xxhash64("part", "lo", near, far)), "ranges")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, parts, spans): for texts t under their key, packed places of anchors repeated in full, and
    spans (a, b) of repeated strings around the others."""
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_fragments = max(1, -(-(2 * size // (length - gram)) // FRAGMENT))
    found = _scan(docs.select("key", "t"), n_fragments, length, gram).groupBy("frag").applyInPandas(group_task(_repeated), "key long, places binary")
    found = written(found.groupBy("key").agg(F.collect_list("places").alias("parts")), "anchors")
    texts = docs.join(found, "key").groupBy("key").agg(F.first("t").alias("t"), F.first("parts").alias("parts"))
    around = written(_contexts(texts, length, gram), "contexts")
    spans = _spans(around, length, gram).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return written(found.join(spans, "key", "full_outer"), "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, spans array<struct<start, stop>> (maximal removed runs,
    in bytes of the text's UTF-8), kept binary (the other bytes).

    Null text: empty, nothing removed.  Texts under ``length`` bytes stay.  Repeated rows and copies of
    ``length`` bytes or more go in full, each of them.  Null and repeated ids are rows of their own.  Empty
    table: no rows.  Other columns are not read.  Equal texts and anchors with equal surroundings are found by
    64-bit hashes; all other strings are compared byte by byte.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("key", F.xxhash64("t"))
    marks = repeated_spans(d, length, gram)
    copies = d.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    marks = marks.join(copies, "key", "full_outer")
    joined_ = d.join(marks, "key", "left").select("doc_id", "t", "parts", "spans", "copies")

    def run(batches):
        for batch in batches:
            rows = []
            for doc, t, parts, spans, copies_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "parts", "spans", "copies"))):
                data = t.encode()
                n, runs = len(data), []
                if copies_ and n >= length:
                    runs = [(0, n)]
                else:
                    found = [(s["a"], s["b"]) for s in spans or ()]
                    for p in parts or ():
                        packed = np.frombuffer(p, np.int64)
                        for x in (packed[(packed & 1) > 0] >> 2).tolist():
                            found.append((max(0, x - (length - gram)), min(n, x + length)))
                    for a, b in sorted(found):
                        if runs and a <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                        else:
                            runs.append((a, b))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((doc, n, sum(b - a for a, b in runs), len(runs), [{"start": a, "stop": b} for a, b in runs], b"".join(kept)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    return joined_.mapInArrow(task(run), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary")
