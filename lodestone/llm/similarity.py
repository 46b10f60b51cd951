"""N-gram Jaccard join with vertical partitioning.

The order of all word shingles is cut into fragments; each fragment is handled alone, counts partial
results per document or per pair, and the partial counts are summed.

1. Fragments count in how many different sets each shingle occurs.  A set can only link when the
   required share of its shingles occurs elsewhere; summed over the fragments, this leaves the sets
   that can link at all.  Documents with equal sets are one class throughout.
2. Among these, shingles are ordered by frequency.  Two sets that link share one of the first
   n - ceil(t * n) + 1 shingles of each (prefix); sets that share one form a list, and lists that hang
   together a cluster.
3. In turns, fragments count the overlaps of some sets, the queries, with the sets of their lists that are
   not yet in one component with them; summed per pair they give the exact Jaccard values and so the
   links, of which only stars between components are kept.  First queries are a few leaders of each
   cluster.  A set is open if it was no query and stands outside the component that has most such sets of
   one of its lists; next queries are leaders of the open sets, ten times as many a cluster in each turn,
   until no set is open.  Where a bounded number of shingles is left to be compared, all open sets are the
   queries of a last turn.  Then no pair of a list is left: one of the two was a query, or both are in one
   component.

So components are exact, while a group of near copies costs a few queries a set instead of all pairs.
Where there are many sets or pairs, a fragment is also cut into parts: clusters are dealt to them whole, and
a large cluster by its sets, with its queries in all of its parts.  Partial overlaps are dealt to so many
buckets that each holds a bounded number, by cluster and queries and, in a large cluster, by the other set.
So a shingle that a third of all sets hold is no group of one task, and groups don't grow with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, shingle_sets
from .common import group_task, row_hash, small_batches, task, written
from .components import roots, stars
from .tokens import slices

#: Words of a shingle, and the least Jaccard similarity in percent.
WORDS, PERCENT = 5, 80
#: Shingles that a fragment holds on average; the number of fragments follows from the data.
FRAGMENT = 1_500_000
#: The same among sets that can link, sets that a fragment's part deals with, and pair increments made at a
#: time.  A fragment with twice its shingles has some of very many sets and is cut by sets.
JOIN_FRAGMENT, PART, INCREMENTS = 1_000_000, 200_000, 500_000
#: Bytes of text shingled at a time, and shingles of sets packed at a time.
SCAN_BYTES, PACKED = 6_000_000, 1_000_000
#: Bytes of packed rows that a worker hands on at a time; they are in memory on both sides.
SENT = 2_000_000
#: Leaders of a cluster in the first turn, and times as many in each further turn; queries of one cluster
#: whose links are found together.
SEEDS, GROWTH, TOGETHER = 6, 10, 16
#: Shingles that the queries of a turn may be compared with for all open sets to be queries.
AT_ONCE = 500_000_000
#: Partial overlaps that are summed together, and pairs that a fragment's part may have, at the most.
SUMMED = 1_000_000
#: A cluster is cut by sets where it has more than one in so many of a part's sets or pairs, or of a bucket's overlaps.
SHARE = 8


def _fragments(total: int, each: int) -> int:
    return max(1, -(-total // each))


def _cuts(n: int) -> np.ndarray:
    """Upper bounds of n equal fragments of the 64-bit order."""
    return np.array([((1 << 64) * (i + 1)) // n - 1 for i in range(n)], np.uint64)


def _class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins in sorted rows."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _sent(names: list[str], types: list[pa.DataType], *cols: list) -> Iterator[pa.RecordBatch]:
    """Rows whose last column are packed bytes, in batches of some SENT bytes; cols are emptied."""
    while cols[0]:
        n = max(1, int(np.searchsorted(np.cumsum(np.fromiter(map(len, cols[-1]), np.int64, len(cols[-1]))), SENT, "right")))
        batch = pa.RecordBatch.from_arrays([pa.array(c[:n], t) for c, t in zip(cols, types)], names=names)
        for c in cols:
            del c[:n]
        yield batch


def _scan(docs: DataFrame, n_fragments: int, words: int) -> DataFrame:
    """Packed rows (frag, payload).  frag >= 0: classes of one batch with their shingles in that fragment,
    as class ids, counts, and 32-bit places within the fragment, and the places that several classes of
    the batch have: these are sent once, and counted for their classes here (local).  frag < 0, one number
    per task: the members (cid, doc_id, h, n, local) of one batch."""
    cuts = _cuts(n_fragments)
    low = np.concatenate([[0], cuts[:-1] + np.uint64(1)]).astype(np.uint64)
    shift = np.uint64(max(0, int(cuts[0]).bit_length() - 32))

    def places(flat: np.ndarray, frag: np.ndarray) -> np.ndarray:
        return ((flat - low[frag]) >> shift).astype(np.uint32)

    def packed(part: pa.RecordBatch, task: int) -> tuple[list[int], list[bytes]]:
        sets = shingle_sets(part.column("t"), words)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        cid = np.fromiter((_class_id(s) if len(s) else 0 for s in sets), np.int64, len(sets))
        ids, first, of = np.unique(cid[n > 0], return_index=True, return_inverse=True)
        own = [sets[i] for i in np.flatnonzero(n > 0)[first]]
        local, frags, rows = np.zeros(len(sets), np.int64), [], []
        if own:
            flat, who = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(s) for s in own])
            del sets
            order = np.argsort(flat, kind="stable")
            s = flat[order]
            new = _starts(s)
            several = ~(new & np.append(new[1:], True))
            many = np.empty(len(flat), bool)
            many[order] = several
            local[n > 0] = np.bincount(who[many], minlength=len(own))[of]
            shared = s[several & new]
            del order, s, new, several
            flat, who = flat[~many], who[~many]
            frag, s_ends = np.searchsorted(cuts, flat).astype(np.int32), np.searchsorted(np.searchsorted(cuts, shared), np.arange(n_fragments + 1))
            order = np.argsort(frag, kind="stable")
            place, who = places(flat, frag)[order], who[order]
            ends = np.searchsorted(frag[order], np.arange(n_fragments + 1))
            del flat, frag, order, many
            for f in np.flatnonzero((np.diff(ends) > 0) | (np.diff(s_ends) > 0)).tolist():
                counts = np.bincount(who[ends[f]:ends[f + 1]], minlength=len(own)).astype(np.uint32)
                used = np.flatnonzero(counts)
                again = shared[s_ends[f]:s_ends[f + 1]]
                frags.append(f)
                rows.append(np.array([len(used), len(again)], np.int64).tobytes() + ids[used].tobytes() + counts[used].tobytes() + places(again, np.full(len(again), f)).tobytes() + place[ends[f]:ends[f + 1]].tobytes())
        sink = pa.BufferOutputStream()
        members = pa.RecordBatch.from_arrays([pa.array(cid, mask=n == 0), part.column("d"), part.column("h"), pa.array(n), pa.array(local)], names=["cid", "doc_id", "h", "n", "local"])
        with pa.ipc.new_stream(sink, members.schema) as out:
            out.write_batch(members)
        return [*frags, task], [*rows, sink.getvalue().to_pybytes()]

    def run(batches):
        task = -1 - TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "t", SCAN_BYTES):
                yield from _sent(["frag", "payload"], [pa.int32(), pa.binary()], *packed(part, task))

    return docs.mapInArrow(task(run), "frag int, payload binary")


def _shared(n_buckets: int):
    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Members as they are; per bucket of classes, one row of class ids and the numbers of their
        shingles in this fragment that another class has too."""
        if key[0] < 0:
            return pd.DataFrame({"bucket": -1, "payload": pdf["payload"]})
        ids, counts, again, places = [], [], [], []
        for p in pdf["payload"]:
            k, m = np.frombuffer(p, np.int64, 2).tolist()
            ids.append(np.frombuffer(p, np.int64, k, 16))
            counts.append(np.frombuffer(p, np.uint32, k, 16 + 8 * k))
            again.append(np.frombuffer(p, np.uint32, m, 16 + 12 * k))
            places.append(np.frombuffer(p, np.uint32, -1, 16 + 12 * k + 4 * m))
        classes, who = np.unique(np.concatenate(ids), return_inverse=True)
        pairs = (np.concatenate(places).astype(np.uint64) << np.uint64(32)) | np.repeat(who, np.concatenate(counts)).astype(np.uint64)
        pairs.sort()
        pairs = pairs[_starts(pairs)]
        place = pairs >> np.uint64(32)
        same = place[1:] == place[:-1]
        also = np.zeros(len(place), bool)
        also[1:] |= same
        also[:-1] |= same
        also |= np.isin(place, np.unique(np.concatenate(again)).astype(np.uint64))
        n = np.bincount((pairs[also] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(classes))
        use = np.flatnonzero(n > 0)
        rows = [(b, classes[own].tobytes() + n[own].tobytes()) for b, own in _cut(classes[use] % n_buckets, use)]
        return pd.DataFrame(rows, columns=["bucket", "payload"])

    return count


def _members(state: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for p in batch.column("payload"):
                yield from pa.ipc.open_stream(p.as_py())

    return state.filter("bucket < 0").mapInArrow(task(run), "cid long, doc_id long, h long, n long, local long")


def _summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The partial numbers of a bucket's classes, summed, some rows at a time."""
    classes, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(pdf["payload"].map(len).to_numpy()) // SENT
    for _, payloads in pdf["payload"].groupby(ends):
        both = np.concatenate([np.stack([classes, shared]), *(np.frombuffer(p, np.int64).reshape(2, -1) for p in payloads)], axis=1)
        classes, who = np.unique(both[0], return_inverse=True)
        shared = np.bincount(who, both[1], len(classes)).astype(np.int64)
    return pd.DataFrame({"cid": classes, "shared": shared})


def _hashed(ids: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.asarray(n, np.uint64)).astype(np.int64)


def _blocks(batches, names: list[str]):
    """Sets of some million shingles at a time: long columns, sizes, shingles, and the set of each shingle."""
    cols, sets, total = [[] for _ in names], [], 0

    def block():
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        return [np.array(c, np.int64) for c in cols], size, np.concatenate(sets), np.repeat(np.arange(len(sets)), size)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        for i, p in enumerate(batch.column("shingles")):
            sets.append(np.frombuffer(p.as_py(), np.uint64))
            total += len(sets[-1])
            for own, c in zip(cols, columns):
                own.append(c[i])
            if total >= PACKED:
                yield block()
                cols, sets, total = [[] for _ in names], [], 0
    if sets:
        yield block()


def _pack(cols: list[np.ndarray], who: np.ndarray, *entries: np.ndarray) -> bytes:
    """The sets that entries belong to (``who``, ascending), with their long columns, their numbers of
    entries, and the entries."""
    counts = np.bincount(who, minlength=len(cols[0]))
    used = np.flatnonzero(counts)
    return b"".join([np.array([len(used)], np.int64).tobytes(), *(c[used].tobytes() for c in cols), counts[used].tobytes(), *(e.tobytes() for e in entries)])


def _unpacked(payloads, n_cols: int, n_entries: int = 1) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Long columns, sizes, entries, and the set of each entry."""
    cols, size, entries = [[np.zeros(0, np.int64)] for _ in range(n_cols)], [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(n_entries)]
    for p in payloads:
        k = int(np.frombuffer(p, np.int64, 1)[0])
        head = np.frombuffer(p, np.int64, k * (n_cols + 1), 8).reshape(n_cols + 1, k)
        for own, c in zip(cols, head):
            own.append(c)
        size.append(head[-1])
        for own, e in zip(entries, np.frombuffer(p, np.uint64, -1, 8 + 8 * k * (n_cols + 1)).reshape(n_entries, -1)):
            own.append(e)
    size = np.concatenate(size)
    return [np.concatenate(c) for c in cols], size, [np.concatenate(e) for e in entries], np.repeat(np.arange(len(size)), size)


def _cut(key: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places ``at``, ascending, of each key."""
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    return list(zip(values.tolist(), np.split(at[order], first[1:]) if len(values) else []))


def _split(sets: DataFrame, n_fragments: int, hot: dict[int, int]) -> DataFrame:
    """Packed rows (frag, part, payload) of sets (cid, n) and their shingles in a fragment; hot fragments are
    cut into so many parts by the hash of the set."""
    cuts, parts = _cuts(n_fragments), np.ones(n_fragments, np.int64)
    parts[list(hot)] = list(hot.values())
    most = int(parts.max())

    def run(batches):
        for cols, _, flat, who in _blocks(batches, ["cid", "n"]):
            frag = np.searchsorted(cuts, flat)
            rows = [(v // most, v % most, _pack(cols, who[own], flat[own])) for v, own in _cut(frag * most + _hashed(cols[0][who], parts[frag]), np.arange(len(flat)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["frag", "part", "payload"])

    return sets.mapInArrow(task(run), "frag int, part int, payload binary")


def _dealt(sets: DataFrame, n_fragments: int, n_parts: int) -> DataFrame:
    """Packed rows (frag, part, asks, payload) of sets and their shingles in a fragment: each cluster in the
    part of its hash, or dealt by the hash of the set to ``spread`` parts; and, with ``asks``, the sets that are
    queries (splits > 0) in all parts of their cluster."""
    cuts = _cuts(n_fragments)

    def run(batches):
        for (*cols, spread, splits), _, flat, who in _blocks(batches, ["cid", "n", "cluster", "comp", "spread", "splits"]):
            frag, home, mine = np.searchsorted(cuts, flat), _hashed(cols[2], n_parts), np.flatnonzero(splits[who])
            turns = [(False, cols, np.arange(len(flat)), _hashed(cols[0], spread))]
            turns += [(True, [*cols, splits], mine[spread[who[mine]] > i], i) for i in range(int(spread[who[mine]].max(initial=0)))]
            for asks, own, at, place in turns:
                part = ((home + place) % n_parts)[who[at]]
                rows = [(v // n_parts, v % n_parts, asks, _pack(own, who[x], flat[x])) for v, x in _cut(frag[at] * n_parts + part, at)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["frag", "part", "asks", "payload"])

    return sets.mapInArrow(task(run), "frag int, part int, asks boolean, payload binary")


def _counts(sets: DataFrame, n_fragments: int) -> DataFrame:
    """Per fragment the shingles of two or more sets and the numbers of their sets, summed in tasks first, and
    the parts it is cut into."""
    cuts, each = _cuts(n_fragments), JOIN_FRAGMENT

    def run(batches):
        for _, _, flat, _ in _blocks(batches, []):
            s, n = np.unique(flat, return_counts=True)
            ends = np.searchsorted(np.searchsorted(cuts, s), np.arange(n_fragments + 1))
            rows = [(f, s[ends[f]:ends[f + 1]].tobytes() + n[ends[f]:ends[f + 1]].tobytes()) for f in np.flatnonzero(np.diff(ends)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["frag", "payload"])

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, n = np.concatenate([np.frombuffer(p, np.uint64).reshape(2, -1) for p in pdf["payload"]], axis=1)
        s, at = np.unique(s, return_inverse=True)
        n = np.bincount(at, n.astype(np.float64)).astype(np.uint64)
        size = int(n.sum())
        parts = _fragments(size, each) if size > 2 * each else 1
        return pd.DataFrame({"frag": [key[0]], "parts": [parts], "payload": [s[n > 1].tobytes() + n[n > 1].tobytes()]})

    return sets.select("shingles").mapInArrow(task(run), "frag int, payload binary").groupBy("frag").applyInPandas(group_task(total), "frag int, parts int, payload binary")


def _frequencies(n_buckets: int):
    def run(key: tuple, pieces: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        """Per bucket of sets their shingles of this fragment that occur in two or more sets, and in how many."""
        if not len(pieces) or not len(counts):
            return pd.DataFrame({"bucket": [], "payload": []})
        cols, _, (flat,), who = _unpacked(pieces["payload"], 2)
        s, n = np.frombuffer(counts["payload"].iloc[0], np.uint64).reshape(2, -1)
        if not len(s):
            return pd.DataFrame({"bucket": [], "payload": []})
        at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
        bucket = _hashed(cols[0], n_buckets)[who]
        use = np.flatnonzero(s[at] == flat)
        order = use[np.argsort(bucket[use], kind="stable")]
        values, first = np.unique(bucket[order], return_index=True)
        rows = [(v, _pack(cols, who[own], flat[own], n[at[own]])) for v, own in zip(values.tolist(), np.split(order, first[1:]) if len(values) else [])]
        return pd.DataFrame(rows, columns=["bucket", "payload"])

    return run


def _prefixes(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Postings (shingle, cid) of the prefixes in the order of (frequency, shingle).  Shingles of one set
        stand first in its order and link nothing, so they only use the prefix up."""
        (cid, n), _, (flat, freq), who = _unpacked(pdf["payload"], 2, 2)
        ids, first, of = np.unique(cid, return_index=True, return_inverse=True)
        n, who = n[first], of[who]
        common = np.bincount(who, minlength=len(ids))
        order = np.lexsort((flat, freq, who))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(common) - common, common)
        length = n - -(-percent * n // 100) + 1 - (n - common)
        use = order[rank < length[who[order]]]
        return pd.DataFrame({"shingle": flat[use].view(np.int64), "cid": ids[who[use]]})

    return run


def _overlaps(percent: int, n_buckets: int, n_groups: int):
    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Partial overlaps of queries (x) with the sets of this part (y) in this fragment, packed by bucket,
        where x and y are of one cluster and two components and the sizes allow a link: those of the sets,
        and those of what they have in other fragments."""
        asks = pdf["asks"].to_numpy()
        (y_cid, y_n, y_cluster, y_comp), y_size, (y_flat,), y_who = _unpacked(pdf["payload"][~asks], 4)
        (x_cid, x_n, x_cluster, x_comp, x_splits), x_size, (x_flat,), x_who = _unpacked(pdf["payload"][asks], 5)
        rows = []
        if len(x_flat) and len(y_flat):
            flat, cluster = np.concatenate([y_flat, x_flat]), np.concatenate([y_cluster[y_who], x_cluster[x_who]])
            order = np.lexsort((flat, cluster))
            run = np.cumsum(_starts(flat[order], cluster[order])) - 1
            mine = order >= len(y_flat)
            y_at, y_run = y_who[order[~mine]], run[~mine]  # sets that have the shingle of each run
            length = np.bincount(y_run, minlength=run[-1] + 1)
            first = np.cumsum(length) - length
            x_at, x_run = x_who[order[mine] - len(y_flat)], run[mine]
            by_query = np.argsort(x_at, kind="stable")
            x_at, x_run = x_at[by_query], x_run[by_query]
            reps, m = length[x_run], len(y_cid)
            starts = np.flatnonzero(_starts(x_at))
            block = np.add.reduceat(reps, starts).cumsum() // INCREMENTS
            group = x_cluster + _hashed(x_cid, n_groups)
            for k in np.unique(block):  # whole queries, about INCREMENTS increments at a time
                own = np.flatnonzero(block == k)
                a, b = starts[own[0]], starts[own[-1] + 1] if own[-1] + 1 < len(starts) else len(x_at)
                r = reps[a:b]
                off = np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
                x, y = np.repeat(x_at[a:b], r), y_at[np.repeat(first[x_run[a:b]], r) + off]
                apart = x_comp[x] != y_comp[y]
                pair, c = np.unique(x[apart] * m + y[apart], return_counts=True)
                x, y = pair // m, pair % m
                elsewhere = np.minimum(x_n[x] - x_size[x], y_n[y] - y_size[y])
                fits = (100 + percent) * (c + elsewhere) >= percent * (x_n[x] + y_n[y])
                x, y, c = x[fits], y[fits], c[fits]
                bucket = _hashed(group[x] + (_hashed(y_cid[y], x_splits[x]) << 32), n_buckets)
                order = np.argsort(bucket, kind="stable")
                values, cut = np.unique(bucket[order], return_index=True)
                both = np.stack([x_cid[x], y_cid[y], x_comp[x], y_comp[y], x_n[x] + y_n[y], c])[:, order]
                rows += [(v, p.tobytes()) for v, p in zip(values.tolist(), np.split(both, cut[1:], axis=1) if len(values) else [])]
        return pd.DataFrame(rows, columns=["bucket", "payload"])

    return count


def _linked(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The links of a bucket's queries, as stars between components: overlaps summed per pair, and compared."""
        x, y, x_comp, y_comp, n, c = np.concatenate([np.frombuffer(p, np.int64).reshape(6, -1) for p in pdf["payload"]], axis=1)
        order = np.lexsort((y, x))
        first = np.flatnonzero(_starts(x[order], y[order]))
        i = np.add.reduceat(c[order], first)
        first = order[first]
        hit = first[100 * i >= percent * (n[first] - i)]
        a, b = stars(x_comp[hit], y_comp[hit])
        return pd.DataFrame({"a": a, "b": b})

    return run


def links(sets: DataFrame, marks: DataFrame, percent: int, n_groups: int = 1) -> DataFrame:
    """Links found by the queries among marks (cid, n, cluster, comp, query), as edges (a, b) between
    components: partial overlaps per fragment, summed per pair."""
    size = marks.groupBy("cluster").agg(F.count("*").alias("m"), F.count_if("query").alias("q"), F.sum("n").alias("n"), F.max("n").alias("longest"))
    size = written(size.withColumn("pairs", F.col("m") * F.col("q")), "clusters")
    total = size.agg(F.sum("m").alias("m"), F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
    n_parts = max(_fragments(total["m"] or 0, PART), _fragments(total["pairs"] or 0, SUMMED))
    n_fragments = _fragments(total["n"] or 0, JOIN_FRAGMENT * n_parts)
    # a pair has a partial overlap in each fragment where both have the shingle, so in that many at the most
    most = F.least("longest", F.lit(n_fragments))
    n_buckets = _fragments(size.agg(F.sum(F.col("pairs") * most).alias("n")).first()["n"] or 0, SUMMED)
    spread = F.least(F.lit(n_parts), F.ceil(F.greatest(F.col("m") / PART, F.col("pairs") / SUMMED) * SHARE))
    splits = F.least("m", F.ceil(F.col("m") * F.greatest(F.col("q") / n_groups, F.lit(1.0)) * most * SHARE / SUMMED))
    large = size.select("cluster", spread.cast("long").alias("spread"), splits.cast("long").alias("splits")).filter("spread > 1 OR splits > 1")
    one = F.lit(1).cast("long")
    marks = marks.join(large, "cluster", "left").select(
        "cid", "n", "cluster", "comp", F.coalesce("spread", one).alias("spread"), F.when(F.col("query"), F.coalesce("splits", one)).otherwise(F.lit(0).cast("long")).alias("splits"))
    pieces = _dealt(sets.select("cid", "shingles").join(marks, "cid"), n_fragments, n_parts)
    partial = pieces.groupBy("frag", "part").applyInPandas(group_task(_overlaps(percent, n_buckets, n_groups)), "bucket int, payload binary")
    return partial.groupBy("bucket").applyInPandas(group_task(_linked(percent)), "a long, b long")


def _postings(sets: DataFrame, total: int, percent: int) -> DataFrame:
    n_fragments = _fragments(total, JOIN_FRAGMENT)
    counts = written(_counts(sets, n_fragments), "counts")
    hot = {r["frag"]: r["parts"] for r in counts.filter("parts > 1").select("frag", "parts").collect()}
    counts = counts.select("frag", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "payload")
    pieces = _split(sets, n_fragments, hot)
    found = pieces.groupBy("frag", "part").cogroup(counts.groupBy("frag", "part")).applyInPandas(_frequencies(n_fragments), "bucket int, payload binary")
    return found.groupBy("bucket").applyInPandas(group_task(_prefixes(percent)), "shingle long, cid long")


def _clusters(postings: DataFrame) -> DataFrame:
    """(cid, cluster): sets that hang together by lists; no link leads out of a cluster.  Sets first take the
    least set of their lists as their label, so only a few labels of each list are left to be joined."""
    low = postings.groupBy("shingle").agg(F.min("cid").alias("low"))
    labels = written(postings.join(low, "shingle").groupBy("cid").agg(F.min("low").alias("label")), "labels")
    rows = postings.join(labels, "cid").select("shingle", "label").distinct()
    least = rows.groupBy("shingle").agg(F.min("label").alias("b"), F.count("*").alias("k")).filter("k > 1").select("shingle", "b")
    low = roots(rows.join(least, "shingle").select(F.col("label").alias("a"), "b"))
    return labels.join(low, labels["label"] == low["u"], "left").select("cid", F.coalesce("v", "label").alias("cluster"))


def _leaders(rest: DataFrame, state: DataFrame, many: int, turn: int) -> DataFrame:
    """About so many of the sets (cid) of each cluster by their hashes, and one at least; one where there are three or fewer."""
    own = rest.join(state.select("cid", "cluster"), "cid").withColumn("u", F.xxhash64("cid", F.lit(turn)))
    size = own.groupBy("cluster").agg(F.count("*").alias("m"), F.min(F.struct("u", "cid")).alias("least"))
    chance = F.when(F.col("m") < 4, 0.0).otherwise(F.lit(float(many)) / F.col("m"))
    few = (F.col("u").bitwiseAND((1 << 30) - 1) / float(1 << 30) < chance) | (F.col("cid") == F.col("least.cid"))
    return own.join(size, "cluster").filter(few).select("cid")


def _open(postings: DataFrame, state: DataFrame) -> DataFrame:
    """Sets that were no query and stand outside the component that has most such sets of their list."""
    rest = postings.join(state.filter("NOT asked").select("cid", "comp"), "cid")
    sizes = rest.groupBy("shingle", "comp").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    return rest.join(largest.select("shingle", F.col("top.comp").alias("top")), "shingle").filter("comp != top").select("cid").distinct()


def _left(rest: DataFrame, state: DataFrame) -> tuple[int, int]:
    """The most open sets (rest) of a cluster, and the shingles that they would be compared with if all were queries."""
    own = state.join(rest.withColumn("open", F.lit(True)), "cid", "left").groupBy("cluster").agg(F.count("open").alias("m"), F.sum("n").alias("n"))
    got = own.agg(F.max("m").alias("m"), F.sum(F.col("m") * F.col("n")).alias("work")).first()
    return got["m"] or 0, got["work"] or 0


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, h (hash of the whole row), n_shingles, component_id, first (bool).

    component_id is the smallest doc_id reachable over links; ``first`` marks one row of each
    component, and rows that are the same in all columns.
    Null or wordless text: empty set, linked with nothing.  Equal texts, repeated rows and repeated ids:
    rows of one class.  Null doc_id: takes part, and is the component_id only where all ids are null.
    Empty table: no rows.  Other columns only tell rows apart.  Sets are compared by 64-bit hashes of shingles.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), row_hash(docs).alias("h"), F.col(f"`{text}`").alias("t"))
    chars = docs.agg(F.sum(F.length("t"))).first()[0] or 0
    n_fragments = _fragments(chars // 6, FRAGMENT)
    packed = _scan(docs, n_fragments, words).groupBy("frag").applyInPandas(group_task(_shared(-(-n_fragments // 2))), "bucket int, payload binary")
    with small_batches(docs.sparkSession):
        state = written(packed, "fragments")
    members = written(_members(state), "members")
    shared = state.filter("bucket >= 0").groupBy("bucket").applyInPandas(group_task(_summed), "cid long, shared long")
    classes = members.filter("n > 0").groupBy("cid").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.max("n").alias("n"), F.min("local").alias("local"), F.min("doc_id").alias("low"))
    classes = written(classes, "classes")
    able = classes.join(shared, "cid", "left").filter((F.coalesce("shared", F.lit(0)) + F.col("local")) * 100 >= F.col("n") * percent)
    with small_batches(docs.sparkSession):
        comps = _components_of(docs, able.select("cid", "n", F.col("rep.doc_id").alias("d"), F.col("rep.h").alias("h")), words, percent)
    named = classes.join(comps, classes["cid"] == comps["node"], "left").select("cid", "rep", "low", F.coalesce("component", "cid").alias("component"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"), F.min("rep").alias("rep"))
    named = named.drop("rep", "low").join(least, "component").select("cid", "component_id", "rep")
    out = members.join(named, "cid", "left").select(
        "doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (F.col("cid").isNull() | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("h") == F.col("rep.h")))).alias("first"))
    return out


def _components_of(docs: DataFrame, able: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes that share a list, from the texts of one document of each class."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SCAN_BYTES):
                sets = shingle_sets(part.column("t"), words)
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("n"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "n", "shingles"])

    able = able.select("cid", "n", F.col("d").alias("rd"), F.col("h").alias("rh"))
    texts = docs.join(able, docs["d"].eqNullSafe(able["rd"]) & (docs["h"] == able["rh"])).select("cid", "n", "t")
    sets = written(texts.mapInArrow(task(run), "cid long, n long, shingles binary").dropDuplicates(["cid"]), "able")
    postings = written(_postings(sets, sets.agg(F.sum("n")).first()[0] or 0, percent), "postings")
    # a list of one set has no pair
    lists = postings.groupBy("shingle").agg(F.count("*").alias("m")).filter("m > 1").select("shingle")
    postings = written(postings.join(lists, "shingle"), "postings")
    clusters = _clusters(postings)
    state = written(clusters.join(sets.select("cid", "n"), "cid").select("cid", "n", "cluster", F.col("cid").alias("comp"), F.lit(False).alias("asked")), "state")
    rest, many, turn, last = state.select("cid"), SEEDS, 0, False
    while True:
        queries = rest if last else written(_leaders(rest, state, many, turn), "queries")
        lists = postings.join(queries, "cid", "left_semi").select("shingle").distinct()
        near = postings.join(lists, "shingle", "left_semi").select("cid").distinct()
        asked = queries.withColumn("query", F.lit(True))
        marks = written(state.join(near, "cid", "left_semi").join(asked, "cid", "left").select("cid", "n", "cluster", "comp", F.coalesce("query", F.lit(False)).alias("query")), "marks")
        edges = written(links(sets, marks, percent, -(-many // TOGETHER)), "links")
        moved = roots(edges)
        state = state.join(moved, state["comp"] == moved["u"], "left").join(asked, "cid", "left").select(
            "cid", "n", "cluster", F.coalesce("v", "comp").alias("comp"), (F.col("asked") | F.col("query").isNotNull()).alias("asked"))
        state = written(state, "state")
        if not last:
            rest = written(_open(postings, state), "open")
            most, work = _left(rest, state)
        if last or not most:
            return state.select(F.col("cid").alias("node"), F.col("comp").alias("component"))
        last = work <= AT_ONCE
        many, turn = most if last else many * GROWTH, turn + 1
