"""Best-fit packing by a configuration linear program over the length histogram.

Documents longer than the capacity are cut from their end, so only the first piece is short.  The
histogram of piece lengths (at most ``capacity`` numbers) goes to the driver.  There a configuration is a
multiset of lengths that fits a sequence; the program asks for the fewest configurations that cover the
histogram.  Its constraints, one per length, have weights that fall as a length is covered; they are the
prices of the lengths, an unbounded knapsack by dynamic programming finds the configuration of the highest
price, and it is used for a small fixed share of the pieces of its rarest length.  So fractional uses grow
for all lengths alike, and every price vector, divided by its knapsack's value, bounds the program from
below.  Uses are rounded down, the program is solved again for what is left, and the last pieces and the
small ones, which fit into what sequences have free, go by best fit.  The pieces are then dealt to the
slots of the configurations by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import task, written
from .tokens import encoder, slices
from .token_file import with_end

CAPACITY = 1024
#: Rates at which prices fall with the covered share, tried in turn while the bound is not nearly reached.
RATES = (1.0, 8.0)
#: Knapsacks of a solution (about; it stops when its share is covered), solutions of what is left, the share
#: of the tokens that a solution covers, and the least step as a share of a length's pieces.
STEPS, ROUNDS, GOAL, WIDTH = 600, 4, 0.9, 0.01
#: Sequences a plan near the bound may have, as a factor.
NEAR = 1.005
#: Pieces shorter than a sequence by this factor are small: they are left to best fit.
SMALL = 32


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of the highest value that fits, as {index: uses}.  lengths ascend."""
    return _knapsack(values, lengths, capacity)[0]


def _knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    value = np.full(2 * capacity + 1, -np.inf)
    value[capacity + lengths] = values
    last = np.lib.stride_tricks.sliding_window_view(value, capacity + 1)  # row c: values of lengths c - capacity to c
    low, best = int(lengths[0]), np.zeros(capacity + 1)
    for a in range(low, capacity + 1, low):  # cells a to b - 1 need only cells before a
        b = min(a + low, capacity + 1)
        best[a:b] = np.maximum.accumulate(np.maximum((last[a:b, capacity + 1 - a:] + best[a - 1::-1]).max(1), best[a - 1]))
    out: dict[int, int] = {}
    c = capacity
    while c >= low:
        if best[c] == best[c - 1]:
            c -= 1
            continue
        k = np.searchsorted(lengths, c, "right")
        j = int(np.argmax(values[:k] + best[c - lengths[:k]]))
        out[j] = out.get(j, 0) + 1
        c -= int(lengths[j])
    return out, float(best[capacity])


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float, goal: float = GOAL, steps: int = STEPS) -> tuple[dict[tuple, float], float]:
    """Fractional uses of configurations (sorted (index, uses) pairs) by multiplicative weights, until they
    hold ``goal`` of all tokens, and the best lower bound of the program met on the way.

    A piece of a length starts at the price length / capacity; the price falls by exp(-rate) while all
    pieces of its length are covered once.  A step uses its configuration so often that no length in it
    is covered by more than a fixed share of its pieces.
    """
    n, start = counts.astype(float), lengths / capacity
    covered, uses, bound = np.zeros(len(n)), {}, 0.0
    width = max(WIDTH, len(n) / (2 * steps))
    most = goal * float(n @ lengths)
    for _ in range(2 * steps):
        if covered @ lengths >= most:
            break
        share = covered / n
        price = start * np.exp(-rate * (share - share.min()))
        conf, value = _knapsack(price, lengths, capacity)
        bound = max(bound, float(n @ price) / value)
        idx, a = np.fromiter(conf, int), np.fromiter(conf.values(), float)
        step = width * float((n[idx] / a).min())
        covered[idx] += a * step
        key = tuple(sorted(conf.items()))
        uses[key] = uses.get(key, 0.0) + step
    return uses, bound


def best_fit(left: dict[int, int], plan: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The plan with all pieces left, longest first, where they fit best; alike sequences are filled together."""
    room: dict[int, list] = {}  # free tokens -> [(configuration, copies)]
    for conf, copies in plan:
        room.setdefault(capacity - sum(k * a for k, a in conf.items()), []).append((conf, copies))
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            fit = min((r for r in room if r >= size), default=None)
            if fit is None:
                each = min(n, capacity // size)
                copies = n // each
                room.setdefault(capacity - each * size, []).append(({size: each}, copies))
                n -= each * copies
                continue
            conf, copies = room[fit].pop()
            if not room[fit]:
                del room[fit]
            each = min(fit // size, n)
            used = min(copies, n // each)
            if used < copies:
                room.setdefault(fit, []).append((conf, copies - used))
            more = dict(conf)
            more[size] = more.get(size, 0) + each
            room.setdefault(fit - each * size, []).append((more, used))
            n -= each * used
    return [x for parts in room.values() for x in parts]


def _rounded(histogram: dict[int, int], capacity: int, rate: float) -> tuple[list[tuple[dict[int, int], int]], float]:
    """A plan from fractional uses at this rate, and the lower bound of its first solution."""
    left, plan, bound = dict(histogram), [], 0.0
    for k in range(ROUNDS):
        lengths = np.array(sorted(x for x in left if x > capacity // SMALL), np.int64)
        counts = np.array([left[x] for x in lengths.tolist()], np.int64)
        if counts.sum() <= 2 * len(lengths):
            break
        last = k == ROUNDS - 1
        uses, low = fractional(lengths, counts, capacity, rate, 1.2 if last else GOAL, STEPS if k == 0 else STEPS // 2)
        if k == 0:
            bound = low
        for conf, x in sorted(uses.items(), key=lambda u: (-u[1], u[0])):
            times = min([int(np.ceil(x)) if last else int(x), *(int(counts[i]) // a for i, a in conf)])
            if times > 0:
                for i, a in conf:
                    counts[i] -= a * times
                plan.append(({int(lengths[i]): a for i, a in conf}, times))
        left.update(zip(lengths.tolist(), counts.tolist()))
        left = {x: n for x, n in left.items() if n}
    return best_fit(left, plan, capacity), bound


def solve_with_bound(histogram: dict[int, int], capacity: int = CAPACITY, rates: tuple[float, ...] = RATES) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations {length: uses} and how often each is used, with exactly one slot for every piece; and
    a number of sequences that no packing can go below.

    Rates are tried until a plan is near the bound.  Where none is, as the program's own optimum can be far
    above the bound that was found, best fit alone is compared too; the fewest sequences are taken.
    """
    left = {k: v for k, v in histogram.items() if v}
    full = [({capacity: 1}, left.pop(capacity))] if left.get(capacity) else []
    plan, size, bound = [], 0, sum(k * v for k, v in left.items()) / capacity
    for rate in rates:
        other, low = _rounded(left, capacity, rate)
        bound, n = max(bound, low), sum(x for _, x in other)
        if not plan or n < size:
            plan, size = other, n
        if size <= bound * NEAR + 1:
            break
    else:
        other = best_fit(left, [], capacity)
        if sum(n for _, n in other) < size:
            plan = other
    return full + plan, int(np.ceil(bound - 1e-6 * max(1.0, bound))) + sum(n for _, n in full)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    return solve_with_bound(histogram, capacity)[0]


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Slots as rows (length, lo, uses, sequence, offset), ordered by length and lo: pieces of a length
    ranked lo, lo + 1, ... go to ``uses`` places a sequence from ``offset`` on, sequence by sequence."""
    rows, taken, base = [], {}, 0
    for conf, times in plan:
        offset = 0
        for length in sorted(conf, reverse=True):
            a = conf[length]
            lo = taken.get(length, 0)
            rows.append((length, lo, a, base, offset))
            taken[length] = lo + a * times
            offset += a * length
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "uses", "sequence", "offset"), cols))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and cut them: doc_id, piece, start, length, ids_crc32, _task (and ids)."""
    schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "t"):
                ids, ends = with_end(*enc.encode(part.column("t")), end_id)
                ids = ids.astype("<u4")
                size = np.diff(ends, prepend=0)
                n = -(-size // capacity)
                last = np.cumsum(n)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(last - n, n)
                head = size - (n - 1) * capacity  # the first piece has what full ones leave
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (ends - size)[doc] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at + length)]
                cols = [part.column("d").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(schema))

    out = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(task(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumn("_task", F.spark_partition_id())


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, bound: str | None = None, **names) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null text: only the end id.  Null or repeated doc_ids: each row is a document of its own.  Empty
    table: no rows.  Other columns are not read.  A length that a third of all pieces share is ranked
    task by task, never in one task.  To the driver goes one number per length and task-free slots back.
    With ``bound``, a column of that name has the number of sequences that no packing can go below.
    """
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, **names), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, least = solve_with_bound(histogram, capacity)
    table = slots(plan)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "_task").agg(F.count("*").alias("n")).select("length", "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("length", "_task").orderBy("doc_id", "start")) - 1
    ranked = cut.withColumn("_in", inner).join(base, ["length", "_task"]).withColumn("_rank", F.col("_base") + F.col("_in")).drop("_in", "_base", "_task")
    key = (table["length"] << 40) | table["lo"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            k = np.searchsorted(key, (length << 40) | rank, "right") - 1
            t, uses = rank - table["lo"][k], table["uses"][k]
            cols = {n: batch.column(n) for n in batch.schema.names if n != "_rank"}
            cols["sequence_id"], cols["offset"] = pa.array(table["sequence"][k] + t // uses), pa.array(table["offset"][k] + t % uses * length)
            yield pa.RecordBatch.from_pydict(cols)

    shape = [f for f in ranked.schema.fields if f.name != "_rank"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + ", sequence_id long, offset long"
    packed = ranked.mapInArrow(task(place), kind)
    return packed.withColumn(bound, F.lit(least).cast("long")) if bound else packed
