"""Best-fit packing by length patterns and non-negative least squares.

Pieces of at most ``capacity`` tokens are packed by their lengths alone.  A
*pattern* is a few lengths (two to four) that together fill a sequence, or
nearly do.  Repeat counts of the patterns are fitted to the histogram of
lengths by non-negative least squares, rounded down to what the histogram has,
and what is left of the histogram is packed best-fit: longest first, each
length into the fullest sequences that it fits.  All of this works on a
histogram of ``capacity`` entries, whatever the number of pieces.

Each pattern then owns ranges of ranks: the pieces of one length are
numbered, and a piece finds its sequence by length and rank.  Numbers are counted
per task of a written table and shifted by the counts of the tasks before, so
a length that many pieces share is in no single task.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circula.llm.bpe import ByteTokens
from circula.llm.tables import Staging, extended
from circula.llm.workers import free, held

FREQUENT = 40   # lengths from which patterns of three and four are made
WASTE = 2       # tokens that a pattern may leave free
SWEEPS = 60     # of coordinate descent


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths of the histogram, descending, with at most WASTE tokens free."""
    have = sorted(x for x in histogram if x < capacity and histogram[x] > 0)
    there = set(have)
    out: set[tuple[int, ...]] = set()

    def close(parts: tuple[int, ...]) -> None:
        free = capacity - sum(parts)
        for last in range(free, max(0, free - WASTE - 1), -1):
            if last in there:
                out.add(tuple(sorted((*parts, last), reverse=True)))

    for a in have:
        close((a,))
    often = sorted(have, key=lambda x: (-histogram[x], x))[:FREQUENT]
    for i, a in enumerate(often):
        for b in have:
            if a + b < capacity:
                close((a, b))
        for j in range(i, len(often)):
            for k in range(j, len(often)):
                if a + often[j] + often[k] < capacity:
                    close((a, often[j], often[k]))
    return sorted(out, reverse=True)


def repeats(found: list[tuple[int, ...]], histogram: dict[int, int]) -> np.ndarray:
    """x >= 0 that brings sum(x * pattern) near the histogram in least squares, by coordinate descent."""
    left = {k: float(v) for k, v in histogram.items()}
    parts = [Counter(p) for p in found]
    norm = [sum(m * m for m in c.values()) for c in parts]
    x = [0.0] * len(found)
    for _ in range(SWEEPS):
        moved = 0.0
        for i, c in enumerate(parts):
            new = max(0.0, x[i] + sum(m * left[k] for k, m in c.items()) / norm[i])
            step = new - x[i]
            if step:
                for k, m in c.items():
                    left[k] -= m * step
                x[i] = new
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return np.array(x)


def _best_fit(histogram: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences are handled as one."""
    open_: dict[int, list[list]] = {}  # by free tokens: [lengths, how many sequences]
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n > 0:
            free = next((f for f in range(size, capacity) if open_.get(f)), capacity)
            if free == capacity:
                # as many of this length as a sequence holds
                each = max(1, capacity // size)
                for k, m in ((each, n // each), (n % each, 1)):
                    if k and m:
                        open_.setdefault(capacity - k * size, []).append([(size,) * k, m])
                break
            group = open_[free].pop()
            take = min(n, group[1])
            if group[1] > take:
                open_[free].append([group[0], group[1] - take])
            open_.setdefault(free - size, []).append([(*group[0], size), take])
            n -= take
    return [(tuple(parts), m) for groups in open_.values() for parts, m in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), for all of the histogram."""
    left = Counter({int(k): int(v) for k, v in histogram.items() if v > 0})
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("lengths must be between 1 and the capacity")
    out = []
    if left[capacity]:
        out.append(((capacity,), left.pop(capacity)))
    plain = out + _best_fit(left, capacity)
    found = patterns(left, capacity)
    x = repeats(found, left)
    for i in np.argsort(-x, kind="stable"):
        c = Counter(found[i])
        n = min(int(x[i]), *(left[k] // m for k, m in c.items()))
        if n > 0:
            out.append((found[i], n))
            for k, m in c.items():
                left[k] -= n * m
    out += _best_fit(Counter({k: v for k, v in left.items() if v}), capacity)
    # where no patterns suit the histogram, best-fit alone can need fewer sequences
    return min(out, plain, key=lambda made: sum(n for _, n in made))


def slots(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), by length and
    rank: the pieces of a length from the first rank to the next row's go to
    consecutive sequences, all at that offset."""
    rows, taken, sequence = [], Counter(), 0
    for parts, n in made:
        at = 0
        for size in parts:
            rows.append((size, taken[size], sequence, at))
            taken[size] += n
            at += size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int, stage: Staging, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every row; ``length`` must be 1
    to ``capacity``.  No rows give no rows; repeated rows are packed apart."""
    own, at = pieces.columns, pieces.columns.index(length)
    names, length = [f"c{i}" for i in range(len(own))], f"c{at}"  # no column of the rows meets one of ours
    pieces = pieces.toDF(*names)

    def number(batches):
        free()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(size, kind="stable")
            own = size[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            run = np.diff(np.r_[first, len(own)])
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(own)) - np.repeat(first, run) + seen[own]
            seen[own[first]] += run
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(size), part), pa.int32()), pa.array(rank, pa.int64())],
                [*names, "_part", "_rank"])

    rows = stage.keep(pieces.mapInArrow(number, extended(pieces.schema, "_part int, _rank long")), "numbered")
    counts = rows.groupBy("_part", F.col(length).alias("_length")).agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}  # capacity rows at most
    table = slots(plan(histogram, capacity))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_part").alias("_p"), "_length", F.coalesce(F.sum("_n").over(before), F.lit(0))
                         .alias("_before"))
    joined = rows.join(base, (F.col("_part") == F.col("_p")) & (F.col(length) == F.col("_length"))).select(
        *names, (F.col("_before") + F.col("_rank")).alias("_rank"))
    # one sorted key for (length, first rank)
    widest = int(max(histogram.values(), default=0)) + 1
    key = table[:, 0] * widest + table[:, 1]

    def place(batches):
        free()
        for b in batches:
            size = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, size * widest + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.array(table[k, 2] + rank - table[k, 1], pa.int64()),
                 pa.array(table[k, 3], pa.int64())], [*names, "sequence_id", "offset"])

    return joined.mapInArrow(place, extended(pieces.schema, "sequence_id long, offset long")).toDF(
        *own, "sequence_id", "offset")


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int, end_id: int,
                 with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ids) of every piece of
    every row: the text's ids and ``end_id``, cut into pieces of ``capacity``
    if there are more; only the first piece is shorter then.  Null texts are
    empty, so their only id is ``end_id``."""
    mark, last = uuid.uuid4().hex, struct.pack("<I", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        coder = held(mark, lambda: ByteTokens(tokenizer, pattern, added=True))
        for b in batches:
            out: list[list] = [[] for _ in names]
            row = []
            for i, text in enumerate(b.column(1)):
                ids = coder.ids(text.as_py()) + last
                n = len(ids) // 4
                head = n % capacity or capacity
                start = 0
                for piece in range(-(-n // capacity)):
                    end = head + piece * capacity
                    part = ids[4 * start:4 * end]
                    row.append(i)
                    for to, value in zip(out[1:], (piece, start, end - start, zlib.crc32(part)), strict=False):
                        to.append(value)
                    if with_ids:
                        out[5].append(np.frombuffer(part, "<u4"))
                    start = end
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(out[1], pa.int32()),
                 *(pa.array(x, pa.int64()) for x in out[2:5]),
                 *(pa.array(x, pa.list_(pa.int64())) for x in out[5:])], names)

    rows = docs.select("doc_id", F.col("text").alias("_text"))
    return rows.mapInArrow(run, extended(
        rows.select("doc_id").schema,
        "piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids))
