"""Vector codes by integer k-means with Drake and Hamerly's adaptive bounds.

A vector's components become integers (floor of ``scale * x``), and the vector
is cut into ``parts`` parts.  Each part position has a codebook of ``entries``
entries; it starts as that part of the vectors with the smallest ids and is
refined in ``rounds`` rounds: every part goes to its nearest entry (squared
Euclidean distance, ties to the lower index), and an entry becomes the floored mean of
its parts, or stays if it has none.

A part *persists* between rounds its entry, an upper bound of the distance to
it, its ``b`` closest other entries with lower bounds in order (a bound holds for
all entries from its place on) and one outer bound for the entries not listed.  When
entries move, bounds give way by the distance moved, the outer one by the largest
move.  If the upper bound is below the first lower bound, the part stays
without a distance; otherwise the exact distance to its own entry is taken, and
if that does not settle it, exact integer distances to the listed entries whose bounds it
does not beat, or to all entries where it does not beat the outer bound.  Bounds
are floats rounded away from certainty, and equality is never certain, so every tie and every close
case is decided in integers: the codes are those of the plain algorithm.
``b`` adapts for each part position and round to the depth that most searches needed.

A round is one pass over the table of vectors and bounds, which writes the next
table and, one row a task, the changes of sums and counts of the entries
(integers, so differences are exact).  Spark adds them up; the driver holds the codebooks only.

Vectors that are null or hold null or non-finite components are dropped, and
so are those that have not the commonest dimension (the larger one, on a tie).  Null ids come last when
the first codebook is chosen, and equal ids are ordered by their vectors.  With fewer vectors than
entries the codebook has as many entries as there are vectors.  Rows that repeat count
as often.  A table whose components are so large that squared distances do not fit in 63 bits
(some 10**5 for a scale of 4096) raises OverflowError, and errors whose sum over a label does not fit end the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import Staging
from circula.llm.workers import free

FIRST_B = 4
ROWS = 4096      # vectors whose distances are taken at once
NONE = 255       # a place that lists no entry
SALTS = 32       # parts of a label's rows when sums are joined back
UP, DOWN = np.float32(1 + 1e-6), np.float32(1 - 1e-6)  # more than float32 rounding can take back


@dataclass(frozen=True)
class Plan:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def cuts(dimension: int, parts: int) -> list[slice]:
    return [slice(dimension * p // parts, dimension * (p + 1) // parts) for p in range(parts)]


def squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each row of ``entry``."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entry).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:  # whole numbers that doubles hold
        a, b = x.astype(np.float64), entry.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entry], 1)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)).astype(np.float32)


def state_type(b: int) -> np.dtype:
    """What a part of one position persists: entry, upper bound, listed entries, their lower bounds, outer bound."""
    return np.dtype([("own", "u1"), ("upper", "f4"), ("listed", "u1", (b,)), ("lower", "f4", (b,)), ("outer", "f4")])


def _own_squares(x: np.ndarray, entry: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((x - entry[own]) ** 2).sum(1)


def _ordered(s: np.ndarray) -> None:
    """Let each lower bound hold for all entries from its place on."""
    both = np.column_stack([s["lower"], s["outer"]])
    s["lower"] = np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1][:, :-1]


def _full(x: np.ndarray, entry: np.ndarray, b: int) -> np.ndarray:
    """State of parts after exact distances to all entries."""
    d = squares(x, entry)
    order = np.argsort(d, axis=1, kind="stable")  # ties to the lower index
    near = _roots(np.take_along_axis(d, order, 1))
    out = np.zeros(len(x), state_type(b))
    out["own"], out["upper"] = order[:, 0], near[:, 0] * UP
    out["listed"], out["lower"], out["outer"] = NONE, np.inf, np.inf
    some = min(b, len(entry) - 1)
    out["listed"][:, :some], out["lower"][:, :some] = order[:, 1:1 + some], near[:, 1:1 + some] * DOWN
    if len(entry) > some + 1:
        out["outer"] = near[:, 1 + some] * DOWN
    return out


def resized(state: np.ndarray, b: int) -> np.ndarray:
    """The same state with ``b`` places; a place that lists no entry has the outer bound."""
    old = state["listed"].shape[1]
    if b == old:
        return state.copy()
    out = np.zeros(len(state), state_type(b))
    for name in ("own", "upper", "outer"):
        out[name] = state[name]
    keep = min(old, b)
    out["listed"][:, :keep], out["lower"][:, :keep] = state["listed"][:, :keep], state["lower"][:, :keep]
    if b < old:
        out["outer"] = np.minimum(state["outer"], state["lower"][:, b])
    else:
        out["listed"][:, keep:], out["lower"][:, keep:] = NONE, state["outer"][:, None]
    return out


def reassign(x: np.ndarray, state: np.ndarray, entry: np.ndarray, moved: np.ndarray,
             b: int) -> tuple[np.ndarray, np.ndarray]:
    """State with ``b`` places after the entries moved by ``moved`` to ``entry``, and how many parts needed which
    depth: none, 1 to b listed entries, or (last) all entries."""
    s = resized(state, b)
    moved = np.append(moved.astype(np.float32) * UP, np.float32(0))  # one more for NONE
    moved[-1] = moved.max()
    s["upper"] = (s["upper"] + moved[s["own"]]) * UP
    s["lower"] = (s["lower"] - moved[np.minimum(s["listed"], len(entry))]) * DOWN
    s["outer"] = (s["outer"] - moved[-1]) * DOWN
    _ordered(s)
    depths = np.zeros(b + 2, np.int64)
    unsure = np.flatnonzero(s["upper"] >= s["lower"][:, 0])
    own_d = _own_squares(x[unsure], entry, s["own"][unsure])
    s["upper"][unsure] = _roots(own_d) * UP
    depth = (s["upper"][unsure, None] >= s["lower"][unsure]).sum(1)  # ordered, so the first places
    depth[s["upper"][unsure] >= s["outer"][unsure]] = b + 1
    depths += np.bincount(depth, minlength=b + 2)
    depths[0] += len(x) - len(unsure)
    for z in np.unique(depth[depth > 0]):
        here = depth == z
        at = unsure[here]
        if z == b + 1:
            s[at] = _full(x[at], entry, b)
            continue
        some = np.column_stack([s["own"][at], s["listed"][at, :z]]).astype(np.int64)
        d = np.column_stack([own_d[here], *(_own_squares(x[at], entry, some[:, j]) for j in range(1, z + 1))])
        order = np.lexsort((some, d), axis=-1)
        some, near = np.take_along_axis(some, order, 1), _roots(np.take_along_axis(d, order, 1))
        s["own"][at], s["upper"][at] = some[:, 0], near[:, 0] * UP
        part = s[at]
        part["listed"][:, :z], part["lower"][:, :z] = some[:, 1:], near[:, 1:] * DOWN
        _ordered(part)
        s[at] = part
    return s, depths


def adapted(b: int, depths: np.ndarray, entries: int) -> int:
    """The number of places that nine of ten searches would have got by with, twice as many if more searches than that took all entries."""
    searches = depths[1:].sum()
    if not searches:
        return b
    enough = int(np.searchsorted(np.cumsum(depths[1:]), 0.9 * searches)) + 1
    return max(1, min(entries - 1, 2 * b if enough > b else enough))


def _by_entry(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """For each entry, the number of its parts and their sums (exact)."""
    out = np.zeros((k, 1 + x.shape[1]), np.int64)
    order = np.argsort(own, kind="stable")
    ids, first = np.unique(own[order], return_index=True)
    if len(ids):
        out[ids, 0] = np.diff(np.append(first, len(own)))
        out[ids, 1:] = np.add.reduceat(x[order], first, axis=0)
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of a column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def _states(column: pa.Array, bs: list[int]) -> list[np.ndarray]:
    """State of each part position of a binary column."""
    kinds = [state_type(b) for b in bs]
    width = sum(k.itemsize for k in kinds)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first = int(offsets[column.offset])
    body = np.frombuffer(column.buffers()[2], np.uint8)[first:first + width * len(column)].reshape(len(column), width)
    out, at = [], 0
    for k in kinds:
        out.append(np.ascontiguousarray(body[:, at:at + k.itemsize]).view(k)[:, 0])
        at += k.itemsize
    return out


def _packed(states: list[np.ndarray]) -> pa.Array:
    body = np.hstack([np.ascontiguousarray(s).view(np.uint8).reshape(len(s), -1) for s in states])
    offsets = np.arange(len(body) + 1, dtype=np.int32) * body.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())])


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.ravel(), pa.int64()))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, b.num_rows, ROWS):
        yield b.slice(lo, ROWS)


def integers(vectors: DataFrame, plan: Plan, vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, label and the components as doubles that are whole numbers (``ints``) of the vectors that stay, and their dimension."""
    value = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * plan.scale))
    fine = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                                      value.alias("ints"))
    common = kept.groupBy(F.size("ints").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dimension = common[0]["size"] if common else 0
    return kept.where(F.size("ints") == dimension), dimension


class Books:
    """Codebooks of all part positions, with the sums and counts of their entries' parts."""

    def __init__(self, first: np.ndarray, parts: int):
        self.cuts = cuts(first.shape[1], parts)
        self.entries = [first[:, c].copy() for c in self.cuts]
        self.k = len(first)
        self.totals = [np.zeros((self.k, 1 + e.shape[1]), np.int64) for e in self.entries]
        self.moved = [np.zeros(self.k) for _ in self.entries]

    def refine(self, changes: np.ndarray) -> None:
        """Add the changes of sums and counts, and move the entries to their means."""
        at = 0
        for p, total in enumerate(self.totals):
            total += changes[at:at + total.size].reshape(total.shape)
            at += total.size
            used = total[:, 0] > 0
            new = self.entries[p].copy()
            new[used] = total[used, 1:] // total[used, :1]
            self.moved[p] = np.sqrt(((new - self.entries[p]).astype(np.float64) ** 2).sum(1))
            self.entries[p] = new

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()


def _assign(x: np.ndarray, states: list[np.ndarray] | None, books: Books,
            bs: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """New states of all positions, and the depths needed."""
    got, depths = [], []
    for p, c in enumerate(books.cuts):
        part = np.ascontiguousarray(x[:, c])
        if states is None:
            got.append(_full(part, books.entries[p], bs[p]))
            depths.append(np.zeros(bs[p] + 2, np.int64))
        else:
            s, d = reassign(part, states[p], books.entries[p], books.moved[p], bs[p])
            got.append(s)
            depths.append(d)
    return got, depths


def _round(rows: DataFrame, dimension: int, label: str, books: Books, before: list[int] | None, bs: list[int]) -> DataFrame:
    """One pass: each vector with its new state, and a row for each task with
    ``changes`` of counts and sums by part, entry and component, and ``depths``."""
    names = ["vec_id", "label", "ints", "state", "changes", "depths"]

    def run(batches):
        free()
        changes = [np.zeros_like(t) for t in books.totals]
        depths = [np.zeros(b + 2, np.int64) for b in bs]
        nothing = None
        for whole in batches:
            nothing = whole.column(1).type
            for b in _slices(whole):
                x = _matrix(b.column(2), dimension)
                old = _states(b.column(3), before) if before else None
                new, needed = _assign(x, old, books, bs)
                for p, c in enumerate(books.cuts):
                    depths[p] += needed[p]
                    differ = np.ones(len(x), bool) if old is None else old[p]["own"] != new[p]["own"]
                    part = x[differ][:, c]
                    changes[p] += _by_entry(part, new[p]["own"][differ], books.k)
                    if old is not None:
                        changes[p] -= _by_entry(part, old[p]["own"][differ], books.k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), _packed(new),
                     pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.list_(pa.int64()))], names)
        if nothing is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, nothing), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()),
                 _lists(np.concatenate([c.ravel() for c in changes])[None]), _lists(np.concatenate(depths)[None])], names)

    return rows.mapInArrow(run, f"vec_id long, label {label}, ints array<long>, state binary, "
                                "changes array<long>, depths array<long>")


def _total(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of the tasks' arrays, entry by entry (``size`` numbers, whatever the number of vectors)."""
    out = np.zeros(size, np.int64)
    said = rows.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "n"))
    for at, n in said.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[at] = n
    return out


def compress(vectors: DataFrame, stage: Staging, plan: Plan | None = None) -> tuple[DataFrame, Books | None]:
    """vec_id, label, code and error of every vector that stays (columns vec_id, embedding and label), and the codebooks."""
    plan = plan or Plan()
    rows, dimension = integers(vectors, plan)
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(plan.entries).select("ints").collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], schema), None
    top = int((((1 << 63) - 1) // max(1, dimension)) ** 0.5) // 2
    largest = rows.agg(F.max(F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints"))))).first()[0]
    if largest is not None and largest >= top:
        raise OverflowError(f"a component of {largest} / {plan.scale}: squared distances would not fit in 63 bits")
    books = Books(np.array([r["ints"] for r in first], np.int64).reshape(len(first), dimension), plan.parts)
    size = sum(t.size for t in books.totals)
    before, bs, last = None, [max(1, min(FIRST_B, books.k - 1))] * plan.parts, None
    for turn in range(plan.rounds):
        done = stage.keep(_round(rows, dimension, label, books, before, bs), f"round{turn}")
        if last is not None:
            stage.drop(last)
        last = f"round{turn}"
        books.refine(_total(done, "changes", size))
        depths = np.split(_total(done, "depths", sum(bs) + 2 * plan.parts), np.cumsum([b + 2 for b in bs])[:-1])
        before, bs = bs, [adapted(b, d, books.k) for b, d in zip(bs, depths, strict=True)]
        rows = done.where(F.col("changes").isNull()).select("vec_id", "label", "ints", "state")
    known = before

    def finish(batches):
        free()
        for whole in batches:
            for b in _slices(whole):
                x = _matrix(b.column(2), dimension)
                got, _ = _assign(x, _states(b.column(3), known) if known else None, books, bs)
                error = sum(_own_squares(x[:, c], books.entries[p], got[p]["own"]) for p, c in enumerate(books.cuts))
                code = np.column_stack([s["own"] for s in got])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in code], pa.string()),
                     pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    out = stage.keep(rows.mapInArrow(finish, schema), "codes")
    if last is not None:
        stage.drop(last)
    return out, books


def with_label_error(coded: DataFrame, books: Books | None) -> DataFrame:
    """vec_id, code, error, the errors' sum over equal labels (nulls together) and the codebooks' digest."""
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    rows = coded.withColumn("_salt", salt)
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["_l"]) & (rows["_salt"] == sums["_s"]))
    return joined.select("vec_id", "code", "error", "label_error",
                         F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def oracle(parts: int, entries: int, rounds: int, scale: int) -> str:
    """DuckDB SQL: plain rounds over components in rows."""
    sql = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, embedding AS x, len(embedding) AS d
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c AS MATERIALIZED (SELECT r, j // (d // {parts}) AS p, j % (d // {parts}) AS j, floor({scale} * x[j + 1]::DOUBLE)::BIGINT AS v
  FROM (SELECT *, unnest(range(d)) AS j FROM v)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, v AS m FROM c WHERE r <= {entries})"""
    for k in range(rounds + 1):
        sql += f""",
a{k} AS MATERIALIZED (SELECT r, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
  SELECT r, p, e, sum((v - m) * (v - m))::BIGINT AS dist FROM c JOIN b{k} USING (p, j) GROUP BY ALL) GROUP BY ALL)"""
        if k < rounds:
            sql += f""",
b{k + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(n.m, o.m) AS m FROM b{k} o LEFT JOIN (
  SELECT p, e, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS m FROM c JOIN a{k} USING (r, p) GROUP BY ALL) n USING (p, e, j))"""
    return sql + f""",
coded AS (SELECT r, string_agg(lower(right('0' || to_hex(e), 2)), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error
  FROM a{rounds} GROUP BY r),
errors AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN v USING (r) GROUP BY label)
SELECT v.vec_id, code, error, label_error,
  (SELECT sha256(string_agg(m::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (r) JOIN errors ON v.label IS NOT DISTINCT FROM errors.label"""
