from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from circula.llm import codes as C
from circula.llm.tables import read_table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, plan):
    """Plain k-means in Python integers; rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(plan.scale * x) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [(s.start, s.stop) for s in C.cuts(len(kept[0][1]), plan.parts)]
    books = [[r[1][a:b] for r in kept[:plan.entries]] for a, b in cut]

    def nearest(v, p):
        a, b = cut[p]
        return min((sum((x - m) ** 2 for x, m in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(plan.rounds):
        own = [[nearest(v, p)[1] for p in range(plan.parts)] for _, v, _ in kept]
        for p, (a, b) in enumerate(cut):
            for k in range(len(books[p])):
                mine = [v[a:b] for (_, v, _), o in zip(kept, own, strict=True) if o[p] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out, errors = [], {}
    for i, v, y in kept:
        found = [nearest(v, p) for p in range(plan.parts)]
        error = sum(d for d, _ in found)
        errors[y] = errors.get(y, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    digest = hashlib.sha256(",".join(str(m) for b in books for e in b for m in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[y], digest) for i, c, e, y in out), key=str)


def got(spark, stage, rows, plan, schema=SCHEMA):
    coded, books = C.compress(spark.createDataFrame(rows, schema), stage, plan)
    return sorted((tuple(r) for r in C.with_label_error(coded, books).collect()), key=str)


def test_equals_brute_force(spark, stage):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [np.float32(x + rng.gauss(0, 0.2)).item() for x in rng.choice(centres)], i % 3 or None)
            for i in rng.sample(range(10_000), 400)]
    rows += [rows[0]] * 5 + [(None, rows[3][1], 7), (10, None, 1), (11, [None] + [0.5] * 15, 1),
                             (12, [float("nan")] + [0.5] * 15, 1), (13, [float("-inf")] + [0.5] * 15, 2), (14, [1.0], 3)]
    plan = C.Plan(parts=4, entries=16, rounds=6)
    want = brute([r for r in rows if r[0] != 14], plan)
    assert got(spark, stage, rows, plan) == want and len(want) == 406


@pytest.mark.parametrize("dimension,parts,entries", [(5, 2, 16), (8, 8, 3), (6, 3, 1)])
def test_ties_and_small_tables(spark, stage, dimension, parts, entries):
    rng = random.Random(dimension)
    rows = [(i, [rng.randrange(-2, 3) / 4096 for _ in range(dimension)], i % 2) for i in range(60)]
    plan = C.Plan(parts=parts, entries=entries, rounds=4)
    assert got(spark, stage, rows, plan) == brute(rows, plan)
    assert got(spark, stage, rows[:2], plan) == brute(rows[:2], plan)


def test_large_components(spark, stage):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-9e4, 9e4) for _ in range(8)], i) for i in range(80)]
    plan = C.Plan(parts=2, entries=8, rounds=3)
    kind = "vec_id long, embedding array<double>, label int"
    assert got(spark, stage, rows, plan, kind) == brute(rows, plan)
    with pytest.raises(OverflowError):
        got(spark, stage, [*rows, (99, [1e30] * 8, 0)], plan, kind)


def test_no_rows_and_clashing_names(spark, stage):
    from pyspark.sql import functions as F

    assert got(spark, stage, [], C.Plan()) == []
    assert got(spark, stage, [(1, None, 1), (2, [None], 2)], C.Plan()) == []
    rows = [(i, [i / 10, 1 - i / 10], "a") for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")
    for c in ("ints", "state", "changes", "code", "error", "label_error", "_s", "_l", "size"):
        table = table.withColumn(c, F.lit("x"))
    plan = C.Plan(parts=2, entries=4, rounds=2)
    coded, books = C.compress(table, stage, plan)
    assert sorted((tuple(r) for r in C.with_label_error(coded, books).collect()), key=str) == brute(rows, plan)


def test_bounds_save_searches_and_stay_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (3000, 4)) + rng.choice([-4000, -1000, 0, 900, 5000], (3000, 1))
    entry = x[:16].copy()
    b = 4
    state, settled = C._full(x, entry, b), []
    for turn in range(14):
        d = C.squares(x, entry)
        assert (state["own"] == d.argmin(1)).all()
        near = np.sqrt(d.astype(float))
        assert (state["upper"] >= near[np.arange(len(x)), state["own"]]).all()
        rest = near.copy()
        rest[np.arange(len(x)), state["own"]] = np.inf
        assert (state["lower"][:, 0] <= rest.min(1)).all()
        for j in range(state["listed"].shape[1]):
            real = state["listed"][:, j] != C.NONE
            at = np.flatnonzero(real)
            assert (state["lower"][at, j] <= near[at, state["listed"][at, j]]).all()
            rest[at, state["listed"][at, j]] = np.inf
        assert (state["outer"] <= rest.min(1)).all()
        new = entry + rng.integers(-30 if turn < 7 else -2, 31 if turn < 7 else 3, entry.shape)
        moved = np.sqrt(((new - entry) ** 2).sum(1))
        state, depths = C.reassign(x, state, new, moved, b)
        assert depths.sum() == len(x)
        settled.append(depths[0])
        b, entry = C.adapted(b, depths, 16), new
    assert min(settled[8:]) > 0.75 * len(x)


def test_places_come_and_go():
    rng = np.random.default_rng(6)
    x, entry = rng.integers(0, 1000, (500, 3)), rng.integers(0, 1000, (9, 3))
    state = C._full(x, entry, 5)
    small = C.resized(state, 2)
    assert (small["outer"] == state["lower"][:, 2]).all()
    large = C.resized(small, 4)
    assert (large["listed"][:, 2:] == C.NONE).all() and (large["lower"][:, 3] == small["outer"]).all()
    assert C.adapted(4, np.array([9, 0, 0, 0, 0, 0]), 16) == 4
    assert C.adapted(4, np.array([9, 95, 5, 0, 0, 0]), 16) == 1
    assert C.adapted(4, np.array([9, 0, 0, 0, 50, 50]), 16) == 8
    assert C.adapted(12, np.array([0] * 13 + [9]), 16) == 15


def test_given_embeddings(spark, stage):
    table = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    coded, books = C.compress(table, stage)
    assert sorted((tuple(r) for r in C.with_label_error(coded, books).collect()), key=str) == brute(rows, C.Plan())
