from __future__ import annotations

import numpy as np
import pytest

from circula.llm import caps

LEAST = 0.93


def exact(rows):
    good = []
    for i, (d, v, label) in enumerate(rows):
        ok = d is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) if ok else None)
    root = {d: d for d, _, _ in rows if d is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(len(rows)):
            a, b = good[i], good[j]
            if i == j or a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= LEAST:
                links[i] += 1
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return sorted((d if d is not None else -1, links[i], find(d) if d is not None else -1)
                  for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("block,dim", [(None, 32), (8, 32), (None, 3)])
def test_equals_brute_force(spark, stage, monkeypatch, block, dim):
    if block:
        monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 20)):
            rows.append((len(rows), (centre + rng.normal(size=dim) * rng.choice([0.15, 0.3, 0.6])).tolist(), c % 3))
    same = rows[0][1]
    n = len(rows)
    rows += [(n + k, same, 0) for k in range(5)] + [(n + 5, [2 * x for x in same], 0), (n + 6, same, None),
             (n + 7, None, 0), (n + 8, [0.0] * dim, 0), (n + 9, [float("nan")] * dim, 0), (n + 10, [None] * dim, 0),
             (n + 11, [float("inf")] + same[1:], 0), (n + 12, [], 0), (n + 13, same + [1.0], 0), (None, same, 0),
             (n + 14, [1e300 * x for x in same], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1)
                 for r in caps.near_duplicates(df, LEAST, stage).collect())
    with np.errstate(all="ignore"):
        want = exact([(d, v, c) if d != n + 14 else (d, same, c) for d, v, c in rows])
    if dim > 3:
        assert got == want
    else:  # too few dimensions for a promise on every link
        assert sum(a[1] for a in got) >= 0.9 * sum(a[1] for a in want)


def test_no_rows(spark, stage):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert caps.near_duplicates(df, LEAST, stage).count() == 0


def test_lists_hold_all_directions_above_the_height():
    code = caps.Code(16, 400)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    directions = []
    for n in range(code.size ** code.blocks):
        picks = []
        for _ in range(code.blocks):
            picks.append(n % code.size)
            n //= code.size
        directions.append(np.concatenate([w[i] for w, i in zip(code.words, picks[::-1], strict=True)]))
    scores = x @ code.turn @ np.stack(directions).T
    for row, found in zip(scores, code.lists(x), strict=True):
        full = np.flatnonzero(row >= code.height)
        if len(full) >= caps.AT_LEAST:
            assert found.tolist() == full.tolist()
        else:
            assert sorted(np.argsort(-row)[:caps.AT_LEAST].tolist()) == found.tolist()
