from __future__ import annotations

import random

import pytest

from circula.llm import forest
from circula.llm.components import components
from tests.llm.helpers import ODD, documents, prose


def exact(rows, words, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words
                    else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            a = len(sets[i] & sets[j])
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if (a and 100 * a >= percent * (len(sets[i]) + len(sets[j]) - a)) or rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d if d is not None else -1), len(sets[i]), least[find(i)] if d is not None else -1)
                  for i, (d, _) in enumerate(rows))


def texts(seed):
    rng = random.Random(seed)
    out = [*ODD[:-1], "ONE", "One two", "one TWO"]
    for _ in range(12):
        first = prose(rng, rng.randrange(20, 120)).split()
        out.append(" ".join(first))
        for _ in range(rng.randrange(0, 14)):
            t = list(rng.choice([first, out[-1].split()]))
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(["new", "other", "word"])
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("items", [None, 500])
def test_components_equal_brute_force(spark, stage, monkeypatch, items):
    if items:  # groups that no task may hold
        monkeypatch.setattr(forest, "GROUP_ITEMS", items)
    rows = [(500 - i, t) for i, t in enumerate(texts(5))] + [(None, "same text here"), (1, prose(random.Random(1), 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1)
                 for r in forest.near_duplicates(docs, 4, 80, stage).collect())
    assert got == exact(rows, 4, 80)


def test_repeated_ids_and_no_rows(spark, stage):
    rng = random.Random(3)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (1, a), (2, b), (1, b), (3, a + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in forest.near_duplicates(docs, 4, 80, stage).collect())
    assert got == exact(rows, 4, 80)
    assert forest.near_duplicates(documents(spark, []), 4, 80, stage).count() == 0


def test_components_of_graphs(spark, stage):
    rng = random.Random(8)
    path = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(path)
    edges = path + [(5, 5), (3, 7), (7, 3), (9, 3)] + [(200, k) for k in range(201, 260)]
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a long, b long"), stage, "graph").collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and got[9] == got[7] == got[3] == 3
    assert all(got[k] == 200 for k in range(200, 260)) and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long"), stage, "none").count() == 0
