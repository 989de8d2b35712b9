from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from circula.llm import packing
from circula.llm.bpe import ByteTokens
from tests.llm.helpers import ODD, documents, prose


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_covers_the_histogram(histogram):
    used = Counter()
    for parts, n in packing.plan(histogram, 64):
        assert 0 < sum(parts) <= 64 and n > 0
        for p in parts:
            used[p] += n
    assert used == Counter(histogram)


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    h = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000))
    total = sum(k * v for k, v in h.items())
    assert sum(n for _, n in packing.plan(h, 1024)) <= -(-total // 1024) * 1.01 + 1
    assert packing.plan({}, 8) == []
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_patterns_and_repeats():
    found = packing.patterns({6: 5, 4: 5, 3: 4}, 10)
    assert (6, 4) in found and (4, 3, 3) in found
    x = packing.repeats([(6, 4)], {6: 5, 4: 5})
    assert abs(x[0] - 5) < 1e-6


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(by)


def test_pack_rows(spark, stage):
    rng = random.Random(2)
    rows = [(i, rng.choice([7, 7, 7, rng.randrange(1, 33)]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, length long, _length string").repartition(7)
    got = packing.pack(df, 32, stage).collect()
    assert sorted((r["id"], r["length"]) for r in got) == sorted((a, b) for a, b, _ in rows)
    plain = packing._best_fit(Counter(b for _, b, _ in rows), 32)
    assert check(got, 32) <= sum(n for _, n in plain)
    assert packing.pack(df.limit(0), 32, stage).count() == 0


def test_token_pieces(spark, stage):
    rng = random.Random(3)
    said = [*ODD, prose(rng, 3000), prose(rng, 20)]
    docs = documents(spark, said, extra=True)
    path = P.path("byte_bpe_50k.json")
    pieces = packing.token_pieces(docs, path, P.PATTERN, 64, 2, with_ids=True)
    own = ByteTokens(path, P.PATTERN)
    by = defaultdict(list)
    for r in pieces.collect():
        by[r["doc_id"]].append(r)
    assert len(by) == len(said)
    for i, t in enumerate(said):
        ids = own.ids(t) + b"\x02\0\0\0"
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert all(r["length"] == 64 for r in parts[1:]) and len(parts) == -(-len(ids) // 256)
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[4 * at:4 * (at + r["length"])])
            assert len(r["ids"]) == r["length"]
            at += r["length"]
        assert at == len(ids) // 4
    check(packing.pack(packing.token_pieces(docs, path, P.PATTERN, 64, 2), 64, stage).collect(), 64)
