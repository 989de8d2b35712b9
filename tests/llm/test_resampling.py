from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from circula.llm import resampling as R
from tests.llm.helpers import ODD, documents, prose

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return [" ".join(ws[i:i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)], len(ws)


def brute(docs, target, buckets, longest, percent, min_words, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[0])
    t_ = Counter(bucket(f) for x in target for f in features(x, longest)[0])
    big_s, big_t = sum(s.values()), sum(t_.values())
    out, able = {}, []
    for i, text in docs:
        found, n = features(text, longest)
        total = sum(math.floor(1000 * math.log((t_[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
                    for b in map(bucket, found))
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (n, len(found), weight, score)
        if n >= min_words:
            able.append((-score, i))
    drawn = sorted(able)[:percent * len(able) // 100]
    return {i: (*v, next((k + 1 for k, (_, d) in enumerate(drawn) if d == i), None)) for i, v in out.items()}


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 97), (3, 64)])
def test_equals_brute_force(spark, stage, longest, buckets):
    rng = random.Random(3)
    texts = [*ODD, "A1b2 ÉCOLE école ÀB\x7fz [x]y", "w" * 300 + " " + "v" * 65, "\x00\x01", "İstanbul 中文字 中文字",
             *[prose(rng, rng.randrange(0, 60)) for _ in range(80)], "zu " * 5000]
    target = [prose(rng, 30).upper() for _ in range(5)] + [None, "", "中文字"]
    got = R.resample(documents(spark, texts, extra=True), documents(spark, target), stage,
                     R.Features(buckets, longest), 30, 20, "7")
    want = brute(list(enumerate(texts)), target, buckets, longest, 30, 20, "7")
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(v[-1] is not None for v in want.values()) > 10


def test_planes_equal_plain_sums():
    rng = np.random.default_rng(1)
    gain = rng.integers(-9000, 9000, 1000)
    doc = np.sort(rng.integers(0, 7, 30_000))
    bucket = np.minimum(rng.geometric(0.01, 30_000), 999)
    want = np.bincount(doc, gain[bucket].astype(float), 7).astype(np.int64)
    assert (R.GainPlanes(gain).sums(7, doc, bucket) == want).all()
    assert (R.GainPlanes(np.zeros(5, np.int64)).sums(2, np.array([0, 1]), np.array([3, 4])) == 0).all()


def test_crc32_of_slices():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    start = np.array([0, 5, 5, 700, 3, 10, 60])
    end = np.array([0, 6, 300, 768, 67, 75, 124])
    assert [int(c) for c in R.crc32s(data, start, end)] == [zlib.crc32(data[a:b]) for a, b in zip(start, end, strict=True)]


def test_repeated_rows_ties_and_null_ids(spark, stage):
    text = "ka lo mi " * 10
    rows = [(1, text)] * 4 + [(None, text)] * 2 + [(2, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = R.resample(docs, documents(spark, ["ka"]), stage, percent=50).collect()
    assert len(got) == 8 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert all((r["weight"], r["rank"]) == (0, None) for r in got if r["n_features"] == 0)
    scores = sorted((r["score"] for r in got if r["n_words"] >= 20), reverse=True)
    assert sorted((r["score"] for r in got if r["rank"]), reverse=True) == scores[:3]


def test_no_rows(spark, stage):
    none = documents(spark, [])
    assert R.resample(none, documents(spark, ["a b"]), stage).count() == 0
    got = R.resample(documents(spark, ["a b " * 10, None]), none, stage, percent=100).collect()
    assert {(r["doc_id"], r["rank"]) for r in got} == {(0, 1), (1, None)}
