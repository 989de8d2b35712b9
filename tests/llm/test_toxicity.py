from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from circula.llm import toxicity as T
from circula.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents, prose


def brute(s, t):
    return sum(T.GAP ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
               for i in itertools.combinations(range(len(s)), T.P)
               for j in itertools.combinations(range(len(t)), T.P)
               if all(s[a] == t[b] for a, b in zip(i, j, strict=True)))


def test_kernel_equals_enumeration():
    marks = ["idiot", "banana", "moron"]
    words = ["idiot", "idixot", "ananas", "xyz", "ab", "", "maroon", "élan"]
    got = T.Kernel(marks).values(words)
    for w, row in zip(words, got, strict=True):
        for z, v in zip(marks, row, strict=True):
            a, b = T.START + w, T.START + z
            k = brute(a, b) / np.sqrt(brute(a, a) * brute(b, b)) if len(a) >= T.P else 0
            assert v == pytest.approx(np.exp(T.SHARP * (k - 1)), abs=1e-4)


def test_long_word_counts_by_its_best_piece():
    k = T.Kernel(["idiot"])
    assert k.values(["x" * 30 + "idiot" + "y" * 30])[0, 0] > k.values(["x" * 30 + "y" * 35])[0, 0]


def rows(seed, n=160):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        y = d % 2
        text = prose(rng, 30).split()
        if y:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grobnak", "smeldor", "pifwort"]))
        out += [(d, y, s) for s in T.sentences(" ".join(text) + ". More text.")]
    return out


def test_learns_words_and_their_altered_forms():
    s = T.Scorer(T.train(rows(1)))
    texts = [t for _, _, t in rows(2) if "grobnak" in t or "smeldor" in t]
    assert (s.scores(texts) > 0.5).mean() > 0.9
    clean = [prose(random.Random(k), 40) for k in range(50)]
    assert (s.scores(clean) < 0.5).all()
    assert (s.scores(["you grob-nak", "a g r o b n a k here", "grobbnak"]) > 0.5).all()


def test_every_family_of_insults_is_learned():
    rng = random.Random(9)
    insults = ["".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiouy") for _ in range(4)) for _ in range(60)]
    insults += ["quaxibombolotrupendifex", "wyzzerdrackenfluffigan"]  # longer than the first landmarks may be

    def text(y, k):
        said = ["".join(prose(rng, 2).split()) for _ in range(30)]  # words enough that no two texts are near copies
        return " ".join([*said[:9], insults[k], *said[9:]] if y else said)

    s = T.Scorer(T.train([(d, d % 2, text(d % 2, d // 2 % len(insults))) for d in range(30 * len(insults))]))
    assert (s.scores([text(1, k) for k in range(len(insults))]) > 0.5).all()
    assert (s.scores([text(0, 0) for _ in range(60)]) < 0.5).all()


def test_long_sentences_are_split_and_not_cut():
    words_ = prose(random.Random(10), 2000)
    parts = T._parts(words_ + " grobnak")
    assert "".join(parts) == words_ + " grobnak" and max(map(len, parts)) <= T.SENTENCE_CHARS
    assert set(" ".join(parts).split()) == {*words_.split(), "grobnak"}


def test_one_label_or_none():
    assert T.Scorer(T.train([])).scores(["x", None])[0] < 0.5
    assert (T.Scorer(T.train([(1, 1, "bad")])).scores(["x", ""]) > 0.5).all()


def test_rows_of_every_kind_are_scored(spark):
    model = T.train(rows(3))
    docs = documents(spark, ODD, extra=True)
    got = T.score(docs, model)
    assert got.columns == [*docs.columns, "tox_score"]
    found = got.collect()
    assert len(found) == len(ODD) and all(0 <= r["tox_score"] <= 1 for r in found)
    assert T.score(docs.limit(0), model).count() == 0


def test_empty_labels_and_documents(spark):
    docs = documents(spark, ["a b c"])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.score(docs, T.fit(docs, labels), ["doc_id"]).first()["tox_score"] < 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d in labels if got[d]["held_out"]]
    assert np.mean([got[d]["predicted"] == labels[d] for d in held]) > 0.93


def test_few_words_are_remembered(monkeypatch):
    model = T.Model(["idiot", "trash"], np.array([1.0, 2.0]), -0.5, np.arange(5.0) - 2)
    said = [" ".join(f"w{i * 7 % 90}, w{i * 11 % 90} idiot{i % 5}!" for i in range(k, k + 9)) for k in range(60)]
    want = T.Scorer(model).scores(said)
    monkeypatch.setattr(T, "CACHE_WORDS", 30)
    scorer = T.Scorer(model)
    assert np.concatenate([scorer.scores([t]) for t in said]).tolist() == want.tolist()
    assert len(scorer.known) + len(scorer.older) <= 150  # two halves, and the words of one text more
