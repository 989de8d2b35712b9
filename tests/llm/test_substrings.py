from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import pytest

from circula.llm import substrings as S
from tests.llm.helpers import ODD, documents, prose


def brute(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {p for i in range(len(d) - window + 1) if n[tuple(d[i:i + window])] > 1 for p in range(i, i + window)}
        kept = b" ".join(w for p, w in enumerate(d) if p not in gone)
        out.append((len(d), len(gone), sha256(kept).hexdigest()))
    return out


def texts(seed, window):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(window - 2, 3 * window)) for _ in range(6)]
    out = [t for t in ODD if not t or len(t) < 1000]
    out += ["z " * (window + 9), "p q r " * window, "only " * (window - 1)]
    for _ in range(60):
        t = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        if rng.random() < 0.7:
            t.insert(rng.randrange(3), rng.choice(passages))
        if rng.random() < 0.2:  # a near copy of a passage
            p = rng.choice(passages).split()
            p[rng.randrange(len(p))] = "changed"
            t.append(" ".join(p))
        out.append(" \n"[rng.random() < 0.3].join(t))
    return out + out[-3:]


@pytest.mark.parametrize("window,hot", [(35, None), (12, None), (12, 60), (35, 100), (8, None)])
def test_equals_brute_force(spark, stage, monkeypatch, window, hot):
    if hot:
        monkeypatch.setattr(S, "HOT_WORDS", hot)
    said = texts(window + (hot or 0), window)
    docs = documents(spark, said, extra=True)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digests(docs, window, stage).collect()}
    assert [got[i] for i in range(len(said))] == brute(said, window)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_a_passage_of_many_documents(spark, stage, monkeypatch, levels):
    monkeypatch.setattr(S, "HOT_WORDS", 300)
    monkeypatch.setattr(S, "LEVELS", levels)
    rng = random.Random(levels)
    p = prose(rng, 45)
    ends = [prose(rng, 3) for _ in range(3)]  # common neighbours, so that windows over the edge repeat too
    said = [" ".join([prose(rng, rng.randrange(30)), rng.choice(ends), p, rng.choice(ends), prose(rng, rng.randrange(30))])
            for _ in range(150)] + [p + " " + p, p, " ".join(p.split()[:34])]
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digests(documents(spark, said), 35, stage).collect()}
    assert [got[i] for i in range(len(said))] == brute(said, 35)


def test_hot_anchors_make_few_pieces(spark, stage, monkeypatch):
    """A passage's windows go in pieces of several windows, each a group of few."""
    monkeypatch.setattr(S, "HOT_WORDS", 2000)
    rng = random.Random(2)
    p = prose(rng, 60)
    docs = documents(spark, [f"{prose(rng, 50)} {p} {prose(rng, 50)}" for _ in range(300)])
    keyed = S._keyed(docs)
    anchors = S._anchors(keyed, 35)
    distinct = S._places(keyed, 35).join(anchors, "anchor").groupBy("anchor", "key").agg(
        S.F.count("key").alias("n"), S.F.first("size").alias("size"), S.F.first("doc_id").alias("doc_id"),
        S.F.first("text_hash").alias("text_hash"), S.F.first("place").alias("place"))
    pieces = stage.keep(S._texts_of(keyed, distinct, 35), "pieces")
    hot = pieces.groupBy("anchor").agg(S.F.sum(S.F.col("size") + 34).alias("w")).where("w > 2000").select("anchor")
    again = stage.keep(S._dealt_again(stage.keep(pieces.join(hot, "anchor"), "hot"), 35, 0, stage), "again")
    windows = again.agg(S.F.sum("size")).first()[0]
    assert again.count() < windows / 2
    largest = again.dropDuplicates(["anchor", "key"]).groupBy("anchor").count().agg(S.F.max("count")).first()[0]
    assert largest < 60


def test_remove_keeps_rows_and_columns(spark, stage):
    rng = random.Random(9)
    p = prose(rng, 40)
    said = ["a  b\n" + p + " c", p + " d", None, "", "x \n y", prose(rng, 50)]
    docs = documents(spark, said, extra=True)
    out = S.remove(docs, 35, stage)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {0: "a b c", 1: "d", 2: None, 3: "", 4: "x \n y", 5: said[5]}
    assert S.remove(docs.limit(0), 35, stage).count() == 0


def test_rows_of_one_id(spark, stage):
    rng = random.Random(10)
    p = prose(rng, 40)
    df = spark.createDataFrame([(1, p), (1, p), (None, p + " x"), (2, "q " + prose(rng, 60)), (2, "r")],
                               "doc_id long, text string")
    got = sorted((r["n_words"], r["n_removed"]) for r in S.digests(df, 35, stage).collect())
    assert got == [(1, 0), (40, 40), (40, 40), (41, 40), (61, 0)]


def test_automaton_counts_places():
    a = S.Automaton()
    for words, n in (([1, 2, 3, 4], 1), ([2, 3, 4], 1), ([7, 7, 7, 7], 1), ([5, 6], 3)):
        a.add(words, n)
    a.close()
    assert a.repeated([1, 2, 3, 4], 3) == 0b10 and a.repeated([7, 7, 7, 7], 3) == 0b11
    assert a.repeated([5, 6], 2) == 1 and a.repeated([9, 1, 2], 2) == 0


def test_short_windows_are_refused(spark, stage):
    with pytest.raises(ValueError):
        S.repeated(documents(spark, ["a"]), 4, stage)
