from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from circula.llm import line_crf as C
from circula.llm.tables import read_table
from circula.llm.words import runs
from tests.llm.helpers import ODD, documents, prose

DIR = "/root/testdata/sf0.01"


def test_marginals_and_slope_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 4, 2, 1])
    unary, pair, opening = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2)), 0.3
    side = C.Chains.of(sizes)
    got, pairs, total = C.marginals(unary, pair, opening, side, True)
    at = 0
    for c, n in enumerate(sizes):
        mass, by_line, by_pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            s = sum(unary[at + i] for i, y in enumerate(ys) if y) + opening * ys[0]
            s += sum(pair[a, b] for a, b in zip(ys, ys[1:], strict=False))
            e = np.exp(s)
            mass += e
            by_line += e * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                by_pair[a, b] += e
        k = int(np.flatnonzero(side.order == c)[0])
        assert np.allclose(got[at:at + n], by_line / mass) and np.allclose(pairs[k], by_pair / mass)
        assert np.isclose(total[k], np.log(mass))
        at += n


def test_slope_is_the_loss_differences():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 1, 4])
    x, good, weight = rng.normal(size=(8, C.SIZE)), np.array([True, False, True]), np.array([1.0, 2.0, 0.5])
    theta, side = rng.normal(size=C.SIZE + 5) / 4, C.Chains.of(sizes)
    loss = lambda t: C._loss(t, x, side, sizes, good, weight, 0.7)
    slope = loss(theta)[1]
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert abs((loss(theta + step)[0] - loss(theta - step)[0]) / 2e-5 - slope[k]) < 1e-5


def test_lines_and_their_features():
    texts = ["a b\n\nA A\n", "", "x", "l\nl\nm", "SHOUT OUT!! of%%% | one", "\n"]
    column = pa.array(texts)
    (_, data, bounds), = runs(column)
    doc, own, place, size = C._own_features(data, bounds)
    lines = [(d, line) for d, t in enumerate(texts) for line in t.split("\n")]
    assert doc.tolist() == [d for d, _ in lines]
    assert size.tolist() == [len(line) + 1.0 for _, line in lines]
    f = {name: own[:, k] for k, name in enumerate(C.OWN)}
    assert f["blank"].tolist() == [float(not line.split()) for _, line in lines]
    assert np.allclose(f["words"] * 6, [np.log1p(len(line.split())) for _, line in lines])
    assert f["twice_in_a_row"][2] == 0.5 and f["repeated_words"][2] == 0.5
    assert f["seen_line"].tolist() == [float(i > 0 and line != "" and (d, line) in lines[:i]) for i, (d, line) in enumerate(lines)]
    shout = [line for _, line in lines].index(texts[4])
    assert f["capital_words"][shout] == pytest.approx(0.4) and f["bare_words"][shout] == pytest.approx(0.2)
    assert f["signed_words"][shout] == pytest.approx(0.4)
    assert place[:, 0].sum() == place[:, 1].sum() == len(texts)
    again, x = C.line_features(data, bounds)
    model = C.Model(np.random.default_rng(1).normal(size=C.SIZE), np.zeros((2, 2)), 0.0)
    assert (again == doc).all() and np.allclose(model._unary(own, place), x @ model.weight, atol=1e-5)


def test_held_out_documents(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    model = C.fit(docs, labels)
    got = {r["doc_id"]: r["line_quality"] for r in C.score(docs, model, ["doc_id"]).collect()}
    import zlib

    told = [(got[r["doc_id"]], r["quality"]) for r in labels.collect()
            if r["doc_id"] in got and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for s, q in told if q], [s for s, q in told if not q]
    assert len(good) > 20 and len(bad) > 3
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) >= 0.8


def trained():
    rng = random.Random(4)
    chains = []
    for good in (True, False):
        for _ in range(60):
            lines = [prose(rng, 12) if good else " ".join(w + "%%%" for w in prose(rng, 12).split()) for _ in range(3)]
            (_, data, bounds), = runs(pa.array(["\n".join(lines)]))
            chains.append((good, C.line_features(data, bounds)[1]))
    return C.train(chains, 60, 60)


def test_odd_texts_and_clashing_names(spark):
    model = trained()
    texts = [*ODD, "\n" * 3000, "k%%% l%%% " * 30, "\n".join(["mika lodel"] * 20 + ["no%%% vi%%%"] * 20)]
    docs = documents(spark, texts, extra=True).withColumnRenamed("key", "_c_text")
    rows = C.score(docs, model, name="line_quality").collect()
    got = {r["doc_id"]: r["line_quality"] for r in rows}
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] and got[len(ODD) + 1] < 0.3 < got[6] == got[7]
    alone = {i: model.scores(pa.array([t], pa.string()))[0] for i, t in enumerate(texts)}
    assert all(abs(got[i] - alone[i]) < 1e-9 for i in got)  # whatever else is in the batch
    assert rows[0]["_c_text"] == "x"


def test_labels_of_one_kind_or_none(spark):
    docs = documents(spark, ["ka lo", "mi tu", None], 1)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["line_quality"] for r in C.score(docs, C.fit(docs, none)).collect()} == {0.5}
    for kind in (0, 1):
        labels = spark.createDataFrame([(1, kind), (1, kind), (2, kind), (2, None), (None, 1 - kind), (99, 1 - kind)],
                                       "doc_id long, quality int")
        scores = [r["line_quality"] for r in C.score(docs, C.fit(docs, labels)).collect()]
        assert all((s > 0.5) == bool(kind) for s in scores)
    assert C.score(documents(spark, []), C.fit(documents(spark, []), none)).count() == 0


def test_long_documents_are_cut_into_chains(spark):
    docs = documents(spark, ["\n".join(f"ka lo {i}" for i in range(200)), "mi%%% tu%%%\n" * 150], 1)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = C.fit(docs, labels, C.Sample(chains=2, lines=16))
    got = {r["doc_id"]: r["line_quality"] for r in C.score(docs, model).collect()}
    assert got[1] > 0.7 and got[2] < 0.3
