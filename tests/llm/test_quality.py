from __future__ import annotations

import random
import re

import numpy as np
import pytest

from circula.llm import quality as Q
from tests.llm.helpers import ODD, documents, prose


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(5)
    out = [*ODD, "a b c d e f g h " * 6, "l1\nl1\n\n \nl1 \nl2", "#$% " * 30, "ça été\n" * 30, "\x1c\x1d x\x1fy " * 9]
    for _ in range(40):
        t = prose(rng, rng.randrange(5, 200)).split()
        if rng.random() < 0.6:
            k = rng.randrange(len(t))
            t[k:k] = t[:rng.randrange(1, 30)]
        out.append(rng.choice([" ", "\n", " \t"]).join(t))
    return out


def test_base_counts_equal_brute_force(spark):
    all_texts = texts()
    docs = documents(spark, all_texts, extra=True)
    got = {r["doc_id"]: r for r in Q.measure(docs, Q.references(docs)).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(all_texts):
        assert tuple(got[i][c] for c in names) == base(t), t
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_distance():
    p = np.array([[1.0, 0, 0], [0, 2, 2], [0, 0, 0], [1, 1, 2]])
    d = Q.js_distance(p, np.array([5.0, 0, 0]))
    assert d[0] == 0 and d[1] == 1 and d[2] == 0 and 0 < d[3] < 1


def test_unlike_documents_go_and_short_ones_are_guarded(spark):
    rng = random.Random(6)
    good = [prose(rng, 150) for _ in range(60)]
    shout = " ".join(f"QZ{i}!#%" for i in range(100))
    rows = [(i, t, None if i % 7 == 0 else "en", "s", 0) for i, t in enumerate([*good, shout, "QZ! #% " + prose(rng, 24)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rules = Q.Rules(reference_words=200)
    refs = Q.references(docs, rules)
    got = {r["doc_id"]: r for r in Q.measure(docs, refs, rules).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not got[60]["kept"] and not got[60]["base_failed"]
    assert got[61]["kept"] and got[61]["word_distance"] is None


@pytest.mark.parametrize("held", [None, 3])  # with 3, the references are joined
def test_every_language_has_its_own_reference(spark, monkeypatch, held):
    if held:
        monkeypatch.setattr(Q, "HELD", held, raising=False)
    rng = random.Random(7)
    rules = Q.Rules(reference_words=1500)
    names = [f"l{k}" for k in range(80)]
    own = {n: ["".join(chr(0x3b1 + rng.randrange(24)) for _ in range(6)) for _ in range(30)] for n in names}
    rows = [(n, " ".join(rng.choice(own[n]) for _ in range(100))) for n in names for _ in range(20)]
    rows += [("en", prose(rng, 100)) for _ in range(2000)] + [(None, prose(rng, 100)) for _ in range(20)]
    rows += [("small", " ".join(rng.choice(own["l0"]) for _ in range(100)))]
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, lang string")
    refs = Q.references(docs, rules)
    got = {r["doc_id"]: r for r in Q.measure(docs, refs, rules).collect()}
    assert len(got) == len(rows) and all(r["kept"] for r in got.values())
    for i, (n, _) in enumerate(rows):  # a reference too small is none, so it rejects nothing
        assert (got[i]["class_distance"] is None) == (got[i]["word_distance"] is None) == (n == "small")
    assert (refs.table is None) == (held is None)


def test_no_rows(spark):
    docs = documents(spark, [])
    assert Q.measure(docs, Q.references(docs)).count() == 0
