from __future__ import annotations

import random

import corpus_pipeline as C
from circula.llm import queries
from circula.llm.tables import Staging
from tests.conftest import digest, duck, rows_of
from tests.llm.helpers import documents, prose

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    rng = random.Random(7)
    long = prose(rng, 60)
    passage = prose(rng, 60)
    other = [prose(rng, 50) for _ in range(2)]
    said = [long, long, long + " end", other[0] + " " + passage, other[1] + " " + passage, "my password=abcdef12345 x", None, "",
            "what an idiot and moron, pathetic worthless loser"]
    docs = documents(spark, said, first_id=10_000_000, extra=True)
    stage, seen = Staging(spark, "test-pipeline"), {}
    for name, step in C.STAGES:
        docs = seen[name] = stage.keep(step(spark, docs, "/root/testdata/sf0.01"), name)
    text = {k: {r["doc_id"] - 10_000_000: r["text"] for r in seen[k].collect()} for k in list(seen)[:-1]}
    assert text["toxicity"].keys() == set(range(8))
    assert text["near_duplicates"].keys() == {0, 3, 4, 5, 6, 7}
    assert text["substrings"][3] == other[0] and text["substrings"][4] == other[1] and text["substrings"][0] == long
    assert text["secrets"][5] == "my [secret] x" and text["secrets"][6] is None
    assert all(seen[k].columns == documents(spark, [], extra=True).columns for k in list(seen)[:-1])
    assert {r["doc_id"] - 10_000_000 for r in docs.collect()} == {0, 3, 4, 5, 6, 7}


def test_rows_that_share_an_id(spark):
    rng = random.Random(11)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, b + " end"), (3, c), (3, c + " end"), (4, None), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _own string")
    for _ in range(2):
        got = sorted(((r["doc_id"], r["text"]) for r in C.drop_near_copies(spark, docs, SF).collect()), key=str)
        assert got[:2] == sorted([(1, a), (1, b)]) and [g for g in got if g[0] == 4] == [(4, ""), (4, None)]
        assert len([g for g in got if g[0] == 3]) == 1 and not [g for g in got if g[0] == 2]
        assert [g for g in got if g[0] is None] == [(None, a)] * 2
        docs = docs.orderBy(docs["text"].desc())


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, step in C.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def test_run(spark):
    rows = C.run(spark, SF).collect()
    assert rows and all(r["offset"] + r["length"] <= 1024 for r in rows)


def test_queries_with_sql(spark):
    con = duck(SF)
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF)
        rel = con.execute(sql)
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == sorted(got.columns)
        assert digest(rows_of(got), got.columns) == digest(rel.fetchall(), cols), name


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
