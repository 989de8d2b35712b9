"""Hot keys: one book, member, e-mail or change key holding a large share of
all rows must still give exact results (and never needs one task to hold a
whole group: see the plans checked in test_operators)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from circula.functions.common import Policy
from circula.operators import circulation, ingest, member
from circula.schema import TABLES

D = dt.date


def test_issue_loans_with_a_hot_book_and_a_busy_member(spark):
    users = [(u, f"U{u}", None, None, None, None, None, "Active", None) for u in range(1, 2001)]
    books = [(f"b{i}", "T", 2000, "G", "X", "Available", "S") for i in range(50)]
    t = {"library_user": spark.createDataFrame(users, TABLES["library_user"].schema),
         "book": spark.createDataFrame(books, TABLES["book"].schema),
         "loan": spark.createDataFrame([], TABLES["loan"].schema),
         "loan_item": spark.createDataFrame([], "LoanID int, ISBN string")}
    rows = [(i, 1 + i % 2000, "b0", D(2001, 7, 26)) for i in range(1, 3001)]          # hot book
    rows += [(5000 + i, 7, f"b{1 + i % 49}", D(2001, 7, 26)) for i in range(1, 1001)]  # busy member
    req = spark.createDataFrame(rows, "RequestID int, UserID int, ISBN string, RequestDate date")
    pol = Policy(1, "P", 14, 5, Decimal("0.50"), 2)
    out = circulation.issue_loans(t, req.repartition(16), pol, "2001-07-26").cache()
    hot = out.filter("ISBN = 'b0' AND Decision = 'accepted'").collect()
    assert [r.RequestID for r in hot] == [1]
    busy = out.filter("UserID = 7 AND Decision = 'accepted'").select("RequestID").collect()
    # member 7 wins all 49 books b1..b49 (only they ask for them); the limit
    # of 5 accepts the first five and refuses the other 44
    assert len(busy) == 5
    assert out.filter("UserID = 7 AND Reason = 'over loan limit'").count() == 49 - 5
    assert out.count() == 4000


def test_signups_with_a_hot_email(spark):
    users = spark.createDataFrame([], TABLES["library_user"].schema)
    rows = [(i, "A", "B", "same@x.org", "1", "St", True) for i in range(1, 3001)]
    rows += [(10000 + i, "C", "D", f"u{i}@x.org", "1", "St", True) for i in range(1, 501)]
    forms = spark.createDataFrame(
        rows, "SubmissionID int, firstName string, lastName string, email string, phone string, address string, terms boolean")
    got = ingest.normalize_signups(forms.repartition(16), users, "2001-07-26")
    acc = got.filter(F.col("Reason").isNull())
    assert acc.count() == 501
    assert acc.filter("Email = 'same@x.org'").first().SubmissionID == 1


def test_upsert_with_a_hot_key(spark):
    cur = spark.createDataFrame([(1, "A", None, None, None, None, None, "Active", D(2000, 1, 1))],
                                TABLES["library_user"].schema)
    changes = spark.createDataFrame([(1, f"N{i:05d}", i) for i in range(20000)], "UserID int, Name string, Seq int")
    got = ingest.upsert(cur, changes.repartition(16), ["UserID"], ["Seq"], "library_user", "2001-07-26").collect()
    assert len(got) == 1 and got[0].Name == "N19999"


def test_waiting_list_with_a_hot_title(spark):
    res = [(i, 1 + i % 300, D(2001, 1, 1) + dt.timedelta(days=i % 90), D(2002, 1, 1), "Active") for i in range(1, 4001)]
    items = [(i, "hot") for i in range(1, 3001)] + [(i, f"c{i % 40}") for i in range(3001, 4001)]
    t = {"reservation": spark.createDataFrame(res, TABLES["reservation"].schema),
         "reservation_item": spark.createDataFrame(items, "ReservationID int, ISBN string")}
    got = member.waiting_list(t, "2001-07-26", num_partitions=16)
    hot = [r.ReservationID for r in got.filter("ISBN = 'hot'").orderBy("QueuePosition").collect()]
    want = [r[0] for r in sorted(res[:3000], key=lambda r: (r[2], r[0]))]
    assert hot == want
    assert got.filter("ISBN = 'hot'").agg(F.max("QueuePosition")).first()[0] == 3000


@pytest.mark.parametrize("limit", [1000, 3])  # with 3, the titles of an author are numbered by ranges
def test_recommendations_with_hot_author_and_hot_member_match_brute_force(spark, limit):
    import random

    from tests.test_operators import _brute_recommend

    rnd = random.Random(7)
    authors = ["HOT"] * 4 + [f"A{i}" for i in range(6)]
    books = [(f"b{i:03d}", rnd.choice(authors), "Available" if rnd.random() < 0.6 else "Borrowed")
             for i in range(300)]
    edges = [(f"b{rnd.randrange(300):03d}", f"b{rnd.randrange(300):03d}") for _ in range(400)]
    history = set()
    for _ in range(700):
        user = 1 if rnd.random() < 0.3 else rnd.randrange(2, 60)
        history.add((user, f"b{rnd.randrange(300):03d}"))
    history = sorted(history)
    t = {
        "book": spark.createDataFrame([(b, f"T {b}", 2000, "G", a, s, "S1") for b, a, s in books], TABLES["book"].schema),
        "related_books": spark.createDataFrame(sorted(set(edges)), "ISBN string, RelatedISBN string"),
        "loan": spark.createDataFrame([(i, u, D(2001, 1, 1), None, None, Decimal("0")) for i, (u, _) in enumerate(history)],
                                      TABLES["loan"].schema),
        "loan_item": spark.createDataFrame([(i, b) for i, (_, b) in enumerate(history)], "LoanID int, ISBN string"),
    }
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        for k in (1, 4, 9):
            got = {(r.UserID, r.RankNo): (r.ISBN, r.Score)
                   for r in member.recommend_books(t, k, "2001-07-26", num_partitions=6).collect()}
            assert got == _brute_recommend(history, books, edges, k), k
    finally:
        spark.conf.set(name, old)


def test_related_titles_under_the_floor_are_not_listed(spark):
    """Members with a strong author list no related title that cannot reach their k-th score."""
    books = [(f"a{i}", "A", "Available") for i in range(12)] + [(f"b{i}", "B", "Available") for i in range(40)]
    edges = [(f"a{i % 6}", f"b{i}") for i in range(36)] + [("a0", "b39"), ("a1", "b39"), ("a2", "b39"), ("a3", "b39")]
    history = [(1, f"a{i}") for i in range(4)] + [(2, "a0"), (3, "b0"), (3, "a5")]
    t = {
        "book": spark.createDataFrame([(b, f"T {b}", 2000, "G", a, s, "S1") for b, a, s in books], TABLES["book"].schema),
        "related_books": spark.createDataFrame(edges, "ISBN string, RelatedISBN string"),
        "loan": spark.createDataFrame([(i, u, D(2001, 1, 1), None, None, Decimal("0")) for i, (u, _) in enumerate(history)],
                                      TABLES["loan"].schema),
        "loan_item": spark.createDataFrame([(i, b) for i, (_, b) in enumerate(history)], "LoanID int, ISBN string"),
    }
    edge_rows = member._author_edges(t, t["book"].select("ISBN", "Author"), t["book"].select("ISBN", "Author"))
    assert {r._in for r in edge_rows.filter("RelatedISBN = 'b39'").collect()} == {4} and edge_rows.count() == 80
    hist = spark.createDataFrame(history, "UserID int, ISBN string")
    per = spark.createDataFrame([(1, "A", 4), (2, "A", 1), (3, "A", 1), (3, "B", 1)], "UserID int, Author string, _n bigint")
    floor = spark.createDataFrame([(1, 4), (2, 1), (3, 1)], "UserID int, _floor bigint")
    got = {(r.UserID, r.ISBN): r.Score for r in member._related_scores(hist, edge_rows, per, floor).collect()}
    assert {b for u, b in got if u == 1} == {"b39"} and got[1, "b39"] == 4
    assert ("b1" not in {b for u, b in got if u == 1}) and {b for u, b in got if u == 2} > {"b39"}
    from tests.test_operators import _brute_recommend
    rows = {(r.UserID, r.RankNo): (r.ISBN, r.Score) for r in member.recommend_books(t, 3, "2001-07-26").collect()}
    assert rows == _brute_recommend(history, books, edges, 3)
