"""Hand-made rows for what the fixtures cannot reach, and the invariants of
SURVEY §5 (checks, cascades, folds, fines)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from circula.functions import formats as fmt
from circula.functions.common import Policy
from circula.operators import actions, circulation, figures, ingest, member, policy, quality, reconcile
from circula.operators.ranking import sequence_numbers, top_k_per_group
from circula.schema import TABLES
from circula.sources.fixtures import Fixtures
from tests.conftest import SF_SMALL

POL = Policy(1, "Standard", 14, 5, Decimal("0.50"), 2)
D = dt.date


def frame(spark, table, rows):
    return spark.createDataFrame(rows, TABLES[table].schema)


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_SMALL)


# ------------------------------------------------------------------ policy
def test_due_date_fills_only_missing(spark):
    loans = frame(spark, "loan", [(1, 1, D(2001, 7, 1), None, None, Decimal("0")),
                                  (2, 1, D(2001, 7, 1), D(2001, 7, 3), None, Decimal("0"))])
    got = dict(policy.due_dates(loans, POL).select("LoanID", "DueDate").collect())
    assert got == {1: D(2001, 7, 15), 2: D(2001, 7, 3)}


def test_loan_status_labels(spark):
    loans = frame(spark, "loan", [
        (1, 1, D(2001, 7, 1), D(2001, 7, 30), None, Decimal("0")),
        (2, 1, D(2001, 7, 1), D(2001, 7, 26), None, Decimal("0")),
        (3, 1, D(2001, 7, 1), D(2001, 7, 20), None, Decimal("0")),
        (4, 1, D(2001, 7, 1), D(2001, 7, 20), D(2001, 7, 21), Decimal("0"))])
    got = dict(policy.loan_status(loans, "2001-07-26").select("LoanID", "LoanStatus").collect())
    assert got == {1: "On Time", 2: "Due Today", 3: "Overdue", 4: "Returned"}


def test_fines_never_bill_grace_days(spark):
    t = {"loan": frame(spark, "loan", [
        (1, 7, D(2001, 7, 1), D(2001, 7, 10), D(2001, 7, 12), Decimal("0")),   # 2 late: grace
        (2, 7, D(2001, 7, 1), D(2001, 7, 10), D(2001, 7, 13), Decimal("0")),   # 3 late: 1 billed
        (3, 7, D(2001, 7, 1), D(2001, 7, 10), None, Decimal("0"))])}           # open, 16 late
    got = {r.LoanID: (r.BillableDays, r.Amount) for r in policy.assess_fines(t, POL, "2001-07-26").collect()}
    assert got == {2: (1, Decimal("0.50")), 3: (14, Decimal("7.00"))}


def test_assessed_fines_equal_fine_fixture(fx):
    got = policy.assess_fines(fx, fx["policy"], "2001-07-26").select(
        "LoanID", "UserID", "IssueDate", F.col("BillableDays").cast("bigint").alias("BillDays"), "Amount")
    want = fx["fine"].select("LoanID", "UserID", "IssueDate", "Amount").join(
        fx["fine_base"].select("LoanID", "BillDays"), "LoanID")
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert want.select(got.columns).exceptAll(got).count() == 0


def test_stale_reservations_are_exactly_the_expired_ones(fx):
    before = fx["reservation"]
    after = policy.expire_reservations(fx, "2001-07-26")
    changed = after.exceptAll(before).select("ReservationID")
    stale = reconcile.stale_reservations(fx, "2001-07-26").select("ReservationID")
    assert changed.count() == stale.count() > 0
    assert changed.exceptAll(stale).count() == 0


# ------------------------------------------------------------------ figures
def test_empty_money_sums_are_zero(spark):
    t = {"payment": frame(spark, "payment", []),
         "fine": frame(spark, "fine", []),
         "library_user": frame(spark, "library_user", [(1, "A", None, None, None, None, None, "Active", None)])}
    assert figures.total_revenue(t).first()[0] == Decimal("0.00")
    row = member.fine_balance(t).first()
    assert (row.UnpaidAmount, row.UnpaidFines) == (Decimal("0.00"), 0)
    assert figures.pending_fines(t).first().UnpaidTotal == Decimal("0.00")


def test_book_actions_never_resolve(fx):
    got = {r.EntityType: r for r in figures.resolve_processed(fx).collect()}
    assert got["Book"].Resolved == 0 and got["Book"].Unresolved == got["Book"].Actions


def test_top_k_lists_respect_k(fx):
    assert figures.recent_transactions(fx, "2001-07-26", 7).count() == 7
    assert figures.member_activity(fx, "2001-07-26", 4).count() == 4
    assert figures.activity_log(fx, "2001-07-26", 3).count() == 3


def test_transaction_history_pages_by_key(fx):
    p1 = figures.transaction_history(fx, "2001-07-26", page=20).collect()
    last = p1[-1]
    p2 = figures.transaction_history(fx, "2001-07-26", page=20,
                                     after=(last.TxDate, last.LoanID, last.TxType, last.ISBN)).collect()
    both = figures.transaction_history(fx, "2001-07-26", page=40).collect()
    key = lambda r: (r.TxDate, r.LoanID, r.TxType, r.ISBN)
    assert [key(r) for r in p1 + p2] == [key(r) for r in both]


def test_recent_lists_come_in_order_without_broadcasts(spark, fx, tmp_path):
    from circula.sources.tables import load_table, write_table
    stored = {}
    for n in ("loan", "loan_item", "library_user", "book", "report", "employee", "processed_by", "payment", "fine"):
        write_table(fx[n], f"{tmp_path}/{n}")
        stored[n] = load_table(spark, n, f"{tmp_path}/{n}")
    fx = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, key in (
            (figures.recent_transactions(fx, "2001-07-26", 30), lambda r: (-r.TxDate.toordinal(), -r.LoanID, r.TxType, r.ISBN)),
            (figures.recent_reports(fx, "2001-07-26", 10), lambda r: (-r.GenerationDate.toordinal(), -r.ReportID)),
            (figures.activity_log(fx, "2001-07-26", 20), lambda r: (-r.ActionDate.toordinal(), -r.ProcessID)),
            (figures.member_activity(fx, "2001-07-26", 20), lambda r: (-r.EventDate.toordinal(), r.Kind, r.RefID)),
        ):
            plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
            assert "hashpartitioning" not in plan  # nothing as large as a table is shuffled
            got = rows.collect()
            assert [r.RowNo for r in got] == list(range(1, len(got) + 1))
            assert [key(r) for r in got] == sorted(key(r) for r in got)
        first = figures.transaction_history(fx, "2001-07-26", page=20).collect()
        last = first[-1]
        second = figures.transaction_history(fx, "2001-07-26", page=20, after=(
            last.TxDate, last.LoanID, last.TxType, last.ISBN)).collect()
        both = figures.transaction_history(fx, "2001-07-26", page=40).collect()
        key = lambda r: (r.TxDate, r.LoanID, r.TxType, r.ISBN)
        assert [key(r) for r in first + second] == [key(r) for r in both]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_newest_rows_are_found_however_far_back_they_are(spark):
    loans = spark.createDataFrame([(i, 1, D(1995 + i, 1, 1), None, D(1995 + i, 2, 1) if i % 2 else None) for i in range(5)],
                                  "LoanID int, UserID int, CheckoutDate date, DueDate date, ReturnDate date")
    items = spark.createDataFrame([(i, str(i)) for i in range(4)], "LoanID int, ISBN string")  # loan 4 has none
    t = {"loan": loans, "loan_item": items,
         "library_user": spark.createDataFrame([(1, "A")], "UserID int, Name string"),
         "book": spark.createDataFrame([("0", "T")], "ISBN string, Title string")}
    got = figures.recent_transactions(t, "2001-07-26", 10).collect()
    assert [(r.LoanID, r.TxType) for r in got] == [(3, "Return"), (3, "Borrow"), (2, "Borrow"), (1, "Return"),
                                                  (1, "Borrow"), (0, "Borrow")]
    assert got[-1].Title == "T" and got[0].Title is None


def test_open_loan_without_a_due_date_has_no_status(spark):
    df = spark.createDataFrame([(D(2001, 7, 25), None, None)], "CheckoutDate date, DueDate date, ReturnDate date")
    assert policy.loan_status(df, "2001-07-26").first().LoanStatus is None


def test_staff_total_holds_actions_without_a_type(spark):
    t = {"employee": spark.createDataFrame([(1, "A"), (2, "B")], "EmployeeID int, Name string"),
         "processed_by": spark.createDataFrame([(1, 1, "Loan"), (2, 1, None)], "ProcessID int, EmployeeID int, EntityType string")}
    got = {r.EmployeeID: (r.LoanActions, r.TotalActions) for r in figures.staff_activity(t).collect()}
    assert got == {1: (1, 2), 2: (0, 0)}


def test_upsert_leaves_out_changes_without_a_key(spark):
    cur = spark.createDataFrame([(1, "a")], "UserID int, Name string")
    ch = spark.createDataFrame([(None, "x"), (2, "b")], "UserID int, Name string")
    assert sorted(tuple(r) for r in ingest.upsert(cur, ch, ["UserID"], ["Name"]).collect()) == [(1, "a"), (2, "b")]
    assert [r.Name for r in ingest.rejected_changes(ch, ["UserID"]).collect()] == ["x"]


def test_signup_delivered_again_counts_once(spark):
    form = (1, "A", "B", "a@b.c", "1", "s", True)
    df = spark.createDataFrame([form, form, (2, "A", "B", "A@B.C ", "1", "s", True), (1, "Z", "B", "a@b.c", "1", "s", True)],
                               "SubmissionID int, firstName string, lastName string, email string, phone string, "
                               "address string, terms boolean")
    users = spark.createDataFrame([], "UserID int, Email string")
    got = sorted((r.SubmissionID, r.Name, r.Reason) for r in ingest.normalize_signups(df, users, "2001-07-26").collect())
    assert got == [(1, "A B", None), (1, "Z B", ingest.SIGNUP_REPEAT), (2, "A B", ingest.SIGNUP_REPEAT)] or \
        [g[2] is None for g in got].count(True) == 1 and len(got) == 3


def test_rekey_outcomes_hold_every_map_row(spark):
    t = {"book": spark.createDataFrame([("1",), ("2",)], "ISBN string"),
         "book_authors": spark.createDataFrame([], "ISBN string, AuthorName string"),
         "related_books": spark.createDataFrame([], "ISBN string, RelatedISBN string"),
         "reservation_item": spark.createDataFrame([], "ReservationID int, ISBN string"),
         "loan_item": spark.createDataFrame([], "LoanID int, ISBN string")}
    m = spark.createDataFrame([("1", None), (None, "9"), ("2", "x" * 40), ("1", "7")], "OldISBN string, NewISBN string")
    got = {(r.OldISBN, r.NewISBN): r.Outcome for r in actions.rekey_outcomes(t, m).collect()}
    assert got == {("1", None): "null key", (None, "9"): "null key", ("2", "x" * 40): "key too long", ("1", "7"): "renamed"}


def test_no_row_ends_an_ingest(spark, fx, tmp_path):
    rows = [("1", "1", "1", "2001-07-01", "999999.995", "Paid"), ("3000000000", "1", "1", "2001-07-01", "1.00", "Paid"),
            ("3", "1", "1", "2001-13-40", "1.00", "Paid"), ("4", "x", "1", "2001-07-01", "1.00", "Paid"),
            ("5", "1", "1", "2001-07-01", "abc", "Paid"), ("6", "1", "1", "2001-07-01", "2.50", "Paid")]
    raw = spark.createDataFrame(rows, "FineID string, LoanID string, UserID string, IssueDate string, Amount string, Status string")
    t = {"loan": spark.createDataFrame([(1,)], "LoanID int"), "library_user": spark.createDataFrame([(1,)], "UserID int")}
    ingest.ingest_table(t, "fine", raw, f"{tmp_path}/good", f"{tmp_path}/bad", "2001-07-26")
    good = spark.read.parquet(f"{tmp_path}/good").collect()
    assert [(r.FineID, r.Amount) for r in good] == [(6, Decimal("2.50"))]
    bad = {r.FineID: r.BrokenRules for r in spark.read.parquet(f"{tmp_path}/bad").collect()}
    assert "DECIMAL(Amount,8,2)" in bad["1"] and "TYPE(FineID int)" in bad["3000000000"]
    assert "TYPE(IssueDate date)" in bad["3"] and "TYPE(LoanID int)" in bad["4"] and "TYPE(Amount decimal(8,2))" in bad["5"]


def test_no_books_allowed_rejects_every_request(spark, fx):
    from circula.functions.common import Policy
    p = Policy(1, "none", 14, 0, Decimal("0.50"), 2)
    got = circulation.issue_loans(fx, fx["loan_request"], p, "2001-07-26")
    assert got.filter("Decision = 'accepted'").count() == 0
    assert got.filter("Reason = 'over loan limit'").count() > 0


def test_two_actions_in_a_row_read_back(spark, tmp_path):
    root = str(tmp_path)
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "UserID int, Name string")
    empty = {n: spark.createDataFrame([], f"{k} int, UserID int, LoanID int, FineID int, ReservationID int")
             for n, k in (("loan", "x"), ("loan_item", "x"), ("fine", "x"), ("payment", "x"), ("reservation", "x"),
                          ("reservation_item", "x"))}
    t = {**empty, "library_user": users}
    for version, gone in (("1", 2), ("2", 3)):
        keys = spark.createDataFrame([(gone,)], "UserID int")
        tables, _ = actions.delete_users(t, keys)
        actions.apply_action({"library_user": tables["library_user"]}, root, version)
        t = {**t, "library_user": actions.read_version(spark, root, "library_user", version)}
    assert [r.UserID for r in t["library_user"].collect()] == [1]


def test_hot_keys_can_be_split(spark):
    """With an exchange under both sides AQE splits a hot key of a join with grouped rows."""
    from circula.operators.ranking import spread_join
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10kb", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        left = spark.range(0, 200_000, 1, 8).selectExpr("if(id % 3 < 2, 7, id) AS k", "id AS v")
        grouped = left.groupBy("k").count()
        df = spread_join(left, grouped, ["k"], "left")
        assert df.filter("count is null").count() == 0
        out = df.selectExpr("sum(hash(v, count)) AS s")
        out.collect()
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        assert "skew=true" in plan
        nulls = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
        got = spread_join(nulls, spark.createDataFrame([(1, "x")], "k int, w string"), ["k"], "left")
        assert sorted((r.v, r.w) for r in got.collect()) == [(1, None), (2, "x")]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_browse_catalog_author_filter(fx):
    got = figures.browse_catalog(fx, author="Brand#3").collect()
    assert got and all("Brand#3" in r.Authors.split("; ") for r in got)


# ------------------------------------------------------------------ formats
def test_formats(spark):
    df = spark.createDataFrame([(7, Decimal("2500.00"), 1234, D(2025, 11, 1))], "id int, m decimal(8,2), n bigint, d date")
    r = df.select(fmt.code("L", "id", 3).alias("a"), fmt.code("M", F.lit(123456), 4).alias("b"),
                  fmt.money("m", 0).alias("c"), fmt.money("m", 2).alias("e"), fmt.thousands("n").alias("f"),
                  fmt.day("d").alias("g"), fmt.age_days("d", F.lit("2025-11-04").cast("date")).alias("h"),
                  fmt.age_days("d", F.lit("2025-11-01").cast("date")).alias("i")).first()
    assert tuple(r) == ("L007", "M123456", "$2,500", "$2,500.00", "1,234", "Nov 1, 2025", "3 days ago", "today")


# ------------------------------------------------------------------ ranking
def test_sequence_numbers_equal_row_number_under_a_hot_key(spark):
    hot = [("hot", i) for i in range(3000)]
    cold = [(f"k{i % 97}", i) for i in range(6000)]
    df = spark.createDataFrame(hot + cold, "g string, v int")
    got = sequence_numbers(df, ["v"], ["g"], "n", num_partitions=16)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # the hot key is spread over several range partitions, not one task
    spread = (df.repartitionByRange(16, "g", "v").withColumn("p", F.spark_partition_id())
              .filter("g = 'hot'").select("p").distinct().count())
    assert spread > 1


def test_global_sequence_is_gap_free(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("v"))
    got = sorted(r.n for r in sequence_numbers(df, ["v"], [], "n", num_partitions=7).collect())
    assert got == list(range(1, 5001))


def test_top_k_plans_a_partial_group_limit(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = top_k_per_group(df, ["g"], [F.col("v").desc()], 2, "r")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted((r.g, r.v) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


# ---------------------------------------------------------- recommendations
def _brute_recommend(history, books, edges, k):
    author = {b: a for b, a, _ in books}
    avail = {b for b, _, s in books if s == "Available"}
    sym = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    out = {}
    for user in {u for u, _ in history}:
        mine = {b for u, b in history if u == user}
        score = {}
        for c in avail - mine:
            srcs = {s for s in mine if (s, c) in sym or (author.get(s) is not None and author.get(s) == author.get(c))}
            if srcs:
                score[c] = len(srcs)
        ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        for i, (c, s) in enumerate(ranked, 1):
            out[(user, i)] = (c, s)
    return out


def test_recommendations_match_brute_force(spark):
    books = [(f"b{i:02d}", f"A{i % 3}", "Available" if i % 4 else "Borrowed") for i in range(30)]
    books += [("x1", None, "Available"), ("x2", None, "Available")]
    edges = [("b01", "b02"), ("b02", "b05"), ("b03", "x1"), ("b07", "b07"), ("b10", "b11"), ("x1", "x2"), ("b05", "b13")]
    history = [(1, "b01"), (1, "b03"), (1, "b04"), (2, "b02"), (2, "b05"), (2, "x1"), (3, "b10"), (3, "b13"), (3, "b16")]
    t = {
        "book": spark.createDataFrame([(b, f"T {b}", 2000, "G", a, s, "S1") for b, a, s in books], TABLES["book"].schema),
        "related_books": spark.createDataFrame(edges, "ISBN string, RelatedISBN string"),
        "loan": frame(spark, "loan", [(i, u, D(2001, 1, 1), None, None, Decimal("0")) for i, (u, _) in enumerate(history)]),
        "loan_item": spark.createDataFrame([(i, b) for i, (_, b) in enumerate(history)], "LoanID int, ISBN string"),
    }
    for k in (1, 3, 6):
        got = {(r.UserID, r.RankNo): (r.ISBN, r.Score)
               for r in member.recommend_books(t, k, "2001-07-26", num_partitions=3).collect()}
        assert got == _brute_recommend(history, books, edges, k)


# ------------------------------------------------------------------ quality
def test_split_valid_partitions_the_input(fx):
    good, bad = quality.split_valid(fx, "fine", fx["raw_fine"])
    assert good.count() + bad.count() == fx["raw_fine"].count()
    assert bad.filter(F.col("BrokenRules") == "").count() == 0


def test_apply_defaults_keeps_present_nulls(spark):
    df = spark.createDataFrame([(1, "A", None)], "UserID int, Name string, AccountStatus string")
    r = quality.apply_defaults(df, "library_user", "2001-07-26").first()
    assert r.AccountStatus is None and r.Street is None  # present-but-null stays null
    df2 = spark.createDataFrame([(1, 5)], "ReservationID int, UserID int")
    r2 = quality.apply_defaults(df2, "reservation", "2001-07-26").first()
    assert r2.Status == "Active" and r2.ReservationDate == D(2001, 7, 26)


def test_checks_on_hand_rows(spark):
    books = spark.createDataFrame(
        [("1", "T", 1850, "G", "A", "Missing"), ("2", None, 0, "G", "A", "Available"),
         ("2", "T", 2000, "G", "A", None), (None, "T", 2156, "G", "A", "lost")],
        "ISBN string, Title string, PublicationYear int, Genre string, Author string, Status string")
    pk = {(r.row_key, r.detail) for r in quality.check_primary_key(books, "book").collect()}
    assert pk == {("NULL", "null key"), ("2", "repeated 2 times")}
    assert {r.row_key for r in quality.check_not_null(books, "book").collect()} == {"2"}
    assert {r.row_key for r in quality.check_enum(books, "book").collect()} == {"1", "NULL"}
    assert {r.row_key for r in quality.check_year(books, "book").collect()} == {"1", "NULL"}


# ------------------------------------------------------------- ingest
def test_upsert_last_change_wins_and_inserts_with_defaults(spark):
    cur = frame(spark, "library_user", [(1, "A", "a@x", None, "St 1", "C", "1", "Suspended", D(2000, 1, 1))])
    changes = spark.createDataFrame(
        [(1, "A2", 1), (1, "A3", 2), (2, "B", 1)], "UserID int, Name string, Seq int")
    got = {r.UserID: r for r in ingest.upsert(cur, changes, ["UserID"], ["Seq"], "library_user", "2001-07-26").collect()}
    assert got[1].Name == "A3" and got[1].Street == "St 1" and got[1].AccountStatus == "Suspended"
    assert got[2].Name == "B" and got[2].AccountStatus == "Active" and got[2].Street is None


def test_signup_rules(spark):
    users = frame(spark, "library_user", [(1, "Old", "taken@x.org", None, None, None, None, "Active", None)])
    forms = spark.createDataFrame([
        (1, "Ann", "Lee", " Ann@X.org ", "1", "Main", True),
        (2, "Ann", "Lee", "ann@x.org", "1", "Main", True),     # repeat of 1
        (3, "Bo", "Ek", "TAKEN@x.org", "1", "Main", True),     # held by a user
        (4, "Cy", "", "c@x.org", "1", "Main", True),           # missing last name
        (5, "Di", "Fa", "d@x.org", "1", "Main", False),        # terms off
        (6, "Ed", "Go", "e@@x.org", "1", "Main", True),        # two '@'
    ], "SubmissionID int, firstName string, lastName string, email string, phone string, address string, terms boolean")
    got = {r.SubmissionID: r.Reason for r in ingest.normalize_signups(forms, users, "2001-07-26").collect()}
    assert got == {1: None, 2: ingest.SIGNUP_REPEAT, 3: ingest.SIGNUP_TAKEN, 4: ingest.SIGNUP_MISSING,
                   5: ingest.SIGNUP_TERMS, 6: ingest.SIGNUP_EMAIL}


def test_assign_ids_continue_the_sequence(spark):
    df = spark.createDataFrame([(i,) for i in (50, 10, 30, 20, 40)], "s int")
    got = sorted((r.s, r.id) for r in ingest.assign_ids(df, "id", ["s"], 101, num_partitions=3).collect())
    assert got == [(10, 101), (20, 102), (30, 103), (40, 104), (50, 105)]


# ------------------------------------------------------------ actions
FK_CHECKS = [("loan", "library_user"), ("loan_item", "loan"), ("fine", "loan"), ("fine", "library_user"),
             ("payment", "fine"), ("reservation", "library_user"), ("reservation_item", "reservation")]


def test_delete_users_leaves_no_orphans(fx):
    t = fx.tables()
    tables, counts = actions.delete_users(t, fx["delete_user"])
    after = {**t, **tables}
    for child, parent in FK_CHECKS:
        fks = [f for f in TABLES[child].foreign_keys if f.parent == parent]
        for f in fks:
            assert quality.check_foreign_key(after[child], after, child, f).count() == 0, (child, parent)
    n = dict(((r.table_name), r.row_count) for r in counts.collect())
    assert n["library_user"] == fx["delete_user"].count()
    assert after["loan"].count() == t["loan"].count() - n["loan"]


def test_delete_books_refuses_per_key(fx):
    outcomes = dict(actions.book_delete_outcomes(fx, fx["delete_book"]).collect())
    assert outcomes["99999999"] == "not found"
    assert {"refused", "deleted"} <= set(outcomes.values())
    tables, _, _ = actions.delete_books(fx, fx["delete_book"])
    gone = [k for k, v in outcomes.items() if v == "deleted"]
    assert tables["book"].filter(F.col("ISBN").isin(gone)).count() == 0
    assert tables["related_books"].filter(F.col("ISBN").isin(gone) | F.col("RelatedISBN").isin(gone)).count() == 0


def test_delete_employees_sets_report_author_null(fx):
    tables, counts = actions.delete_employees(fx, fx["delete_employee"])
    ids = [r.EmployeeID for r in fx["delete_employee"].collect()]
    assert tables["report"].filter(F.col("GeneratedBy").isin(ids)).count() == 0
    assert tables["report"].count() == fx["report"].count()


def test_rekey_cascades_to_book_authors(spark):
    t = {"book": frame(spark, "book", [("a", "T", 2000, "G", "X", "Available", "S"), ("b", "T", 2000, "G", "X", "Available", "S"),
                                       ("c", "T", 2000, "G", "X", "Available", "S")]),
         "book_authors": spark.createDataFrame([("a", "X"), ("b", "X")], "ISBN string, AuthorName string"),
         "related_books": spark.createDataFrame([("b", "c")], "ISBN string, RelatedISBN string"),
         "reservation_item": spark.createDataFrame([], "ReservationID int, ISBN string"),
         "loan_item": spark.createDataFrame([], "LoanID int, ISBN string")}
    m = spark.createDataFrame([("a", "a2"), ("b", "b2"), ("z", "z2"), ("c", "a")], "OldISBN string, NewISBN string")
    tables, counts, outcomes = actions.rekey_books(t, m)
    assert dict((r.OldISBN, r.Outcome) for r in outcomes.collect()) == {
        "a": "renamed", "b": "referenced", "z": "not found", "c": "referenced"}
    assert sorted(r.ISBN for r in tables["book_authors"].collect()) == ["a2", "b"]


# -------------------------------------------------------------- circulation
def test_issue_loans_rules(spark):
    t = {"library_user": frame(spark, "library_user", [
            (1, "U1", None, None, None, None, None, "Active", None),
            (2, "U2", None, None, None, None, None, "Suspended", None)]),
         "book": frame(spark, "book", [(b, "T", 2000, "G", "X", s, "S") for b, s in
                                       [("a", "Available"), ("b", "Borrowed"), ("c", "Available"), ("d", "Available"),
                                        ("e", "Available")]]),
         "loan": frame(spark, "loan", [(9, 1, D(2001, 7, 1), None, None, Decimal("0"))]),
         "loan_item": spark.createDataFrame([(9, "x1"), (9, "x2"), (9, "x3")], "LoanID int, ISBN string")}
    pol = Policy(1, "P", 14, 5, Decimal("0.50"), 2)
    req = spark.createDataFrame([
        (1, 1, "a", D(2001, 7, 26)), (2, 1, "a", D(2001, 7, 26)), (3, 2, "c", D(2001, 7, 26)),
        (4, 3, "c", D(2001, 7, 26)), (5, 1, "b", D(2001, 7, 26)), (6, 1, "q", D(2001, 7, 26)),
        (7, 1, "c", D(2001, 7, 26)), (8, 1, "d", D(2001, 7, 26))],
        "RequestID int, UserID int, ISBN string, RequestDate date")
    got = {r.RequestID: (r.Reason, r.DueDate) for r in circulation.issue_loans(t, req, pol, "2001-07-26").collect()}
    assert got == {
        1: (None, D(2001, 8, 9)), 2: (circulation.BOOK_TAKEN, None), 3: (circulation.ACCOUNT_NOT_ACTIVE, None),
        4: (circulation.UNKNOWN_USER, None), 5: (circulation.BOOK_NOT_AVAILABLE, None),
        6: (circulation.UNKNOWN_BOOK, None), 7: (None, D(2001, 8, 9)), 8: (circulation.OVER_LIMIT, None)}


def test_fold_handles_odd_event_orders(spark):
    ev = spark.createDataFrame([
        (1, 5, "RETURN", D(2001, 7, 1), 3), (1, 5, "ISSUE", D(2001, 7, 5), 1),     # return before issue
        (2, 6, "ISSUE", D(2001, 7, 1), 1), (2, 6, "ISSUE", D(2001, 7, 1), 1),       # repeated event
        (2, 6, "RENEW", D(2001, 7, 14), 2), (2, 6, "RENEW", D(2001, 7, 30), 4),
        (2, 6, "RETURN", D(2001, 7, 20), 3),                                       # 2nd renew after return
        (3, 7, "RETURN", D(2001, 7, 9), 3)],                                        # no issue
        "LoanID int, UserID int, Kind string, EventDate date, Seq int")
    loans, rejects = circulation.fold_circulation(ev, POL)
    got = {r.LoanID: (r.UserID, r.CheckoutDate, r.DueDate, r.ReturnDate, r.Renewals) for r in loans.collect()}
    assert got == {1: (5, D(2001, 7, 5), D(2001, 7, 19), D(2001, 7, 1), 0),
                   2: (6, D(2001, 7, 1), D(2001, 7, 29), D(2001, 7, 20), 1)}
    assert [r.LoanID for r in rejects.collect()] == [3]


def test_fold_reproduces_loan_return_dates(fx):
    loans, _ = circulation.fold_circulation(fx["circulation_event"], fx["policy"])
    got = loans.select("LoanID", "UserID", "CheckoutDate", "ReturnDate")
    want = fx["loan_base"].select("LoanID", "UserID", "CheckoutDate", "ReturnDate")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("k", [1, 2])
def test_reading_history_is_latest_k(fx, k):
    got = member.reading_history(fx, k)
    assert got.groupBy("UserID").count().agg(F.max("count")).first()[0] <= k
    assert got.agg(F.min("RankNo"), F.max("RankNo")).first() == (1, k)


def test_ingest_quarantines_oversize_amounts_instead_of_failing(spark, tmp_path):
    loans = frame(spark, "loan", [(1, 7, D(2001, 7, 1), D(2001, 7, 15), None, Decimal("0"))])
    users = frame(spark, "library_user", [(7, "U", None, None, None, None, None, "Active", None)])
    raw = spark.createDataFrame(
        [(1, 1, 7, D(2001, 7, 20), Decimal("1234567.89"), "Unpaid", "x"),
         (2, 1, 7, D(2001, 7, 20), Decimal("3.50"), "Unpaid", "x"),
         (3, 9, 7, D(2001, 7, 20), Decimal("1.00"), "Paid", "x")],
        "FineID int, LoanID int, UserID int, IssueDate date, Amount decimal(12,2), Status string, Description string")
    ingest.ingest_table({"loan": loans, "library_user": users}, "fine", raw,
                        str(tmp_path / "good"), str(tmp_path / "bad"), "2001-07-26")
    good = spark.read.parquet(str(tmp_path / "good"))
    bad = dict(spark.read.parquet(str(tmp_path / "bad")).select("FineID", "BrokenRules").collect())
    assert dict(good.dtypes)["Amount"] == "decimal(8,2)" and [r.FineID for r in good.collect()] == [2]
    assert bad == {1: "DECIMAL(Amount,8,2)", 3: "FOREIGN KEY(LoanID->loan)"}


def test_ingest_files_quarantines_unparsable_csv_rows(spark, tmp_path):
    src = tmp_path / "fine_csv"
    src.mkdir()
    (src / "part.csv").write_text(
        "FineID,LoanID,UserID,IssueDate,Amount,Status,Description\n"
        "1,1,7,2001-07-20,3.50,Unpaid,late\n"
        "two,1,7,2001-07-20,3.50,Unpaid,late\n"
        "3,1,7,2001-07-20,1.00,Overdue,late\n")
    loans = frame(spark, "loan", [(1, 7, D(2001, 7, 1), D(2001, 7, 15), None, Decimal("0"))])
    users = frame(spark, "library_user", [(7, "U", None, None, None, None, None, "Active", None)])
    ingest.ingest_files({"loan": loans, "library_user": users}, "fine", str(src), "csv",
                        str(tmp_path / "good"), str(tmp_path / "bad"), "2001-07-26")
    good = spark.read.parquet(str(tmp_path / "good"))
    assert [r.FineID for r in good.collect()] == [1] and "_corrupt_record" not in good.columns
    bad = {r._corrupt_record: r.BrokenRules for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad[None] == "ENUM(Status)"
    assert [v for k, v in bad.items() if k is not None][0].startswith("PARSE")


def test_rekey_refuses_ambiguous_maps_and_taken_keys(spark):
    t = {"book": frame(spark, "book", [(b, "T", 2000, "G", "X", "Available", "S") for b in ("a", "b", "c", "d")]),
         "book_authors": spark.createDataFrame([("a", "X"), ("d", "X")], "ISBN string, AuthorName string"),
         "related_books": spark.createDataFrame([], "ISBN string, RelatedISBN string"),
         "reservation_item": spark.createDataFrame([], "ReservationID int, ISBN string"),
         "loan_item": spark.createDataFrame([], "LoanID int, ISBN string")}
    m = spark.createDataFrame([("a", "n1"), ("b", "n1"), ("c", "d"), ("d", "n2"), ("d", "n3")],
                              "OldISBN string, NewISBN string")
    _, counts, outcomes = actions.rekey_books(t, m)
    got = {(r.OldISBN, r.NewISBN): r.Outcome for r in outcomes.collect()}
    assert got == {("a", "n1"): "ambiguous", ("b", "n1"): "ambiguous", ("c", "d"): "new key exists",
                   ("d", "n2"): "ambiguous", ("d", "n3"): "ambiguous"}
    assert {(r.table_name, r.action): r.row_count for r in counts.collect()}[("book", "UPDATE")] == 0


def test_apply_action_writes_new_versions(spark, fx, tmp_path):
    t = fx.tables()
    tables, counts = actions.delete_users(t, fx["delete_user"])
    paths = actions.apply_action(tables, str(tmp_path), "1")
    removed = {r.table_name: r.row_count for r in counts.collect()}
    for name, path in paths.items():
        assert spark.read.parquet(path).count() == t[name].count() - removed[name]


def test_fold_ignores_events_without_a_date(spark):
    ev = spark.createDataFrame([
        (1, 5, "ISSUE", D(2001, 7, 1), 1), (1, 5, "RENEW", None, 2), (2, 6, "ISSUE", None, 1)],
        "LoanID int, UserID int, Kind string, EventDate date, Seq int")
    loans, rejects = circulation.fold_circulation(ev, POL)
    assert [(r.LoanID, r.Renewals, r.DueDate) for r in loans.collect()] == [(1, 0, D(2001, 7, 15))]
    assert [r.LoanID for r in rejects.collect()] == []


# ------------------------------------------------------------- lossless casts
def test_a_value_fits_if_nothing_of_it_is_lost(spark):
    from circula.functions.common import fitted

    def fits(values, kind, dtype):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.f for r in df.select("i", fitted(df, "v", dtype).alias("f")).orderBy("i").collect()]

    assert fits([3.0, 3.9, -0.5, 1e12, float("nan"), float("inf"), None], "double", "int") == [3, None, None, None, None, None, None]
    assert fits([Decimal("4.00"), Decimal("4.01")], "decimal(12,2)", "int") == [4, None]
    assert fits([2**31, 7], "bigint", "int") == [None, 7]
    assert fits(["7", " 8 ", "3.9", "x", "99999999999", ""], "string", "int") == [7, 8, None, None, None, None]
    assert fits(["2001-07-26", "2001-13-40", "2001-7-6", "2001-07-26 10:30", "2001-07-26 00:00:00", "2001", "2001-07-26 x"],
                "string", "date") == [D(2001, 7, 26), None, D(2001, 7, 6), None, D(2001, 7, 26), None, None]
    assert fits([dt.datetime(2001, 7, 26), dt.datetime(2001, 7, 26, 1)], "timestamp_ntz", "date") == [D(2001, 7, 26), None]
    assert fits([20010726], "int", "date") == [None] and fits([True], "boolean", "int") == [None]
    assert fits(["1.005", "1e9", "x"], "string", "decimal(5,2)") == [Decimal("1.01"), None, None]
    assert fits([12345], "int", "string") == ["12345"] and fits([D(2001, 1, 2)], "date", "int") == [None]


def test_a_bad_change_is_rejected_alone(spark):
    cur = spark.createDataFrame([(1, "a", D(2001, 1, 1)), (2, "b", D(2001, 1, 1))], "UserID int, Name string, MembershipDate date")
    ch = spark.createDataFrame([(1.0, "A", "2001-13-40"), (1.0, "A2", "2001-02-02"), (2.9, "lost", "2001-02-02"),
                                (3.0, None, "2001-03-03"), (None, "x", "2001-03-03"), (4e10, "far", None)],
                               "UserID double, Name string, MembershipDate string")
    got = sorted(tuple(r) for r in ingest.upsert(cur, ch, ["UserID"], ["MembershipDate"]).collect())
    assert got == [(1, "A2", D(2001, 2, 2)), (2, "b", D(2001, 1, 1)), (3, None, D(2001, 3, 3))]
    bad = {r.Name: r.Reason for r in ingest.rejected_changes(ch, ["UserID"], cur).collect()}
    assert bad == {"A": "TYPE(MembershipDate date)", "lost": "TYPE(UserID int)", "x": "NULL KEY(UserID)", "far": "TYPE(UserID int)"}
    held = ingest.rejected_changes(ch, ["UserID"], cur, "library_user", ["not_null"])
    assert {r.Reason for r in held.filter("Name is null").collect()} == {"NOT NULL(Name)"}
    some = ingest.upsert(cur, ch, ["UserID"], ["MembershipDate"], "library_user", rules=["not_null"])
    assert sorted(r.UserID for r in some.collect()) == [1, 2]
    with pytest.raises(ValueError):
        ingest.upsert(cur, ch, ["UserID"], ["MembershipDate"], rules=["not_null"])


def test_csv_texts_with_line_ends_and_quotes(spark, tmp_path):
    from circula.sources.tables import load_table, write_table
    texts = ["a\nb", 'say "x", then\r\n"y"', "", None, '"', "\\", ' \\" ', "a,b", "\n", "  lead", "trail  ", "#c", '""', "é z"]
    rows = [(i, None, D(1, 1, 1), t, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ReportID int, GeneratedBy int, GenerationDate date, Type string, Content string")
    write_table(df.repartition(3), str(tmp_path / "r"), fmt="csv")
    got = load_table(spark, "report", str(tmp_path / "r"), fmt="csv").collect()
    assert all(r._corrupt_record is None for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=lambda r: r[0]) == rows


# ------------------------------------------------------- newest transactions
@pytest.mark.parametrize("member_id,tx_type,lo,hi", [(None, None, None, None), (2, None, None, None), (None, "Return", None, None),
                                                    (1, "Borrow", "0500-01-01", "2001-05-01"), (7, None, None, None)])
def test_transaction_pages_equal_brute_force(spark, member_id, tx_type, lo, hi):
    import random
    rnd = random.Random(3)
    loans, items = [], []
    for i in range(60):
        out = rnd.choice([D(1, 1, 1), D(1000, 5, 5), D(2001, 5, 1), D(2001, 7, 20), D(9999, 12, 31)])
        back = None if rnd.random() < 0.4 else min(out + dt.timedelta(days=rnd.randrange(3)), D(2001, 7, 21)) if out.year < 9999 else D(9999, 12, 31)
        loans.append((i, rnd.randrange(1, 4), out, None, back))
        items += [(i, f"b{j}") for j in range(rnd.choice([0, 0, 1, 3]))]  # many loans without items
    t = {"loan": spark.createDataFrame(loans, "LoanID int, UserID int, CheckoutDate date, DueDate date, ReturnDate date"),
         "loan_item": spark.createDataFrame(items, "LoanID int, ISBN string"),
         "library_user": spark.createDataFrame([(1, "A")], "UserID int, Name string"),
         "book": spark.createDataFrame([("b0", "T")], "ISBN string, Title string")}
    as_of = "2001-07-26"
    want = []
    for i, u, out, _, back in loans:
        for isbn in [b for j, b in items if j == i]:
            if out <= D(2001, 7, 26):
                want.append((out, i, "Borrow", isbn, u))
                if back and back <= D(2001, 7, 26):
                    want.append((back, i, "Return", isbn, u))
    want = [w for w in want if (member_id is None or w[4] == member_id) and (tx_type is None or w[2] == tx_type)
            and (lo is None or D.fromisoformat(lo) <= w[0] <= D.fromisoformat(hi))]
    want = sorted(want, key=lambda w: (-w[0].toordinal(), -w[1], w[2], w[3]))
    got, after = [], None
    while True:
        page = figures.transaction_history(t, as_of, member_id, lo, hi, tx_type, after, page=17).collect()
        got += [(r.TxDate, r.LoanID, r.TxType, r.ISBN, r.UserID) for r in page]
        if len(page) < 17:
            break
        after = got[-1][:4]
    assert got == want


def test_newest_transactions_read_the_loans_once(spark, fx, tmp_path):
    """The jobs of a member's history scan loan and loan_item once each."""
    from circula.sources.tables import load_table, write_table
    from circula.operators import figures as fig
    t = {}
    for n in ("loan", "loan_item", "library_user", "book"):
        write_table(fx[n], f"{tmp_path}/{n}")
        t[n] = load_table(spark, n, f"{tmp_path}/{n}")
    user = fx["loan"].agg(F.min("UserID")).first()[0]
    events = fig._loan_events(t, "2001-07-26").filter(F.col("UserID") == user)
    plan = spark._jvm.PythonSQLUtils.explainString(events.orderBy(*fig._tx_order(last="")).limit(5)._jdf.queryExecution(), "simple")
    assert plan.count("FileScan") == 1 and "TakeOrderedAndProject" in plan and "Exchange" not in plan
    seen = []
    old = fig._numbered
    try:
        fig._numbered = lambda top, order: seen.append(1) or old(top, order)
        assert fig.transaction_history(t, "2001-07-26", member=user, page=5).count() == 5
    finally:
        fig._numbered = old
    assert seen == [1]  # no second pass


def test_a_stop_between_two_tables_is_no_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    users = spark.createDataFrame([(1, "a")], "UserID int, Name string")
    loans = spark.createDataFrame([(1, 1)], "LoanID int, UserID int")
    assert actions.versions(spark, root) == []
    actions.apply_action({"library_user": users, "loan": loans}, root, "1")
    assert actions.versions(spark, root) == ["1"] and actions.version_tables(spark, root, "1") == ["library_user", "loan"]
    assert actions.read_version(spark, root, "loan", "1").count() == 1
    with pytest.raises(KeyError):
        actions.read_version(spark, root, "fine", "1")

    broken = loans.select(F.expr("assert_true(LoanID > 1)").alias("x"), "LoanID")
    for version in ("2", "1"):  # a new version, and one that is written again
        with pytest.raises(Exception):  # noqa: B017, PT011
            actions.apply_action({"library_user": users, "loan": broken}, root, version)
        with pytest.raises(FileNotFoundError):
            actions.read_version(spark, root, "library_user", version)
    assert actions.versions(spark, root) == []
    actions.apply_action({"library_user": users}, root, "2")
    assert actions.versions(spark, root) == ["2"]
    with pytest.raises(ValueError):
        actions.apply_action({}, root, "3")


def test_fold_keeps_null_keys_out_of_the_aggregate(spark):
    ev = spark.createDataFrame([(None, 5, "RENEW", D(2001, 7, 1), i) for i in range(50)]
                               + [(None, 5, "ISSUE", None, 1), (1, 5, "ISSUE", D(2001, 7, 1), 1), (2, 5, "RETURN", D(2001, 7, 1), 1)],
                               "LoanID int, UserID int, Kind string, EventDate date, Seq int")
    loans, rejects = circulation.fold_circulation(ev, POL)
    assert [r.LoanID for r in loans.collect()] == [1]
    assert sorted((r.LoanID or 0, r.Reason) for r in rejects.collect()) == [(0, "no LoanID")] * 51 + [(2, "no ISSUE event")]
    facts = spark._jvm.PythonSQLUtils.explainString(loans._jdf.queryExecution(), "simple")
    assert "isnotnull(LoanID" in facts


# ----------------------------------------------------------------- title index
def test_title_search_by_grams_equals_a_scan(spark, tmp_path):
    import random

    from circula.operators import title_index as X
    rnd = random.Random(5)
    words = ["Über", "night", "Knight", "the", "a%b", "x_y", "Éa", "ab", "", "moonlight"]
    titles = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(5))) for _ in range(300)] + [None, "ab", "abc"]
    books = spark.createDataFrame([(f"i{k}", t, 2000, "G", "A", "Available") for k, t in enumerate(titles)],
                                  "ISBN string, Title string, PublicationYear int, Genre string, Author string, Status string")
    index = X.add_titles(books.filter("ISBN < 'i2'"), str(tmp_path / "x"))
    assert index.candidates("%night%").count() < 200
    index = X.add_titles(books.filter("ISBN >= 'i2'"), str(tmp_path / "x"))
    X.add_titles(spark.createDataFrame([("gone", "night")], "ISBN string, Title string"), str(tmp_path / "x"))
    t = {"book": books, "book_authors": spark.createDataFrame([], "ISBN string, AuthorName string")}
    for pattern in ("%KNIGHT%", "%ight_the%", "über%", "%éa a\\%b%", "%x\\_y n%", "ab"):
        want = sorted(r.ISBN for r in figures.browse_catalog(t, title_like=pattern).collect())
        got = sorted(r.ISBN for r in figures.browse_catalog(t, title_like=pattern, title_index=index).collect())
        assert got == want, pattern
    assert index.candidates("%ab%") is None and index.candidates("%qqq%").count() == 0
    cut = figures.browse_catalog(t, title_like="%moonlight%night%", title_index=index)
    plan = spark._jvm.PythonSQLUtils.explainString(cut._jdf.queryExecution(), "simple")
    assert "LeftSemi" in plan
    postings = spark.read.parquet(index.batches("postings")[0]).filter("bucket = 3 and gram = 'nig'")
    plan = spark._jvm.PythonSQLUtils.explainString(postings._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,nig)" in plan
    empty = X.add_titles(books.limit(0), str(tmp_path / "none"))
    assert figures.browse_catalog(t, title_like="%night%", title_index=empty).count() == 0


# ------------------------------------------------------------- queues by days
def test_queues_changed_by_days_equal_a_full_numbering(spark):
    import random
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "b1", "b2"]), i, i % 9, None if i % 50 == 7 else D(2001, 1, 1) + dt.timedelta(days=rnd.randrange(40)))
            for i in range(400)]
    schema = "ISBN string, ReservationID int, UserID int, ReservationDate date"

    def full(items):
        out = {}
        for isbn in {r[0] for r in items}:
            mine = sorted((r for r in items if r[0] == isbn), key=lambda r: (r[3] is None, r[3] or D(1, 1, 1), r[1]))
            out.update({(isbn, r[1]): k for k, r in enumerate(mine, 1)})
        return out

    def frame_of(items):
        return spark.createDataFrame(items, schema)

    now = [r for r in rows if r[3] is not None and r[3] < D(2001, 1, 20) and r[1] % 5]
    queue = frame_of([]).withColumn("QueuePosition", F.lit(1).cast("bigint"))
    counts = member.queue_counts(frame_of([]))
    queue, counts = member.change_queue(queue, counts, frame_of(now), num_partitions=4)
    steps = [([r for r in rows if r[3] is not None and D(2001, 1, 20) <= r[3] < D(2001, 2, 1) and r[1] % 5], []),
             ([r for r in rows if r[3] is None or (r[3] >= D(2001, 2, 1) and r[1] % 5)], now[::7]),
             ([r for r in rows if r[3] is not None and r[1] % 5 == 0 and r[0] != "b2"], [])]  # late ones, of earlier days
    for new, gone in steps:
        away = spark.createDataFrame([(r[0], r[1]) for r in gone], "ISBN string, ReservationID int") if gone else None
        queue, counts = member.change_queue(queue, counts, frame_of(new), away, num_partitions=4)
        now = [r for r in now if r not in gone] + new
        got = {(r.ISBN, r.ReservationID): r.QueuePosition for r in queue.collect()}
        assert got == full(now)
        assert sum(r.n for r in counts.collect()) == len(now)


def test_only_changed_days_are_numbered_again(spark, monkeypatch):
    rows = [("hot", i, 1, D(2001, 1, 1) + dt.timedelta(days=i // 100)) for i in range(1000)]
    items = spark.createDataFrame(rows, "ISBN string, ReservationID int, UserID int, ReservationDate date")
    queue = items.withColumn("QueuePosition", F.col("ReservationID").cast("bigint") + 1)
    seen = []
    old = member.sequence_numbers
    monkeypatch.setattr(member, "sequence_numbers", lambda df, **k: seen.append(df.count()) or old(df, **k))
    new = spark.createDataFrame([("hot", 1000, 1, D(2001, 1, 10)), ("hot", 1001, 1, D(2001, 1, 11)), ("b", 1002, 1, None)], items.schema)
    got, _ = member.change_queue(queue, member.queue_counts(items), new)
    places = {r.ReservationID: r.QueuePosition for r in got.collect()}
    assert places == {**{i: i + 1 for i in range(1002)}, 1002: 1} and seen == [103]


# --------------------------------------------------------- checksums by range
def test_drift_by_checksums_equals_the_plain_join(spark, monkeypatch):
    from circula.operators import reconcile
    loans = [(i, 1, D(2001, 1, 1), None, None, Decimal(i % 5)) for i in range(2000)]
    fines = [(i * 2 + k, i, 1, D(2001, 1, 1), Decimal(i % 5) / 2 if i not in (70, 71, 1500) else Decimal(9), "Paid", None)
             for i in range(2000) for k in (0, 1)]
    fines += [(9000, None, 1, None, Decimal(3), "Unpaid", None), (9001, 5000, 1, None, Decimal(1), "Unpaid", None),
              (9002, 300, 1, None, Decimal(-1), "Unpaid", None), (9003, 301, 1, None, Decimal(1), "Paid", None),
              (9004, 302, 1, None, Decimal(0), "Unpaid", None), (9005, 303, 1, None, None, "Paid", None)]
    payments = [(k, f[0], D(2001, 1, 2), f[4], "Cash") for k, f in enumerate(fines) if f[5] == "Paid" and f[4] is not None and k % 997]
    t = {"loan": frame(spark, "loan", loans), "payment": frame(spark, "payment", payments),
         "fine": spark.createDataFrame(fines, "FineID int, LoanID int, UserID int, IssueDate date, Amount decimal(8,2), Status string, Description string")}
    # 300 is one too low and 301 one too high: plain sums over the range would not see it
    for check in (reconcile.fine_amount_drift, reconcile.fine_settlement_drift):
        want = sorted(check(t).collect(), key=str)
        assert want and sorted(check(t, range_size=32).collect(), key=str) == want
    kept = []
    old = reconcile.in_ranges
    monkeypatch.setattr(reconcile, "in_ranges", lambda rows, *a: kept.append(old(rows, *a).count()) or old(rows, *a))
    reconcile.fine_amount_drift(t, range_size=32)
    assert kept[0] <= 32 * 6 and kept[1] <= 64 * 6 + 10  # of 2000 loans and 4006 fines


def test_ranges_that_agree_are_not_joined(spark):
    from circula.operators import reconcile
    loans = [(i, 1, D(2001, 1, 1), None, None, Decimal(i % 5)) for i in range(500)]
    fines = [(i, i, 1, D(2001, 1, 1), Decimal(i % 5), "Unpaid", None) for i in range(500)]
    t = {"loan": frame(spark, "loan", loans), "fine": frame(spark, "fine", fines)}
    same = reconcile.differing_ranges(reconcile.range_checksums(t["loan"], "LoanID", F.col("FineAmount"), 50),
                                      reconcile.range_checksums(t["fine"], "LoanID", F.col("Amount"), 50))
    assert same.count() == 0 and reconcile.fine_amount_drift(t, range_size=50).count() == 0


def test_queue_change_joins_the_queue_once(spark):
    from circula.operators import member
    rows = [(str(i % 3), i, i, dt.date(2001, 1, 1 + i % 9)) for i in range(40)]
    items = spark.createDataFrame(rows, "ISBN string, ReservationID int, UserID int, ReservationDate date")
    old, new = items.filter("ReservationID < 30"), items.filter("ReservationID >= 30")
    order = ["ReservationDate", "ReservationID"]
    queue = member.sequence_numbers(old, order, ["ISBN"], "QueuePosition")
    got, _ = member.change_queue(queue, member.queue_counts(old), new)
    # joins left when the result is read: of numbers, of day counts and of places; the queue was joined once, for all who read it
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    want = member.sequence_numbers(items, order, ["ISBN"], "QueuePosition")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
