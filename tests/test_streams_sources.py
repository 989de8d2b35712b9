"""Streams equal their batch counterparts; sources and reports round-trip."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from circula.operators.circulation import fold_circulation
from circula.sources.fixtures import Fixtures
from circula.sources.reports import read_report_rows, write_report
from circula.sources.tables import load_table, write_table
from circula.streaming.circulation_stream import (compact, current_loans, rejected_events,
                                                  stream_circulation)
from circula.streaming.daily_counts import read_daily_counts, stream_daily_counts
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_SMALL)


def test_w1_daily_counts_equal_batch(spark):
    base = tempfile.mkdtemp(prefix="w1-")
    # three files written in time order, so the stream runs three
    # micro-batches and no event is behind the watermark
    src = f"{base}/src"
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for lo, hi in [(1, 11), (11, 21), (21, 32)]:
        day = F.dayofmonth("ts")
        ev.filter((day >= lo) & (day < hi)).coalesce(1).write.mode("append").parquet(src)
    stream_daily_counts(spark, src, f"{base}/sink", f"{base}/ck", delay="3 days", max_files_per_trigger=1)
    got = read_daily_counts(spark, f"{base}/sink")
    want = (spark.read.parquet(f"{SF_SMALL}/events.parquet")
            .groupBy(F.col("ts").cast("date").alias("Day"), F.col("event_type").alias("Kind"))
            .agg(F.count(F.lit(1)).alias("Events")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_w2_stream_equals_batch_fold(spark, fx):
    base = tempfile.mkdtemp(prefix="w2-")
    fx["circulation_event"].repartition(4, "Seq").write.parquet(f"{base}/src")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"], max_files_per_trigger=1)
    got = current_loans(spark, f"{base}/state")
    want, _ = fold_circulation(fx["circulation_event"], fx["policy"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_w2_unfinished_batches_are_not_read_and_compaction_keeps_the_loans(spark, fx):
    base = tempfile.mkdtemp(prefix="w2c-")
    fx["circulation_event"].repartition(3, "Seq").write.parquet(f"{base}/src")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"], max_files_per_trigger=1)
    want = sorted(current_loans(spark, f"{base}/state").collect())
    half = f"{base}/state/loans/batch=99"
    spark.read.parquet(f"{base}/state/loans/batch=0").withColumn("Renewals", F.lit(77).cast("bigint")).write.parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert sorted(current_loans(spark, f"{base}/state").collect()) == want
    compact(spark, f"{base}/state")
    assert sorted(current_loans(spark, f"{base}/state").collect()) == want


def test_w2_null_keys_go_to_the_rejects(spark, fx):
    base = tempfile.mkdtemp(prefix="w2n-")
    rows = [(1, 7, "ISSUE", dt.date(2001, 7, 1), 1), (None, 8, "ISSUE", dt.date(2001, 7, 1), 1),
            (2, None, "ISSUE", dt.date(2001, 7, 2), 1), (1, None, "RENEW", dt.date(2001, 7, 3), None),
            (3, 1, "RETURN", dt.date(2001, 7, 3), 2), (1, 7, "RENEW", None, 5)]
    ev = spark.createDataFrame(rows, "LoanID int, UserID int, Kind string, EventDate date, Seq int")
    ev.coalesce(1).write.parquet(f"{base}/src")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"])
    loans, rejects = fold_circulation(ev, fx["policy"])
    got = sorted(current_loans(spark, f"{base}/state").collect())
    assert got == sorted(loans.collect()) and [r.LoanID for r in got] == [1, 2] and got[0].Renewals == 1
    assert [r.UserID for r in rejected_events(spark, f"{base}/state").collect()] == [8]
    assert sorted((r.LoanID or 0, r.Reason) for r in rejects.collect()) == [(0, "no LoanID"), (3, "no ISSUE event")]


def test_fold_reads_its_events_once(spark, fx):
    plan = spark._jvm.PythonSQLUtils.explainString(
        fold_circulation(fx["circulation_event"].repartition(3), fx["policy"])[0]._jdf.queryExecution(), "simple")
    assert plan.count("hashpartitioning(LoanID") == 1


def test_csv_load_keeps_bad_rows_aside(spark):
    base = tempfile.mkdtemp(prefix="s1-")
    with open(f"{base}/loan.csv", "w") as fh:
        fh.write("LoanID,UserID,CheckoutDate,DueDate,ReturnDate,FineAmount\n")
        fh.write("1,2,2001-07-01,2001-07-15,,0.00\n")
        fh.write("x,2,2001-07-01,2001-07-15,,0.00\n")
    df = load_table(spark, "loan", base, fmt="csv").cache()
    rows = {r.LoanID: r for r in df.collect()}
    assert rows[1].CheckoutDate == dt.date(2001, 7, 1) and rows[1]._corrupt_record is None
    assert rows[None]._corrupt_record.startswith("x,2")


def test_csv_columns_are_taken_by_name(spark):
    base = tempfile.mkdtemp(prefix="s1h-")
    with open(f"{base}/loan.csv", "w") as fh:
        fh.write("UserID,Extra,LoanID\n2,z,1\n5,z\n")
    df = load_table(spark, "loan", base, fmt="csv")
    assert df.columns == ["LoanID", "UserID", "_corrupt_record"]
    rows = sorted(df.collect(), key=lambda r: r.UserID)
    assert (rows[0].LoanID, rows[0].UserID, rows[0]._corrupt_record) == (1, 2, None)
    assert rows[1]._corrupt_record is not None
    from circula.operators.quality import apply_defaults
    full = apply_defaults(df, "loan", "2001-07-26").filter("_corrupt_record is null").first()
    assert full.CheckoutDate == dt.date(2001, 7, 26) or full.CheckoutDate is None


def test_parquet_round_trip_with_declared_types(spark, fx):
    base = tempfile.mkdtemp(prefix="s1p-")
    write_table(fx["fine"], f"{base}/fine")
    df = load_table(spark, "fine", f"{base}/fine")
    assert dict(df.dtypes)["Amount"] == "decimal(8,2)"
    assert df.count() == fx["fine"].count()


def test_report_sink_stores_any_size_in_parts(spark, fx):
    base = tempfile.mkdtemp(prefix="s2-")
    small = fx["payment"].groupBy("PaymentMethod").agg(F.count(F.lit(1)).alias("n"))
    r1 = write_report(small, "Payments by method", 2, "2001-07-26", f"{base}/report").first()
    r2 = write_report(fx["fine"].select("FineID", "Amount", "Status"), "Fines", None, "2001-07-26", f"{base}/report",
                      part_rows=7).first()
    assert (r1.ReportID, r2.ReportID) == (1, 2)
    n = fx["fine"].count()
    assert json.loads(r2.Content)["rows"] == n and json.loads(r2.Content)["parts"] == -(-n // 7)
    got = read_report_rows(spark, f"{base}/report", 2, "FineID: int, Amount: decimal(8,2), Status: string")
    assert sorted(got.collect()) == sorted(fx["fine"].select("FineID", "Amount", "Status").collect())
    sizes = [r.RowCount for r in spark.read.parquet(json.loads(r2.Content)["place"]).collect()]
    assert max(sizes) == 7 and sum(sizes) == n
    r3 = write_report(small.limit(0), "Nothing", 2, "2001-07-26", f"{base}/report").first()
    assert json.loads(r3.Content)["rows"] == 0
    assert read_report_rows(spark, f"{base}/report", 3, "PaymentMethod: string, n: bigint").count() == 0


def test_bucketed_store_joins_loans_without_shuffle(spark, tmp_path):
    from circula.operators.policy import open_books_per_user
    from circula.sources.stored import StoredTables, materialize
    materialize(spark, SF_SMALL, str(tmp_path), names=("loan", "loan_item"), buckets=4, database="bucket_test")
    t = StoredTables(spark, str(tmp_path), bucketed=True, database="bucket_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = open_books_per_user(t, "2001-07-26")
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "SortMergeJoin" in plan
        assert "hashpartitioning(LoanID" not in plan
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_w2_stream_equals_batch_fold_out_of_order(spark, fx):
    base = tempfile.mkdtemp(prefix="w2s-")
    ev = fx["circulation_event"]
    # RETURN and RENEW events arrive before ISSUE, plus a repeated batch of ISSUEs
    for part in (ev.filter("Kind = 'RETURN'"), ev.filter("Kind = 'RENEW'"), ev.filter("Kind = 'ISSUE'"),
                 ev.filter("Kind = 'ISSUE' AND LoanID % 3 = 0")):
        part.coalesce(1).write.mode("append").parquet(f"{base}/src")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"], max_files_per_trigger=1)
    got = current_loans(spark, f"{base}/state")
    want, _ = fold_circulation(ev, fx["policy"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_w2_stream_resumes_after_restart(spark, fx):
    base = tempfile.mkdtemp(prefix="w2r-")
    ev = fx["circulation_event"]
    ev.filter("Kind = 'ISSUE'").coalesce(1).write.mode("append").parquet(f"{base}/src")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"])
    # the query stops; later events arrive and the query is started again
    ev.filter("Kind <> 'ISSUE'").coalesce(1).write.mode("append").parquet(f"{base}/src")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"])
    got = current_loans(spark, f"{base}/state")
    want, _ = fold_circulation(ev, fx["policy"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_w1_upsert_replaces_counts_of_days_seen_again(spark):
    base = tempfile.mkdtemp(prefix="w1u-")
    src = f"{base}/src"
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # two micro-batches that both hold every day: the second re-emits each
    # (day, kind) with its running total, which must replace the first
    ev.filter(F.col("event_id") % 2 == 0).coalesce(1).write.mode("append").parquet(src)
    ev.filter(F.col("event_id") % 2 == 1).coalesce(1).write.mode("append").parquet(src)
    stream_daily_counts(spark, src, f"{base}/sink", f"{base}/ck", delay="40 days", max_files_per_trigger=1)
    got = read_daily_counts(spark, f"{base}/sink")
    want = (ev.groupBy(F.col("ts").cast("date").alias("Day"), F.col("event_type").alias("Kind"))
            .agg(F.count(F.lit(1)).alias("Events")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_w1_drops_an_event_behind_the_watermark(spark):
    """Spark drops rows behind the watermark the previous micro-batch set;
    events inside the delay always count."""
    base = tempfile.mkdtemp(prefix="w1l-")
    src = f"{base}/src"
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    batches = [
        [(1, dt.datetime(2024, 1, 20, 10), 1, "view", 1.0, "{}"), (2, dt.datetime(2024, 1, 21, 10), 1, "view", 1.0, "{}")],
        [(3, dt.datetime(2024, 1, 22, 10), 1, "view", 1.0, "{}")],
        [(4, dt.datetime(2024, 1, 2, 10), 1, "view", 1.0, "{}"),      # far behind the watermark
         (5, dt.datetime(2024, 1, 21, 11), 1, "view", 1.0, "{}")],    # inside the delay
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream_daily_counts(spark, src, f"{base}/sink", f"{base}/ck", delay="1 day", max_files_per_trigger=1)
    got = {(r.Day, r.Kind): r.Events for r in read_daily_counts(spark, f"{base}/sink").collect()}
    assert got == {(dt.date(2024, 1, 20), "view"): 1, (dt.date(2024, 1, 21), "view"): 2,
                   (dt.date(2024, 1, 22), "view"): 1}


def test_bench_prints_one_json_line(tmp_path):
    import json
    import os
    import subprocess
    import sys
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py"), "a7_monthly_revenue", "l4_pending_fines"],
                         capture_output=True, text=True, env=env, timeout=900, check=True).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"a7_monthly_revenue", "l4_pending_fines"}
    assert rec["value"] == pytest.approx(sum(rec["queries"].values()), abs=1e-2) and rec["sf"] == 0.001


LOANS = "LoanID int, UserID int, Kind string, EventDate date, Seq int"


def three_batches(spark, fx, base):
    for k in (1, 2, 3):
        spark.createDataFrame([(k, k, "ISSUE", dt.date(2001, 7, k), 1), (1, 1, "RENEW", dt.date(2001, 7, k), k)],
                              LOANS).coalesce(1).write.mode("append").parquet(f"{base}/src")
        stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"])


def loan_rows(spark, base):
    return sorted((r.LoanID, r.Renewals) for r in current_loans(spark, f"{base}/state").collect())


def replay(spark, fx, base):
    """As after a stop between the sink's write and Spark's commit of the newest batch."""
    commits = f"{base}/ck/loans/commits"
    newest = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for name in (newest, f".{newest}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"])


def test_w2_replay_after_compaction_keeps_the_loans(spark, fx):
    base = tempfile.mkdtemp(prefix="w2k-")
    three_batches(spark, fx, base)
    want = [(1, 3), (2, 0), (3, 0)]
    assert loan_rows(spark, base) == want
    compact(spark, f"{base}/state")
    assert loan_rows(spark, base) == want
    assert os.listdir(f"{base}/state/snapshots") == ["upto=1"]
    assert [d for d in os.listdir(f"{base}/state/loans") if d.startswith("batch=")] == ["batch=2"]
    replay(spark, fx, base)
    assert loan_rows(spark, base) == want
    compact(spark, f"{base}/state")
    replay(spark, fx, base)
    assert loan_rows(spark, base) == want
    # and the stream goes on
    spark.createDataFrame([(2, 2, "RETURN", dt.date(2001, 7, 9), 1)], LOANS).write.mode("append").parquet(f"{base}/src")
    stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"])
    compact(spark, f"{base}/state")
    assert loan_rows(spark, base) == want
    assert os.listdir(f"{base}/state/snapshots") == ["upto=2"]


@pytest.mark.parametrize("step", range(5))
def test_w2_compaction_may_stop_anywhere(spark, fx, monkeypatch, step):
    """A stop before any of its writes, renames and deletes, and a next call that ends the work."""
    from circula.streaming import circulation_stream as C
    base = tempfile.mkdtemp(prefix="w2x-")
    three_batches(spark, fx, base)
    want = loan_rows(spark, base)
    left = [step]

    def counted(fn):
        def run(*args):
            if left[0] == 0:
                raise KeyboardInterrupt
            left[0] -= 1
            return fn(*args)
        return run

    with monkeypatch.context() as m:
        m.setattr(C, "rename_path", counted(C.rename_path))
        m.setattr(C, "delete_path", counted(C.delete_path))
        if step < 3:  # a rename and two deletes
            with pytest.raises(KeyboardInterrupt):
                compact(spark, f"{base}/state")
        else:
            compact(spark, f"{base}/state")
    assert loan_rows(spark, base) == want
    if step == 4:  # a snapshot that was being written
        os.makedirs(f"{base}/state/snapshots/making=9")
    compact(spark, f"{base}/state")
    assert loan_rows(spark, base) == want
    assert os.listdir(f"{base}/state/snapshots") == ["upto=1"]


def test_w2_returns_both_handles(spark, fx):
    base = tempfile.mkdtemp(prefix="w2h-")
    spark.createDataFrame([(1, 1, "ISSUE", dt.date(2001, 7, 1), 1), (None, 5, "ISSUE", None, 1)], LOANS).write.parquet(f"{base}/src")
    running = stream_circulation(spark, f"{base}/src", f"{base}/state", f"{base}/ck", fx["policy"], available_now=False)
    assert running.isActive
    running.processAllAvailable()
    running.stop()
    assert not running.isActive and not any(q.isActive for q in running.queries)
    assert loan_rows(spark, base) == [(1, 0)] and rejected_events(spark, f"{base}/state").count() == 1


def test_w1_null_kinds_redelivered_events_and_null_times(spark):
    from circula.streaming.daily_counts import read_rejects
    base = tempfile.mkdtemp(prefix="w1n-")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    at = lambda h, d=20: dt.datetime(2024, 1, d, h)
    batches = [[(1, at(1), 1, None, 1.0, "{}"), (2, at(2), 1, "view", 1.0, "{}"), (2, at(2), 1, "view", 1.0, "{}"),
                (None, at(3), 1, "view", 1.0, "a"), (None, at(3), 1, "view", 1.0, "b")],
               [(1, at(1), 1, None, 1.0, "{}"), (3, at(4), 1, None, 1.0, "{}"), (4, None, 1, "view", 1.0, "{}"),
                (None, at(3), 1, "view", 1.0, "b")],
               [(3, at(4), 1, None, 1.0, "{}"), (5, at(5, 21), 1, None, 1.0, "{}"), (6, None, 2, None, None, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
        stream_daily_counts(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", delay="1 day")
    got = sorted((str(r.Day), r.Kind or "", r.Events) for r in read_daily_counts(spark, f"{base}/sink").collect())
    assert got == [("2024-01-20", "", 2), ("2024-01-20", "view", 3), ("2024-01-21", "", 1)]
    assert sorted(r.event_id for r in read_rejects(spark, f"{base}/sink").collect()) == [4, 6]
    assert read_rejects(spark, f"{base}/nothing").count() == 0


def test_csv_files_hold_few_rows(spark, tmp_path, monkeypatch):
    """A CSV file is read by one task, so even one task's rows are written as several files."""
    from circula.sources import tables
    monkeypatch.setattr(tables, "FILE_ROWS", 10, raising=False)
    rows = spark.range(0, 45, 1, 1).selectExpr("cast(id as int) ReportID", "cast(null as int) GeneratedBy",
                                               "date'2001-01-01' GenerationDate", "'a' Type", "'b\nc' Content")
    tables.write_table(rows, f"{tmp_path}/r", fmt="csv")
    assert len(list((tmp_path / "r").glob("part-*.csv"))) == 5
    back = tables.load_table(spark, "report", f"{tmp_path}/r", fmt="csv")
    assert sorted(map(tuple, back.drop("_corrupt_record").collect())) == sorted(map(tuple, rows.collect()))
