"""The plan properties the design relies on, read from Spark's own plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from circula.operators import quality
from circula.plans.catalog import BUILDERS
from circula.schema import TABLES
from circula.sources.fixtures import Fixtures
from circula.sources.stored import StoredTables, materialize
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    materialize(spark, SF_SMALL, root)
    return StoredTables(spark, root, SF_SMALL)


def plan_of(spark, df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_catalogue_filters_reach_the_scan(spark, stored):
    plan = plan_of(spark, BUILDERS["l10_browse_catalog"](stored, spark))
    assert re.search(r"PushedFilters: \[.*EqualTo\(Genre,MEDIUM\)", plan)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(PublicationYear,1960\)", plan)
    # only the needed columns are read from the book table
    assert "ReadSchema: struct<ISBN:string,Title:string,PublicationYear:int,Genre:string,Status:string>" in plan


def test_revenue_period_reaches_the_scan(spark, stored):
    plan = plan_of(spark, BUILDERS["a7_monthly_revenue_period"](stored, spark))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(PaymentDate,2001-01-01\)", plan)


def test_open_loan_predicates_reach_the_scan(spark, stored):
    plan = plan_of(spark, BUILDERS["l9_member_list"](stored, spark))
    assert re.search(r"PushedFilters: \[.*IsNull\(ReturnDate\).*LessThanOrEqual\(CheckoutDate,2001-07-26\)", plan)


def test_recent_list_takes_top_k_before_enrichment(spark, stored):
    df = BUILDERS["l5_recent_transactions"](stored, spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the ten rows are a checkpoint, and the names and titles are cut to their keys by broadcasts
    assert "Scan ExistingRDD" in plan and "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan and "loan_item" not in plan


@pytest.mark.parametrize("name", ["u6_reading_history", "u7_recommend_books"])
def test_per_member_top_k_is_a_partial_group_limit(spark, stored, name):
    plan = plan_of(spark, BUILDERS[name](stored, spark))
    assert plan.count("WindowGroupLimit") >= 2  # partial (before shuffle) and final


@pytest.mark.parametrize("name", ["l5_recent_transactions", "l9_member_list", "p6_overdue_loans", "u3_waiting_list",
                                  "u7_recommend_books", "t1_issue_loans", "q10_split_valid", "r1_delete_users",
                                  "a7_monthly_revenue", "c2_fine_settlement_drift"])
def test_no_cross_or_nested_loop_joins(spark, stored, name):
    plan = plan_of(spark, BUILDERS[name](stored, spark))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


BATCH_QUERIES = sorted(n for n in BUILDERS if not n.startswith(("w1_", "w2_", "s1_", "s2_")))


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_query_plans_a_cross_join(spark, stored, name):
    df = BUILDERS[name](stored, spark)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_date_partitioned_store_prunes_by_the_operators_own_predicates(spark, tmp_path):
    root = str(tmp_path / "bydate")
    materialize(spark, SF_SMALL, root, names=("loan", "loan_item", "payment", "processed_by"), by_date=True)
    t = StoredTables(spark, root, SF_SMALL)
    l1 = plan_of(spark, BUILDERS["l1_checked_out_on"](t, spark))
    assert re.search(r"PartitionFilters: \[.*\(CheckoutDate#\d+ = 2001-07-26\)", l1)
    a7 = plan_of(spark, BUILDERS["a7_monthly_revenue_period"](t, spark))
    assert re.search(r"PartitionFilters: \[.*PaymentDate#\d+ >= 2001-01-01", a7)
    a3 = plan_of(spark, BUILDERS["a3_books_added_this_month"](t, spark))
    assert "PartitionFilters: [isnotnull(ActionDate" in a3
    # same answers as the plain layout
    plain_root = str(tmp_path / "plain")
    materialize(spark, SF_SMALL, plain_root, names=("loan", "loan_item", "payment", "processed_by"))
    plain = StoredTables(spark, plain_root, SF_SMALL)
    for name in ("l1_checked_out_on", "a7_monthly_revenue_period", "a3_books_added_this_month"):
        a, b = BUILDERS[name](t, spark), BUILDERS[name](plain, spark)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _without_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    return old


def _restored(spark, old):
    for n, value in old.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@pytest.mark.parametrize("dealt", [False, True])  # parents that are dealt out by the key already, too
def test_foreign_key_joins_are_not_merged_into_few_tasks(spark, dealt):
    """Keys shrink to little on the way; merged by their bytes, one task would sort ten million."""
    loans = spark.range(3000).selectExpr("cast(id as int) LoanID")
    if dealt:
        loans = loans.groupBy("LoanID").agg(F.count(F.lit(1)).alias("n"))
    items = spark.range(4000).selectExpr("cast(nullif(id, 3999) as int) LoanID", "cast(id % 7 as string) ISBN")
    fk = next(f for f in TABLES["loan_item"].foreign_keys if f.parent == "loan")
    old = _without_broadcast(spark)
    try:
        found = quality.check_foreign_key(items, loans, "loan_item", fk).withColumn("task", F.spark_partition_id()).collect()
    finally:
        _restored(spark, old)
    assert sorted(r.row_key for r in found) == sorted(f"{i}|{i % 7}" for i in range(3000, 3999))
    assert len({r.task for r in found}) > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["raw_loan_item", "reservation_item"])
def test_item_rows_are_not_sorted(spark, name):
    old = _without_broadcast(spark)
    try:
        df = getattr(Fixtures(spark, SF_SMALL), f"_{name}")()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        _restored(spark, old)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
