"""The figures FIXTURES.md lists for sf0.01 at the as-of date (computed there
in two engines), reproduced by the operators."""

from __future__ import annotations

from decimal import Decimal

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_ORACLE

Q = entry_mod.queries()


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: Q[name](spark, SF_ORACLE)


def test_member_figures(run):
    assert tuple(run("l2_active_members").first()) == (1378, 1)
    assert run("a4_member_totals").first().NewThisMonth == 17


def test_circulation_figures(run):
    assert run("l1_checked_out_on").first()[0] == 11
    assert run("l3_due_today_count").first()[0] == 14
    assert run("u2_due_soon").count() == 10


def test_money_figures(run):
    assert tuple(run("l4_pending_fines").first()) == (Decimal("49834.50"), 1080)
    assert run("a5_total_revenue").first()[0] == Decimal("85862.50")


def test_book_statuses(run):
    got = {r[0]: r[1] for r in run("a8_inventory_report").groupBy("Status").sum("Books").collect()}
    assert got == {"Available": 408, "Borrowed": 731, "Reserved": 845, "Lost": 21}


def test_request_funnel(run):
    reasons = {r[0]: r[1] for r in run("t1_issue_loans").groupBy("Reason").count().collect()}
    eligible = reasons[None] + reasons["book taken by an earlier request"] + reasons["over loan limit"]
    assert (sum(reasons.values()), eligible, reasons[None] + reasons["over loan limit"], reasons[None]) == (1981, 370, 46, 44)


def test_queue_figures(run):
    q = run("u3_waiting_list")
    assert q.agg({"QueuePosition": "max"}).first()[0] == 6
    assert q.filter("QueuePosition > 1").count() == 1262
