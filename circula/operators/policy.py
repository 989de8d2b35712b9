"""Policy computations P1-P6: due dates, loan status, fines, allowance, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.functions.common import (MONEY, Policy, as_date, is_open_loan,
                                      read_policy)


def due_dates(loans: DataFrame, policy) -> DataFrame:
    """DueDate if set, else CheckoutDate + LoanPeriodDays."""
    p = read_policy(policy)
    return loans.withColumn(
        "DueDate", F.coalesce(F.col("DueDate"),
                              F.date_add(F.col("CheckoutDate"), F.lit(p.loan_period_days))))


def status_label(as_of) -> F.Column:
    """P2 label: Returned / On Time / Due Today / Overdue; null for an open
    loan without a DueDate (resolve it with P1 first)."""
    d = as_date(as_of)
    returned = F.col("ReturnDate").isNotNull() & (F.col("ReturnDate") <= d)
    return (F.when(returned, F.lit("Returned"))
            .when(F.col("DueDate") > d, F.lit("On Time"))
            .when(F.col("DueDate") == d, F.lit("Due Today"))
            .when(F.col("DueDate") < d, F.lit("Overdue")))


def loan_status(loans: DataFrame, as_of, policy=None) -> DataFrame:
    """Label every loan; an unset DueDate is resolved with P1 first."""
    if policy is not None:
        loans = due_dates(loans, policy)
    return loans.withColumn("LoanStatus", status_label(as_of))


def _billing(p: Policy, as_of):
    end = F.coalesce(F.col("ReturnDate"), as_date(as_of))
    days_late = F.datediff(end, F.col("DueDate"))
    billable = F.greatest(days_late - F.lit(p.grace_period_days), F.lit(0))
    amount = (billable * p.rate()).cast(MONEY)
    return end, days_late, billable, amount


def assess_fines(t: dict, policy, as_of) -> DataFrame:
    """One fine per late loan (grace days never billed).

    Amount = max(days late - grace, 0) x rate as DECIMAL(8,2); only rows with a
    billable day are returned.
    """
    p = read_policy(policy)
    loans = due_dates(t["loan"].filter(F.col("CheckoutDate") <= as_date(as_of)), p)
    end, days_late, billable, amount = _billing(p, as_of)
    return (loans.select("LoanID", "UserID", end.alias("IssueDate"),
                         days_late.alias("DaysLate"), billable.alias("BillableDays"),
                         amount.alias("Amount"))
            .filter(F.col("BillableDays") > 0))


def open_books_per_user(t: dict, as_of) -> DataFrame:
    """Books (LoanItem rows) on open loans, pre-aggregated per user."""
    open_loans = t["loan"].filter(is_open_loan(as_of)).select("LoanID", "UserID")
    return (t["loan_item"].select("LoanID")
            .join(open_loans, "LoanID")
            .groupBy("UserID").agg(F.count(F.lit(1)).alias("OpenBooks")))


def allowance(t: dict, policy, as_of) -> DataFrame:
    """Per user open books, MaxBooks, remaining and over-limit flag."""
    p = read_policy(policy)
    open_books = open_books_per_user(t, as_of)
    n = F.coalesce(F.col("OpenBooks"), F.lit(0)).cast("bigint")
    return (t["library_user"].select("UserID")
            .join(open_books, "UserID", "left")
            .select("UserID", n.alias("OpenBooks"),
                    F.lit(p.max_books).alias("MaxBooks"),
                    F.greatest(F.lit(p.max_books) - n, F.lit(0)).cast("bigint").alias("Remaining"),
                    (n > F.lit(p.max_books)).alias("OverLimit")))


def expire_reservations(t: dict, as_of) -> DataFrame:
    """P5: 'Active' reservations past their ExpiryDate become 'Expired'."""
    stale = (F.col("Status") == "Active") & (F.col("ExpiryDate") < as_date(as_of))
    return t["reservation"].withColumn(
        "Status", F.when(stale, F.lit("Expired")).otherwise(F.col("Status")))


def overdue_loans(t: dict, policy, as_of) -> DataFrame:
    """Open loan items past due, with member, title, days late and the
    fine accrued so far (P3 rule); worst first."""
    p = read_policy(policy)
    d = as_date(as_of)
    loans = due_dates(t["loan"].filter(is_open_loan(as_of)), p).filter(F.col("DueDate") < d)
    _, days_late, _, amount = _billing(p, as_of)
    late = loans.select("LoanID", "UserID", "CheckoutDate", "DueDate",
                        days_late.alias("DaysLate"), amount.alias("AccruedFine"))
    users = t["library_user"].select("UserID", F.col("Name").alias("Member"))
    books = t["book"].select("ISBN", "Title")
    return (late.join(t["loan_item"].select("LoanID", "ISBN"), "LoanID")
            .join(users, "UserID", "left")
            .join(books, "ISBN", "left")
            .select("LoanID", "UserID", "Member", "ISBN", "Title", "CheckoutDate",
                    "DueDate", "DaysLate", "AccruedFine")
            .orderBy(F.col("DaysLate").desc(), "LoanID", "ISBN"))
