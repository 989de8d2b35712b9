"""Circulation batch jobs: deciding loan requests (T1) and folding
ISSUE / RENEW / RETURN events into Loan rows (T2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.functions.common import read_policy
from circula.operators.policy import open_books_per_user
from circula.operators.ranking import top_k_per_group
from circula.session import ensure_checkpoint_dir

# Rejection reasons, in the order they are tested.
UNKNOWN_USER = "unknown user"
ACCOUNT_NOT_ACTIVE = "account not active"
UNKNOWN_BOOK = "unknown book"
BOOK_NOT_AVAILABLE = "book not available"
BOOK_TAKEN = "book taken by an earlier request"
OVER_LIMIT = "over loan limit"


def issue_loans(t: dict, requests: DataFrame, policy, as_of) -> DataFrame:
    """Decide a batch of (RequestID, UserID, ISBN, RequestDate).

    The first failing rule is the reason.  A book goes to its lowest eligible
    RequestID before limits are applied (no second round); then a request is
    accepted when ``open books + its rank among the user's remaining requests
    <= MaxBooks``.  Accepted rows get DueDate = RequestDate + LoanPeriodDays.

    Plan: the per-book winner is a ``min`` aggregate (combined map-side)
    joined back on the unique RequestID, and the per-user rank is a
    top-MaxBooks window (partial WindowGroupLimit before the shuffle), so
    neither a popular book nor a busy member is ranked in one task; the
    plain key joins to members and books leave hot keys to AQE's skew-join
    splitting.
    """
    p = read_policy(policy)
    ensure_checkpoint_dir(requests.sparkSession)
    users = t["library_user"].select("UserID", "AccountStatus", F.lit(True).alias("_user"))
    books = t["book"].select("ISBN", F.col("Status").alias("_book_status"), F.lit(True).alias("_book"))
    r = (requests.select("RequestID", "UserID", "ISBN", "RequestDate")
         .join(users, "UserID", "left").join(books, "ISBN", "left"))
    reason = (F.when(F.col("_user").isNull(), F.lit(UNKNOWN_USER))
              .when(~F.coalesce(F.col("AccountStatus") == "Active", F.lit(False)), F.lit(ACCOUNT_NOT_ACTIVE))
              .when(F.col("_book").isNull(), F.lit(UNKNOWN_BOOK))
              .when(~F.coalesce(F.col("_book_status") == "Available", F.lit(False)), F.lit(BOOK_NOT_AVAILABLE)))
    # Checkpointed (into spark.checkpoint.dir): the decisions below read this
    # first stage three times and must all see the same rows.
    r = r.select("RequestID", "UserID", "ISBN", "RequestDate", reason.alias("Reason")).checkpoint(eager=True)

    winners = (r.filter(F.col("Reason").isNull()).groupBy("ISBN")
               .agg(F.min("RequestID").alias("RequestID"))
               .select("RequestID", F.lit(True).alias("_won")))
    r = r.join(winners, "RequestID", "left").withColumn(
        "Reason", F.coalesce("Reason", F.when(F.col("_won").isNull(), F.lit(BOOK_TAKEN)))).drop("_won")

    # MaxBooks 0 is a legal policy: nothing is accepted then
    standing = r.filter(F.col("Reason").isNull() & F.lit(p.max_books > 0)).select(
        "RequestID", "UserID", "RequestDate")
    ranked = top_k_per_group(standing, ["UserID"], ["RequestDate", "RequestID"], max(1, p.max_books), "_urank")
    # open books of the requesters only
    requesters = t["loan"].join(standing.select("UserID").distinct(), "UserID", "left_semi")
    ok = (ranked.join(open_books_per_user({"loan": requesters, "loan_item": t["loan_item"]}, as_of), "UserID", "left")
          .filter(F.coalesce("OpenBooks", F.lit(0)) + F.col("_urank") <= F.lit(p.max_books))
          .select("RequestID", F.lit(True).alias("_ok")))
    r = r.join(ok, "RequestID", "left").withColumn(
        "Reason", F.coalesce("Reason", F.when(F.col("_ok").isNull(), F.lit(OVER_LIMIT))))
    accepted = F.col("Reason").isNull()
    return r.select(
        "RequestID", "UserID", "ISBN", "RequestDate",
        F.when(accepted, F.lit("accepted")).otherwise(F.lit("rejected")).alias("Decision"),
        "Reason",
        F.when(accepted, F.date_add("RequestDate", F.lit(p.loan_period_days))).alias("DueDate"))


def loan_facts(events: DataFrame) -> DataFrame:
    """One aggregation per LoanID over dated events: UserID and CheckoutDate
    of the earliest ISSUE (then lowest Seq and UserID), the earliest RETURN, and
    the distinct RENEWs not after it.  Repeated events (same Kind and Seq)
    count once, by their earliest date, so a renewal counts if any of its
    dates is not after the return.  Works on a batch and as a streaming
    aggregation: the state is one row per loan."""
    kind = F.col("Kind")
    facts = events.filter(F.col("EventDate").isNotNull()).groupBy("LoanID").agg(
        F.min(F.when(kind == "ISSUE", F.struct("EventDate", "Seq", "UserID"))).alias("_issue"),
        F.min(F.when(kind == "RETURN", F.col("EventDate"))).alias("ReturnDate"),
        F.collect_set(F.when(kind == "RENEW", F.struct("Seq", "EventDate"))).alias("_renews"))
    in_time = F.filter("_renews", lambda r: F.col("ReturnDate").isNull() | (r["EventDate"] <= F.col("ReturnDate")))
    return facts.select(
        "LoanID", F.col("_issue.UserID").alias("UserID"), F.col("_issue.EventDate").alias("CheckoutDate"),
        "ReturnDate", F.size(F.array_distinct(F.transform(in_time, lambda r: r["Seq"]))).cast("bigint").alias("Renewals"))


def due_from_facts(facts: DataFrame, policy) -> DataFrame:
    """Loan rows of :func:`loan_facts`, with DueDate; loans without an ISSUE are left out."""
    p = read_policy(policy)
    return facts.filter(F.col("LoanID").isNotNull() & F.col("CheckoutDate").isNotNull()).select(
        "LoanID", "UserID", "CheckoutDate",
        F.date_add("CheckoutDate", (F.lit(p.loan_period_days) * (F.col("Renewals") + 1)).cast("int")).alias("DueDate"),
        "ReturnDate", "Renewals")


def fold_circulation(events: DataFrame, policy) -> tuple[DataFrame, DataFrame]:
    """Events (LoanID, UserID, Kind, EventDate, Seq) -> Loan rows.

    Repeated events (same LoanID, Kind, Seq) count once (earliest date kept).
    CheckoutDate = earliest ISSUE (its UserID is the borrower); ReturnDate =
    earliest RETURN; DueDate = CheckoutDate + LoanPeriodDays x (1 + RENEWs
    not after the return).  Events without a date are ignored.  Everything
    is order-free, so late or replayed events do no harm, and the events are
    read and shuffled once (:func:`loan_facts`).  Loans without an ISSUE go to the reject frame, and so does
    every event without a LoanID, row by row (it never meets the aggregate, where all of them would be one group).

    Returns ``(loans, rejects)``.
    """
    facts = loan_facts(events.filter(F.col("LoanID").isNotNull()))
    unissued = facts.filter(F.col("CheckoutDate").isNull()).select("LoanID", F.lit("no ISSUE event").alias("Reason"))
    lost = events.filter(F.col("LoanID").isNull()).select("LoanID", F.lit("no LoanID").alias("Reason"))
    return due_from_facts(facts, policy), unissued.unionByName(lost)
