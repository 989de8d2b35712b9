"""Reconciliation of facts the schema keeps twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circula.functions.common import MONEY_SUM, as_date, is_active_reservation, is_open_loan
from circula.operators.ranking import spread_join
from circula.session import ensure_checkpoint_dir


#: Weights of a key in a checksum have so many bits; there are two of them.
WEIGHT_BITS = 40


def range_checksums(rows: DataFrame, key: str, amount: Column, size: int) -> DataFrame:
    """``_range`` (``size`` keys each, -1 for null keys) and the amounts' checksums ``_c1`` and ``_c2``.

    A checksum is the sum of cents times a pseudo-random weight of the key.  Sums
    are linear, so a side with several rows for a key has that of its totals, and sides whose totals
    differ for some key agree in both by a chance of about 2**-80."""
    cents = F.coalesce(amount, F.lit(0)).cast("decimal(18,2)") * 100

    def weighted(seed: int) -> Column:
        w = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << WEIGHT_BITS))
        return F.sum((cents.cast("decimal(20,0)") * w.cast("decimal(13,0)")).cast("decimal(33,0)"))

    return rows.groupBy(_range(key, size)).agg(weighted(1).alias("_c1"), weighted(2).alias("_c2"))


def _range(key: str, size: int) -> Column:
    return F.coalesce(F.floor(F.col(key) / size), F.lit(-1)).cast("bigint").alias("_range")


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """``_range`` of the checksums that are not equal; a side without the range has sums of 0."""
    both = left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
    signed = [F.sum(F.col(c) * F.col("_s")).alias(c) for c in ("_c1", "_c2")]
    return both.groupBy("_range").agg(*signed).filter((F.col("_c1") != 0) | (F.col("_c2") != 0)).select("_range")


def in_ranges(rows: DataFrame, key: str, size: int, ranges: DataFrame) -> DataFrame:
    """The rows whose key is in one of the ranges."""
    return spread_join(rows.withColumn("_range", _range(key, size)), ranges, ["_range"], "left_semi").drop("_range")


def fine_amount_drift(t: dict, range_size: int | None = None) -> DataFrame:
    """Loans whose FineAmount differs from the sum of their Fine rows.

    Both sides are one row per LoanID before the full outer join, so fines
    without a loan and loans without fines both show.  With a ``range_size``, checksums by
    ranges of so many LoanIDs are compared first (both sides are aggregated in the tasks that read them), and
    only rows of ranges that disagree are shuffled and joined.
    """
    loan, fine = t["loan"].select("LoanID", "FineAmount"), t["fine"].select("LoanID", "Amount")
    if range_size:
        ensure_checkpoint_dir(loan.sparkSession)
        ranges = differing_ranges(range_checksums(loan, "LoanID", F.col("FineAmount"), range_size),
                                  range_checksums(fine, "LoanID", F.col("Amount"), range_size)).checkpoint(eager=True)
        loan, fine = in_ranges(loan, "LoanID", range_size, ranges), in_ranges(fine, "LoanID", range_size, ranges)
    totals = fine.groupBy("LoanID").agg(F.sum("Amount").alias("_total"))
    j = loan.withColumn("_loan", F.lit(True)).join(totals, "LoanID", "full_outer")
    loan_amt = F.coalesce("FineAmount", F.lit(0)).cast(MONEY_SUM)
    fine_amt = F.coalesce("_total", F.lit(0)).cast(MONEY_SUM)
    return (j.select("LoanID", loan_amt.alias("LoanFineAmount"), fine_amt.alias("FineTotal"),
                     F.col("_loan").isNotNull().alias("LoanExists"))
            .filter(F.col("LoanFineAmount") != F.col("FineTotal")))


def fine_settlement_drift(t: dict, range_size: int | None = None) -> DataFrame:
    """Per fine the paid sum and balance, where Status disagrees:
    'Paid' with a balance left, or 'Unpaid' with nothing left to pay.

    With a ``range_size``, checksums by ranges of so many FineIDs are compared first: the
    amounts of Paid fines against all payments.  Where they agree, Paid fines are paid to the
    cent and the others have no payment, so such a range can only drift by an Unpaid fine of nothing, and
    ranges with one are taken too.  Only rows of the ranges taken are shuffled and joined.
    """
    f, payment = t["fine"].select("FineID", "LoanID", "UserID", "Amount", "Status"), t["payment"].select("FineID", "AmountPaid")
    if range_size:
        ensure_checkpoint_dir(f.sparkSession)
        owed = F.when(F.col("Status") == "Paid", F.col("Amount"))
        apart = differing_ranges(range_checksums(f, "FineID", owed, range_size),
                                 range_checksums(payment, "FineID", F.col("AmountPaid"), range_size))
        nothing = f.filter((F.col("Status") == "Unpaid") & (F.col("Amount") <= 0)).select(_range("FineID", range_size))
        ranges = apart.unionByName(nothing).distinct().checkpoint(eager=True)
        f, payment = in_ranges(f, "FineID", range_size, ranges), in_ranges(payment, "FineID", range_size, ranges)
    paid = payment.groupBy("FineID").agg(F.sum("AmountPaid").alias("_paid"))
    j = f.join(paid, "FineID", "left")
    paid_amt = F.coalesce("_paid", F.lit(0)).cast(MONEY_SUM)
    balance = (F.col("Amount") - paid_amt).cast(MONEY_SUM)
    out = j.select("FineID", "LoanID", "UserID", "Status",
                   F.col("Amount").cast(MONEY_SUM).alias("Amount"),
                   paid_amt.alias("Paid"), balance.alias("Balance"))
    issue = (F.when((F.col("Status") == "Paid") & (F.col("Balance") > 0), F.lit("Paid with balance"))
             .when((F.col("Status") == "Unpaid") & (F.col("Balance") <= 0), F.lit("Unpaid but settled")))
    return out.withColumn("Issue", issue).filter(F.col("Issue").isNotNull())


def derived_book_status(t: dict, as_of) -> DataFrame:
    """Status a book should have: 'Lost' kept; else on an open loan ->
    Borrowed; else on an active reservation -> Reserved; else Available."""
    open_loans = t["loan"].filter(is_open_loan(as_of)).select("LoanID")
    on_loan = (t["loan_item"].select("LoanID", "ISBN").join(open_loans, "LoanID")
               .select("ISBN").distinct().withColumn("_on_loan", F.lit(True)))
    active = t["reservation"].filter(is_active_reservation(as_of)).select("ReservationID")
    reserved = (t["reservation_item"].select("ReservationID", "ISBN").join(active, "ReservationID")
                .select("ISBN").distinct().withColumn("_reserved", F.lit(True)))
    b = t["book"].select("ISBN", "Status").join(on_loan, "ISBN", "left").join(reserved, "ISBN", "left")
    derived = (F.when(F.col("Status") == "Lost", F.lit("Lost"))
               .when(F.col("_on_loan"), F.lit("Borrowed"))
               .when(F.col("_reserved"), F.lit("Reserved"))
               .otherwise(F.lit("Available")))
    return b.select("ISBN", F.col("Status").alias("StoredStatus"), derived.alias("DerivedStatus"))


def book_status_drift(t: dict, as_of) -> DataFrame:
    """Books whose stored Status differs from the derived one."""
    return derived_book_status(t, as_of).filter(
        ~F.col("StoredStatus").eqNullSafe(F.col("DerivedStatus")))


def author_drift(t: dict) -> DataFrame:
    """C4: books whose Author is not among their BookAuthors rows."""
    ba = t["book_authors"].select("ISBN", F.col("AuthorName").alias("Author"))
    return (t["book"].filter(F.col("Author").isNotNull())
            .select("ISBN", "Title", "Author")
            .join(ba, ["ISBN", "Author"], "left_anti"))


def stale_reservations(t: dict, as_of) -> DataFrame:
    """C5: 'Active' reservations already past their expiry (the rows P5 changes)."""
    return t["reservation"].filter(
        (F.col("Status") == "Active") & (F.col("ExpiryDate") < as_date(as_of)))


def fine_user_drift(fines: DataFrame, loans: DataFrame) -> DataFrame:
    """Fines whose UserID is not the UserID of their loan."""
    l = loans.select("LoanID", F.col("UserID").alias("LoanUserID"))
    return (fines.select("FineID", "LoanID", F.col("UserID").alias("FineUserID"))
            .join(l, "LoanID")
            .filter(F.col("FineUserID") != F.col("LoanUserID")))


def symmetric_related(t: dict) -> DataFrame:
    """RelatedBooks in both directions, without self pairs, distinct."""
    r = t["related_books"].filter(F.col("ISBN") != F.col("RelatedISBN"))
    back = r.select(F.col("RelatedISBN").alias("ISBN"), F.col("ISBN").alias("RelatedISBN"))
    return r.select("ISBN", "RelatedISBN").unionByName(back).distinct()
