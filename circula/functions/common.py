"""Shared predicates and small expressions (the pinned rules of SURVEY §2)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circula.schema import table

MONEY = "decimal(8,2)"      # stored money columns
MONEY_SUM = "decimal(18,2)" # every money total we return


def as_date(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (dt.date, dt.datetime)):
        as_of = as_of.isoformat()[:10]
    return F.lit(str(as_of)).cast("date")


def month_start(as_of) -> Column:
    return F.trunc(as_date(as_of), "month")


def is_open_loan(as_of, return_col: str = "ReturnDate", checkout_col: str = "CheckoutDate") -> Column:
    """Open loan: not returned and checked out on or before ``as_of``."""
    return F.col(return_col).isNull() & (F.col(checkout_col) <= as_date(as_of))


def is_active_reservation(as_of) -> Column:
    """Active reservation: Status 'Active' and not past its expiry."""
    return (F.col("Status") == "Active") & (
        F.col("ExpiryDate").isNull() | (F.col("ExpiryDate") >= as_date(as_of)))


def money_sum(c) -> Column:
    """Sum of a DECIMAL money column; an empty sum is 0.00."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(col), F.lit(0)).cast(MONEY_SUM)


def key_text(*cols: str) -> Column:
    """Key as text; composite parts joined by ``|``; a null part reads NULL."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


INTEGERS = ("tinyint", "smallint", "int", "bigint")
DAY_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]00:00(:00(\.0+)?)?)?\s*$"


def fitted(df: DataFrame, column: str, dtype) -> Column:
    """The column as the type ``dtype``, null where the value does not fit.

    A value fits if nothing of it is lost: a number with a fraction is no
    integer, and a time of day is no date.  Decimals alone are rounded, to
    their scale, as a declared amount is stored.  No value ends the job.
    """
    dtype = dtype if isinstance(dtype, str) else dtype.simpleString()
    have = dict(df.dtypes)[column]
    col = F.col(column)
    if have == dtype:
        return col
    if have == "date" and dtype != "string" or have == "boolean":
        return F.lit(None).cast(dtype)
    if dtype.startswith("decimal"):
        return F.round(col.try_cast("decimal(38,10)"), int(dtype.split(",")[1].rstrip(")"))).try_cast(dtype)
    if dtype in INTEGERS and have.startswith("timestamp"):
        return F.lit(None).cast(dtype)  # a time is no number
    if dtype in INTEGERS and have in ("float", "double") or dtype in INTEGERS and have.startswith("decimal"):
        whole = col.try_cast(dtype)
        return F.when(whole.try_cast(have) == col, whole)
    if dtype == "date":
        if have == "string":
            return F.when(col.rlike(DAY_TEXT), col.try_cast(dtype))
        if have not in ("timestamp", "timestamp_ntz"):
            return F.lit(None).cast(dtype)  # a number is no date
        return F.when(col.cast(dtype).cast(have) == col, col.cast(dtype))
    return col.try_cast(dtype)


@dataclass(frozen=True)
class Policy:
    policy_id: int
    name: str | None
    loan_period_days: int
    max_books: int
    fine_rate_per_day: Decimal
    grace_period_days: int

    def rate(self) -> Column:
        return F.lit(self.fine_rate_per_day).cast("decimal(5,2)")


def read_policy(policy: DataFrame | Policy) -> Policy:
    """The one policy row in force (pinned: exactly one row is passed in).

    The frame is size-checked (at most two rows are read) before its values
    become literals, so every rule stays a constant-folded expression.
    """
    if isinstance(policy, Policy):
        return policy
    rows = policy.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected exactly one policy row, got {len(rows)}")
    r = rows[0].asDict()
    defaults = table("policy").defaults  # a missing value takes its declared default

    def value(col):
        return r[col] if r.get(col) is not None else defaults[col]

    return Policy(
        policy_id=r.get("PolicyID"), name=r.get("Name"),
        loan_period_days=int(value("LoanPeriodDays")),
        max_books=int(value("MaxBooks")),
        fine_rate_per_day=Decimal(str(value("FineRatePerDay"))),
        grace_period_days=int(value("GracePeriodDays")),
    )
