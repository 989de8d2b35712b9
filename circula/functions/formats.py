"""Presentation scalars (F1-F5) as plain column expressions.

All of them stay inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed display values taken from the dashboard pages.
CODE_PREFIX_LIBRARIAN = "L"      # L001
CODE_PREFIX_MEMBER = "M"         # M0123
CODE_PREFIX_TRANSACTION = "#TRX" # #TRX001
DAY_PATTERN = "MMM d, yyyy"      # Nov 1, 2025


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code(prefix: str, id_col, width: int) -> Column:
    """``prefix`` + id zero-padded to ``width``; longer ids are never cut."""
    s = _col(id_col).cast("string")
    return F.concat(F.lit(prefix), F.lpad(s, F.greatest(F.lit(width), F.length(s)), "0"))


def money(c, decimals: int = 2) -> Column:
    """F2: ``$2,500`` / ``$5.00``."""
    return F.concat(F.lit("$"), F.format_number(_col(c), decimals))


def thousands(c) -> Column:
    """``1,234``."""
    return F.format_number(_col(c), 0)


def day(c) -> Column:
    """``Nov 1, 2025``."""
    return F.date_format(_col(c), DAY_PATTERN)


def age_days(c, as_of) -> Column:
    """day-grain age text: ``today``, ``1 day ago``, ``3 days ago``.

    A date after ``as_of`` reads ``in 1 day`` / ``in n days``.
    """
    n = F.datediff(_col(as_of) if not isinstance(as_of, str) else F.lit(as_of).cast("date"), _col(c))
    return (F.when(n == 0, F.lit("today"))
            .when(n == 1, F.lit("1 day ago"))
            .when(n > 1, F.concat(n.cast("string"), F.lit(" days ago")))
            .when(n == -1, F.lit("in 1 day"))
            .otherwise(F.concat(F.lit("in "), (-n).cast("string"), F.lit(" days"))))
