"""Declared data model of the circulation database.

Every table is one DataFrame with an explicit ``StructType``.  Next to the
types we keep the declared constraints (keys, uniques, NOT NULL, text
lengths, enumerations, decimal sizes, defaults and foreign keys) as plain
data, so the checks in :mod:`circula.operators.quality` and the referential
actions in :mod:`circula.operators.actions` are driven by one description.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

INT = T.IntegerType()
STR = T.StringType()
DATE = T.DateType()
DEC52 = T.DecimalType(5, 2)
DEC82 = T.DecimalType(8, 2)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "RESTRICT"  # CASCADE | RESTRICT | SET NULL
    on_update: str = "RESTRICT"  # CASCADE | RESTRICT


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    primary_key: tuple[str, ...]
    auto_increment: str | None = None
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    decimals: dict[str, tuple[int, int]] = field(default_factory=dict)
    years: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c, t, c not in self.nullable_exempt) for c, t in self.columns]
        )

    @property
    def nullable_exempt(self) -> set[str]:
        # Declared NOT NULL columns and primary-key columns may hold no null.
        return set(self.not_null) | set(self.primary_key)

    @property
    def column_names(self) -> list[str]:
        return [c for c, _ in self.columns]

    def type_of(self, column: str) -> T.DataType:
        return dict(self.columns)[column]


# Sentinel for a DEFAULT (CURRENT_DATE): replaced by the run's as-of date.
CURRENT_DATE = "CURRENT_DATE"

# ---------------------------------------------------------------------------
# Fixed values from the declared schema: column lengths, enumeration members,
# decimal sizes and defaults must equal the DDL for the checks to agree.
# ---------------------------------------------------------------------------
TABLES: dict[str, Table] = {
    "library_user": Table(
        name="library_user",
        columns=(
            ("UserID", INT), ("Name", STR), ("Email", STR), ("Phone", STR),
            ("Street", STR), ("City", STR), ("Zip", STR),
            ("AccountStatus", STR), ("MembershipDate", DATE),
        ),
        primary_key=("UserID",),
        auto_increment="UserID",
        unique=("Email",),
        not_null=("Name",),
        lengths={"Name": 100, "Email": 100, "Phone": 20, "Street": 100,
                 "City": 50, "Zip": 10, "AccountStatus": 20},
        defaults={"AccountStatus": "Active"},
    ),
    "employee": Table(
        name="employee",
        columns=(
            ("EmployeeID", INT), ("Name", STR), ("Email", STR),
            ("Position", STR), ("AccessLevel", INT), ("Role", STR),
        ),
        primary_key=("EmployeeID",),
        auto_increment="EmployeeID",
        unique=("Email",),
        not_null=("Name",),
        lengths={"Name": 100, "Email": 100, "Position": 50},
        enums={"Role": ("Librarian", "Administrator", "Other")},
        defaults={"AccessLevel": 1, "Role": "Librarian"},
    ),
    "book": Table(
        name="book",
        columns=(
            ("ISBN", STR), ("Title", STR), ("PublicationYear", INT),
            ("Genre", STR), ("Author", STR), ("Status", STR),
            ("ShelfLocation", STR),
        ),
        primary_key=("ISBN",),
        not_null=("Title",),
        lengths={"ISBN": 20, "Title": 200, "Genre": 100, "Author": 100,
                 "ShelfLocation": 50},
        enums={"Status": ("Available", "Borrowed", "Reserved", "Lost")},
        years=("PublicationYear",),
        defaults={"Status": "Available"},
    ),
    "book_authors": Table(
        name="book_authors",
        columns=(("ISBN", STR), ("AuthorName", STR)),
        primary_key=("ISBN", "AuthorName"),
        lengths={"ISBN": 20, "AuthorName": 100},
        foreign_keys=(
            ForeignKey(("ISBN",), "book", ("ISBN",), "CASCADE", "CASCADE"),
        ),
    ),
    "related_books": Table(
        name="related_books",
        columns=(("ISBN", STR), ("RelatedISBN", STR)),
        primary_key=("ISBN", "RelatedISBN"),
        lengths={"ISBN": 20, "RelatedISBN": 20},
        foreign_keys=(
            ForeignKey(("ISBN",), "book", ("ISBN",), "CASCADE"),
            ForeignKey(("RelatedISBN",), "book", ("ISBN",), "CASCADE"),
        ),
    ),
    "policy": Table(
        name="policy",
        columns=(
            ("PolicyID", INT), ("Name", STR), ("LoanPeriodDays", INT),
            ("MaxBooks", INT), ("FineRatePerDay", DEC52), ("GracePeriodDays", INT),
        ),
        primary_key=("PolicyID",),
        auto_increment="PolicyID",
        lengths={"Name": 100},
        decimals={"FineRatePerDay": (5, 2)},
        defaults={"LoanPeriodDays": 14, "MaxBooks": 5,
                  "FineRatePerDay": "0.50", "GracePeriodDays": 2},
    ),
    "reservation": Table(
        name="reservation",
        columns=(
            ("ReservationID", INT), ("UserID", INT), ("ReservationDate", DATE),
            ("ExpiryDate", DATE), ("Status", STR),
        ),
        primary_key=("ReservationID",),
        auto_increment="ReservationID",
        not_null=("UserID",),
        enums={"Status": ("Active", "Expired", "Cancelled")},
        defaults={"ReservationDate": CURRENT_DATE, "Status": "Active"},
        foreign_keys=(
            ForeignKey(("UserID",), "library_user", ("UserID",), "CASCADE"),
        ),
    ),
    "reservation_item": Table(
        name="reservation_item",
        columns=(("ReservationID", INT), ("ISBN", STR)),
        primary_key=("ReservationID", "ISBN"),
        lengths={"ISBN": 20},
        foreign_keys=(
            ForeignKey(("ReservationID",), "reservation", ("ReservationID",), "CASCADE"),
            ForeignKey(("ISBN",), "book", ("ISBN",), "RESTRICT"),
        ),
    ),
    "loan": Table(
        name="loan",
        columns=(
            ("LoanID", INT), ("UserID", INT), ("CheckoutDate", DATE),
            ("DueDate", DATE), ("ReturnDate", DATE), ("FineAmount", DEC82),
        ),
        primary_key=("LoanID",),
        auto_increment="LoanID",
        not_null=("UserID",),
        decimals={"FineAmount": (8, 2)},
        defaults={"CheckoutDate": CURRENT_DATE, "FineAmount": "0.00"},
        foreign_keys=(
            ForeignKey(("UserID",), "library_user", ("UserID",), "CASCADE"),
        ),
    ),
    "loan_item": Table(
        name="loan_item",
        columns=(("LoanID", INT), ("ISBN", STR)),
        primary_key=("LoanID", "ISBN"),
        lengths={"ISBN": 20},
        foreign_keys=(
            ForeignKey(("LoanID",), "loan", ("LoanID",), "CASCADE"),
            ForeignKey(("ISBN",), "book", ("ISBN",), "RESTRICT"),
        ),
    ),
    "fine": Table(
        name="fine",
        columns=(
            ("FineID", INT), ("LoanID", INT), ("UserID", INT), ("IssueDate", DATE),
            ("Amount", DEC82), ("Status", STR), ("Description", STR),
        ),
        primary_key=("FineID",),
        auto_increment="FineID",
        not_null=("LoanID", "UserID", "Amount"),
        lengths={"Description": 255},
        enums={"Status": ("Unpaid", "Paid")},
        decimals={"Amount": (8, 2)},
        defaults={"IssueDate": CURRENT_DATE, "Status": "Unpaid"},
        foreign_keys=(
            ForeignKey(("LoanID",), "loan", ("LoanID",), "CASCADE"),
            ForeignKey(("UserID",), "library_user", ("UserID",), "CASCADE"),
        ),
    ),
    "payment": Table(
        name="payment",
        columns=(
            ("PaymentID", INT), ("FineID", INT), ("PaymentDate", DATE),
            ("AmountPaid", DEC82), ("PaymentMethod", STR),
        ),
        primary_key=("PaymentID",),
        auto_increment="PaymentID",
        not_null=("FineID",),
        enums={"PaymentMethod": ("Cash", "Credit", "Online", "Other")},
        decimals={"AmountPaid": (8, 2)},
        defaults={"PaymentDate": CURRENT_DATE, "PaymentMethod": "Cash"},
        foreign_keys=(
            ForeignKey(("FineID",), "fine", ("FineID",), "CASCADE"),
        ),
    ),
    "report": Table(
        name="report",
        columns=(
            ("ReportID", INT), ("GeneratedBy", INT), ("GenerationDate", DATE),
            ("Type", STR), ("Content", STR),
        ),
        primary_key=("ReportID",),
        auto_increment="ReportID",
        lengths={"Type": 50},
        defaults={"GenerationDate": CURRENT_DATE},
        foreign_keys=(
            ForeignKey(("GeneratedBy",), "employee", ("EmployeeID",), "SET NULL"),
        ),
    ),
    "processed_by": Table(
        name="processed_by",
        columns=(
            ("ProcessID", INT), ("EmployeeID", INT), ("EntityType", STR),
            ("EntityID", INT), ("ActionDate", DATE),
        ),
        primary_key=("ProcessID",),
        auto_increment="ProcessID",
        not_null=("EmployeeID", "EntityID"),
        enums={"EntityType": ("Loan", "Reservation", "Book")},
        defaults={"ActionDate": CURRENT_DATE},
        foreign_keys=(
            ForeignKey(("EmployeeID",), "employee", ("EmployeeID",), "CASCADE"),
        ),
    ),
}

# YEAR columns hold 1901..2155, or 0 (pinned).
YEAR_MIN, YEAR_MAX, YEAR_ZERO = 1901, 2155, 0


def table(name: str) -> Table:
    try:
        return TABLES[name]
    except KeyError as exc:
        raise KeyError(f"unknown table {name!r}; known: {sorted(TABLES)}") from exc


def schema_of(name: str) -> T.StructType:
    return table(name).schema
