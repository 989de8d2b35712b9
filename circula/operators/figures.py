"""Administrator (A1-A12) and librarian (L1-L11) figures and lists.

Rules every list here follows: filters run before joins (so they reach the
parquet scan), joins to wide tables happen after any top-k (the big table is first cut to the
k keys), and counts are pre-aggregated before they meet the member table (no
fan-out).  The recent lists carry their order as ``RowNo``, 1 first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circula.functions import formats as fmt
from circula.functions.common import MONEY_SUM, as_date, is_open_loan, money_sum, month_start
from circula.operators.policy import due_dates, open_books_per_user
from circula.operators.ranking import spread_join
from circula.operators.title_index import BROADCAST_ROWS, TitleIndex
from circula.session import ensure_checkpoint_dir

ENTITY_TYPES = ("Loan", "Reservation", "Book")


def _numbered(top: DataFrame, order: list) -> DataFrame:
    """The rows of a top-k list with ``RowNo``, kept as a checkpoint: k rows that
    several joins read."""
    ensure_checkpoint_dir(top.sparkSession)
    return top.withColumn("RowNo", F.row_number().over(Window.orderBy(*order)).cast("bigint")).checkpoint(eager=True)


def _looked_up(top: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``top`` (a numbered list of k rows) left-joined to ``table`` on ``key``.
    The table is first cut to the list's keys by a broadcast of those k values,
    so it is filtered where it is scanned and never shuffled."""
    hits = table.join(F.broadcast(top.select(key)), key, "left_semi")
    return top.join(F.broadcast(hits), key, "left")


# ---------------------------------------------------------------- admin cards
def total_librarians(t: dict) -> DataFrame:
    """A1: staff with Role 'Librarian'."""
    return t["employee"].agg(
        F.count_if(F.col("Role") == "Librarian").cast("bigint").alias("TotalLibrarians"))


def total_books(t: dict) -> DataFrame:
    """A2: Book rows (one per title; there is no copy table)."""
    return t["book"].agg(F.count(F.lit(1)).alias("TotalBooks"))


def books_added_this_month(t: dict, as_of) -> DataFrame:
    """A3 (proxy): distinct Book entities touched in ProcessedBy this month."""
    d = as_date(as_of)
    return (t["processed_by"]
            .filter((F.col("EntityType") == "Book")
                    & F.col("ActionDate").between(month_start(as_of), d))
            .agg(F.count_distinct("EntityID").alias("BooksAddedThisMonth")))


def member_totals(t: dict, as_of) -> DataFrame:
    """A4: all members and those who joined this month."""
    d = as_date(as_of)
    return t["library_user"].agg(
        F.count(F.lit(1)).alias("TotalMembers"),
        F.count_if(F.col("MembershipDate").between(month_start(as_of), d))
         .cast("bigint").alias("NewThisMonth"))


def total_revenue(t: dict) -> DataFrame:
    """A5: sum of all payments (0.00 when there are none)."""
    return t["payment"].agg(money_sum("AmountPaid").alias("TotalRevenue"))


def librarian_roster(t: dict) -> DataFrame:
    """Librarians with code, name, email, position, access level; by id."""
    return (t["employee"].filter(F.col("Role") == "Librarian")
            .select(fmt.code(fmt.CODE_PREFIX_LIBRARIAN, "EmployeeID", 3).alias("Code"),
                    "EmployeeID", "Name", "Email", "Position", "AccessLevel")
            .orderBy("EmployeeID"))


def monthly_revenue(t: dict, date_from=None, date_to=None) -> DataFrame:
    """Payments per calendar month and method: count and amount.

    An optional report period (both ends in) is applied on PaymentDate before
    the aggregation, so it is pushed to the parquet scan.
    """
    pay = t["payment"]
    if date_from is not None:
        pay = pay.filter(F.col("PaymentDate") >= as_date(date_from))
    if date_to is not None:
        pay = pay.filter(F.col("PaymentDate") <= as_date(date_to))
    return (pay
            .groupBy(F.trunc("PaymentDate", "month").alias("Month"), "PaymentMethod")
            .agg(F.count(F.lit(1)).alias("Payments"),
                 money_sum("AmountPaid").alias("Amount")))


def inventory_report(t: dict) -> DataFrame:
    """Books per Genre x Status, with the share of the genre."""
    counts = t["book"].groupBy("Genre", "Status").agg(F.count(F.lit(1)).alias("Books"))
    genre_total = F.sum("Books").over(Window.partitionBy("Genre"))
    return counts.withColumn(
        "ShareOfGenre", F.round(F.col("Books").cast("double") / genre_total, 4))


def recent_reports(t: dict, as_of, k: int = 10) -> DataFrame:
    """Latest k reports with author (may be null) and age in days, newest first."""
    d = as_date(as_of)
    order = [F.col("GenerationDate").desc(), F.col("ReportID").desc()]
    top = _numbered(t["report"].filter(F.col("GenerationDate") <= d)
                    .select("ReportID", "Type", "GenerationDate", "GeneratedBy").orderBy(*order).limit(k), order)
    staff = t["employee"].select(F.col("EmployeeID").alias("GeneratedBy"),
                                 F.col("Name").alias("Author"))
    return (_looked_up(top, staff, "GeneratedBy").orderBy("RowNo")
            .select("RowNo", "ReportID", "Type", "GenerationDate", "GeneratedBy", "Author",
                    F.datediff(d, F.col("GenerationDate")).alias("AgeDays"),
                    fmt.age_days("GenerationDate", d).alias("Age")))


def activity_log(t: dict, as_of, k: int = 20) -> DataFrame:
    """A10: latest k staff actions with employee name and age in days, newest first."""
    d = as_date(as_of)
    order = [F.col("ActionDate").desc(), F.col("ProcessID").desc()]
    top = _numbered(t["processed_by"].filter(F.col("ActionDate") <= d).orderBy(*order).limit(k), order)
    staff = t["employee"].select("EmployeeID", F.col("Name").alias("EmployeeName"))
    return (_looked_up(top, staff, "EmployeeID").orderBy("RowNo")
            .select("RowNo", "ProcessID", "EmployeeID", "EmployeeName", "EntityType", "EntityID",
                    "ActionDate", F.datediff(d, F.col("ActionDate")).alias("AgeDays")))


def resolve_processed(t: dict) -> DataFrame:
    """Does each polymorphic (EntityType, EntityID) link find its row?

    One type-guarded join: the target keys are tagged with their type, so a
    Loan id never matches a Reservation.  'Book' ids are INT while ISBN is
    text, so Book actions cannot resolve.
    """
    targets = (t["loan"].select(F.lit("Loan").alias("_type"), F.col("LoanID").alias("_id"))
               .unionByName(t["reservation"].select(F.lit("Reservation").alias("_type"),
                                                    F.col("ReservationID").alias("_id")))
               .distinct().select(F.col("_type").alias("EntityType"), F.col("_id").alias("EntityID"), "_id"))
    pb = t["processed_by"].select("ProcessID", "EntityType", "EntityID")
    joined = spread_join(pb, targets, ["EntityType", "EntityID"], "left")
    return joined.groupBy("EntityType").agg(
        F.count(F.lit(1)).alias("Actions"),
        F.count("_id").alias("Resolved"),
        F.count_if(F.col("_id").isNull()).cast("bigint").alias("Unresolved"))


def staff_activity(t: dict) -> DataFrame:
    """Actions per employee and entity type; staff with none show 0.  The
    total holds all actions, those without an entity type too."""
    per_emp = t["processed_by"].groupBy("EmployeeID").agg(
        *[F.count_if(F.col("EntityType") == e).alias(e) for e in ENTITY_TYPES], F.count(F.lit(1)).alias("_all"))
    cols = [F.coalesce(F.col(e), F.lit(0)).cast("bigint").alias(f"{e}Actions") for e in ENTITY_TYPES]
    total = F.coalesce(F.col("_all"), F.lit(0)).cast("bigint")
    return (t["employee"].select("EmployeeID", "Name")
            .join(per_emp, "EmployeeID", "left")
            .select("EmployeeID", "Name", *cols, total.alias("TotalActions")))


# ------------------------------------------------------------ librarian cards
def _open_items(t: dict, as_of, policy=None) -> DataFrame:
    loans = t["loan"].filter(is_open_loan(as_of))
    if policy is not None:
        loans = due_dates(loans, policy)
    return loans.join(t["loan_item"].select("LoanID", "ISBN"), "LoanID")


def checked_out_on(t: dict, as_of) -> DataFrame:
    """L1: books (LoanItem rows) on loans checked out on ``as_of``."""
    loans = t["loan"].filter(F.col("CheckoutDate") == as_date(as_of)).select("LoanID")
    return (t["loan_item"].select("LoanID").join(loans, "LoanID")
            .agg(F.count(F.lit(1)).alias("CheckedOutToday")))


def active_members(t: dict, as_of) -> DataFrame:
    """L2: members with an 'Active' account; members who joined on ``as_of``."""
    return t["library_user"].agg(
        F.count_if(F.col("AccountStatus") == "Active").cast("bigint").alias("ActiveMembers"),
        F.count_if(F.col("MembershipDate") == as_date(as_of)).cast("bigint").alias("JoinedToday"))


def due_today_count(t: dict, as_of, policy) -> DataFrame:
    """L3: books on open loans due on ``as_of``."""
    items = _open_items(t, as_of, policy).filter(F.col("DueDate") == as_date(as_of))
    return items.agg(F.count(F.lit(1)).alias("DueToday"))


def pending_fines(t: dict) -> DataFrame:
    """L4: total of 'Unpaid' fines and the number of members owing."""
    unpaid = t["fine"].filter(F.col("Status") == "Unpaid")
    return unpaid.agg(money_sum("Amount").alias("UnpaidTotal"),
                      F.count_distinct("UserID").alias("MembersOwing"))


def _loan_events(t: dict, as_of, date_from=None, date_to=None) -> DataFrame:
    """The Borrow and the Return of each loan (LoanID, UserID, TxType, TxDate, DueDate, Status); a transaction
    is one of these for one of the loan's items.

    A date range is applied first as ``CheckoutDate in range OR ReturnDate in
    range`` (pushed to the scan) and then exactly on the transaction date.
    """
    d = as_date(as_of)
    loans = t["loan"].filter(F.col("CheckoutDate") <= d).select(
        "LoanID", "UserID", "CheckoutDate", "DueDate", "ReturnDate")
    lo = as_date(date_from) if date_from is not None else None
    hi = as_date(date_to) if date_to is not None else None

    def in_range(c):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(c) >= lo)
        if hi is not None:
            cond = cond & (F.col(c) <= hi)
        return cond

    if lo is not None or hi is not None:
        loans = loans.filter(in_range("CheckoutDate") | in_range("ReturnDate"))
    returned = F.col("ReturnDate").isNotNull() & (F.col("ReturnDate") <= d)
    borrow = F.struct(F.lit("Borrow").alias("TxType"), F.col("CheckoutDate").alias("TxDate"),
                      F.col("DueDate").alias("DueDate"),
                      F.when(returned, F.lit("Returned")).otherwise(F.lit("Active")).alias("Status"))
    ret = F.when(returned, F.struct(F.lit("Return").alias("TxType"), F.col("ReturnDate").alias("TxDate"),
                                    F.lit(None).cast("date").alias("DueDate"),
                                    F.lit("Returned").alias("Status")))
    tx = (loans.select("LoanID", "UserID",
                       F.explode(F.filter(F.array(borrow, ret), lambda x: x.isNotNull())).alias("_tx"))
          .select("LoanID", "UserID", "_tx.*"))
    if lo is not None or hi is not None:
        tx = tx.filter(in_range("TxDate"))
    return tx


def _tx_order(last: str = "ISBN"):
    return [F.col("TxDate").desc(), F.col("LoanID").desc(), F.col("TxType"), *([F.col(last)] if last else [])]


def _enrich_transactions(top: DataFrame, t: dict) -> DataFrame:
    users = t["library_user"].select("UserID", F.col("Name").alias("Member"))
    books = t["book"].select("ISBN", "Title")
    return (_looked_up(_looked_up(top, users, "UserID"), books, "ISBN").orderBy("RowNo")
            .select("RowNo", fmt.code(fmt.CODE_PREFIX_TRANSACTION, "LoanID", 3).alias("TransactionID"),
                    "LoanID", "UserID", "Member", "ISBN", "Title", "TxType", "TxDate", "DueDate",
                    "Status"))


def _newest(t: dict, events: DataFrame, k: int, after: tuple | None = None) -> DataFrame:
    """The newest k transactions (numbered) of the loan events, strictly after the key ``after``.

    A loan event comes before another with all of its items, so the first k
    events hold the first k transactions if each has an item: only those k (one more with a
    cursor, whose own event may be used up) are joined to the items.  Where loans without items leave
    fewer than k rows, a second pass takes the events of loans that have some.
    """
    def rows(some: DataFrame, items: DataFrame) -> DataFrame:
        found = items.select("LoanID", "ISBN").join(some, "LoanID")
        if after is not None:
            d, loan, kind, isbn = as_date(after[0]), *(F.lit(x) for x in after[1:])
            same = (F.col("TxDate") == d) & (F.col("LoanID") == loan) & (F.col("TxType") == kind)
            found = found.filter(~same | (F.col("ISBN") > isbn))
        return _numbered(found.orderBy(*_tx_order()).limit(k), _tx_order())

    wanted = k if after is None else k + 1
    first = events.orderBy(*_tx_order(last="")).limit(wanted)
    top = rows(F.broadcast(first), t["loan_item"])  # k + 1 rows at most
    if top.count() == k or first.count() < wanted:
        return top
    return rows(events, t["loan_item"])


def recent_transactions(t: dict, as_of, k: int = 10) -> DataFrame:
    """Latest k borrow / return rows: newest first, then LoanID desc, type, ISBN.

    The top-k runs on the loans' narrow rows; the k survivors are then
    joined to items, member names and titles.
    """
    return _enrich_transactions(_newest(t, _loan_events(t, as_of), k), t)


def transaction_history(t: dict, as_of, member: int | None = None, date_from=None,
                        date_to=None, tx_type: str | None = None, after: tuple | None = None,
                        page: int = 50) -> DataFrame:
    """L5's rows filtered by member / date range / type, paged by key.

    ``after`` is the (TxDate, LoanID, TxType, ISBN) of the last row of the previous
    page (the one with the highest RowNo); the next page starts strictly after
    it in L5's order (no offset scan), and days after its date are not read.
    """
    if after is not None:
        cursor = _day(after[0])
        date_to = cursor if date_to is None else min(cursor, _day(date_to))
    tx = _loan_events(t, as_of, date_from, date_to)
    if member is not None:
        tx = tx.filter(F.col("UserID") == F.lit(member))
    if tx_type is not None:
        tx = tx.filter(F.col("TxType") == F.lit(tx_type))
    if after is not None:
        ad, al, at = as_date(after[0]), F.lit(after[1]), F.lit(after[2])
        d, loan = F.col("TxDate"), F.col("LoanID")
        tx = tx.filter((d < ad) | ((d == ad) & (loan < al)) | ((d == ad) & (loan == al) & (F.col("TxType") >= at)))
    return _enrich_transactions(_newest(t, tx, page, after), t)


def _day(value) -> dt.date:
    return value if type(value) is dt.date else dt.date.fromisoformat(str(value)[:10])


def books_due(t: dict, as_of, policy) -> DataFrame:
    """Open items due on ``as_of`` with title, borrower and member code."""
    items = _open_items(t, as_of, policy).filter(F.col("DueDate") == as_date(as_of))
    users = t["library_user"].select("UserID", F.col("Name").alias("Borrower"))
    books = t["book"].select("ISBN", "Title")
    return (items.select("LoanID", "UserID", "ISBN", "DueDate")
            .join(users, "UserID", "left").join(books, "ISBN", "left")
            .select("LoanID", "ISBN", "Title", "UserID", "Borrower",
                    fmt.code(fmt.CODE_PREFIX_MEMBER, "UserID", 4).alias("MemberCode"),
                    "DueDate"))


def member_activity(t: dict, as_of, k: int = 10) -> DataFrame:
    """Latest k registrations and fine payments, with a sentence and age.

    Order: newest first, then kind, then the row's own key.  The top-k runs
    before names are joined in, and ``fine`` and the members are cut to its keys.
    """
    d = as_date(as_of)
    reg = t["library_user"].filter(F.col("MembershipDate") <= d).select(
        F.lit("Registration").alias("Kind"), F.col("MembershipDate").alias("EventDate"),
        F.col("UserID").alias("RefID"), F.col("UserID"),
        F.lit(None).cast("int").alias("FineID"),
        F.lit(None).cast("decimal(8,2)").alias("Amount"))
    pay = t["payment"].filter(F.col("PaymentDate") <= d).select(
        F.lit("Payment").alias("Kind"), F.col("PaymentDate").alias("EventDate"),
        F.col("PaymentID").alias("RefID"), F.lit(None).cast("int").alias("UserID"),
        "FineID", F.col("AmountPaid").alias("Amount"))
    order = [F.col("EventDate").desc(), F.col("Kind"), F.col("RefID")]
    top = _numbered(reg.unionByName(pay).orderBy(*order).limit(k), order)
    fines = t["fine"].select("FineID", F.col("UserID").alias("_fine_user"))
    users = t["library_user"].select("UserID", F.col("Name").alias("Member"))
    known = _looked_up(top, fines, "FineID").withColumn("UserID", F.coalesce("UserID", "_fine_user"))
    enriched = _looked_up(known, users, "UserID").orderBy("RowNo")
    who = F.coalesce(F.col("Member"), F.lit("Unknown member"))
    # Fixed sentence shapes from the librarian page.
    message = (F.when(F.col("Kind") == "Registration",
                      F.concat(who, F.lit(" registered as a new member")))
               .otherwise(F.concat(who, F.lit(" paid "), fmt.money("Amount", 2),
                                   F.lit(" in late fees"))))
    title = F.when(F.col("Kind") == "Registration", F.lit("New Member Registration")) \
             .otherwise(F.lit("Fine Payment"))
    return enriched.select(
        "RowNo", "Kind", "EventDate", "RefID", "UserID", "Member", "Amount",
        title.alias("Title"), message.alias("Message"),
        F.datediff(d, F.col("EventDate")).alias("AgeDays"))


def member_list(t: dict, as_of) -> DataFrame:
    """Per member status, city, open books and unpaid fines.

    Both counts are aggregated per user before the join, so a member with many
    loans and fines is one row on each side (no fan-out).
    """
    open_books = open_books_per_user(t, as_of)
    unpaid = (t["fine"].filter(F.col("Status") == "Unpaid")
              .groupBy("UserID").agg(F.sum("Amount").alias("_unpaid")))
    return (t["library_user"].select("UserID", "Name", "AccountStatus", "City")
            .join(open_books, "UserID", "left")
            .join(unpaid, "UserID", "left")
            .select(fmt.code(fmt.CODE_PREFIX_MEMBER, "UserID", 4).alias("MemberCode"),
                    "UserID", "Name", "AccountStatus", "City",
                    F.coalesce("OpenBooks", F.lit(0)).cast("bigint").alias("OpenBooks"),
                    F.coalesce("_unpaid", F.lit(0)).cast(MONEY_SUM).alias("UnpaidFines")))


def book_authors_list(t: dict, isbns: DataFrame | None = None) -> DataFrame:
    """Per ISBN the sorted distinct authors of Book.Author and BookAuthors.

    ``isbns`` (optional) restricts the work to those books before any
    shuffle.  Each group is one book's author list, deduplicated map-side
    before it is gathered.
    """
    names = (t["book"].select("ISBN", F.col("Author").alias("AuthorName"))
             .unionByName(t["book_authors"].select("ISBN", "AuthorName"))
             .filter(F.col("AuthorName").isNotNull()))
    if isbns is not None:
        names = names.join(isbns.select("ISBN").distinct(), "ISBN", "left_semi")
    names = names.distinct()
    return names.groupBy("ISBN").agg(
        F.array_join(F.array_sort(F.collect_list("AuthorName")), "; ").alias("Authors"),
        F.count(F.lit(1)).alias("AuthorCount"))


def browse_catalog(t: dict, genre: str | None = None, author: str | None = None,
                   status: str | None = None, title_like: str | None = None,
                   year_range: tuple[int, int] | None = None, title_index: TitleIndex | None = None) -> DataFrame:
    """Filtered catalogue with all authors.

    Filters on Book columns are applied to the scan (they show up as parquet
    PushedFilters); the author filter matches any of a book's authors.  With a
    ``title_index`` the scan is cut to the candidates of ``title_like`` (by a broadcast
    of at most ``title_index.BROADCAST_ROWS`` ISBNs, else a shuffle join) before the pattern is tried; a
    pattern without three literal characters in a row reads every title.
    """
    books = t["book"]
    candidates = title_index.candidates(title_like) if title_index is not None and title_like is not None else None
    if candidates is not None:
        ensure_checkpoint_dir(books.sparkSession)
        candidates = candidates.checkpoint(eager=True)
        few = candidates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        books = books.join(F.broadcast(candidates) if few else candidates, "ISBN", "left_semi")
    if genre is not None:
        books = books.filter(F.col("Genre") == F.lit(genre))
    if status is not None:
        books = books.filter(F.col("Status") == F.lit(status))
    if title_like is not None:
        books = books.filter(F.col("Title").ilike(title_like))
    if year_range is not None:
        books = books.filter(F.col("PublicationYear").between(year_range[0], year_range[1]))
    if author is not None:
        hits = (t["book_authors"].filter(F.col("AuthorName") == F.lit(author)).select("ISBN")
                .unionByName(t["book"].filter(F.col("Author") == F.lit(author)).select("ISBN")))
        books = books.join(hits.distinct(), "ISBN", "left_semi")
    books = books.select("ISBN", "Title", "PublicationYear", "Genre", "Status")
    # author lists only for the books that passed the filters
    authors = book_authors_list(t, books)
    return books.join(authors.select("ISBN", "Authors"), "ISBN", "left")
