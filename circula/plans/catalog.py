"""Registered queries: one Spark callable and one DuckDB oracle per operator.

``QUERIES[name](spark, sf_dir)`` builds the fixture views for ``sf_dir``
(lazy DataFrames over the driver's parquet files) and runs the operator.
``ORACLE[name]`` is the same result written as DuckDB SQL over the raw
tables (fixture views are prepended as CTEs, see ``oracle_views``).  Column
names and types are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.operators import actions, circulation, figures, ingest, member, policy, quality, reconcile
from circula.plans import constraints
from circula.plans.oracle_views import with_views
from circula.schema import TABLES
from circula.session import AS_OF, ensure_checkpoint_dir
from circula.sources.fixtures import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# name -> fn(tables, spark): the operator call itself, for any table source
BUILDERS: dict[str, Callable] = {}

D = f"DATE '{AS_OF}'"
MONTH0 = f"DATE '{AS_OF[:8]}01'"


def query(name: str, sql: str | None = None):
    """Register a query builder ``fn(t, spark) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(fixtures(spark, sf_dir), spark)
        run.__name__ = name
        run.__doc__ = fn.__doc__ or (
            f"Operator {name.split('_', 1)[0].upper()} ({name.split('_', 1)[1]}) over the fixture "
            f"tables of sf_dir, as of {AS_OF}.")
        QUERIES[name] = run
        BUILDERS[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql.replace("{D}", D).replace("{M0}", MONTH0))
        return fn
    return deco


def _pol(t):
    return t["policy"]


# SQL fragments reused by several oracles -----------------------------------
OPEN = "l.ReturnDate IS NULL AND l.CheckoutDate <= {D}"
DUE = "coalesce(l.DueDate, l.CheckoutDate + p.LoanPeriodDays)"
OPEN_BOOKS = f"""SELECT l.UserID, count(*) AS OpenBooks FROM loan l JOIN loan_item i ON l.LoanID = i.LoanID
 WHERE {OPEN} GROUP BY l.UserID"""


def _code(prefix: str, col: str, width: int) -> str:
    return (f"'{prefix}' || lpad(CAST({col} AS VARCHAR), "
            f"CAST(greatest({width}, length(CAST({col} AS VARCHAR))) AS INTEGER), '0')")


def _age(col: str) -> str:
    n = f"date_diff('day', {col}, {{D}})"
    return (f"CASE WHEN {n} = 0 THEN 'today' WHEN {n} = 1 THEN '1 day ago' "
            f"WHEN {n} > 1 THEN CAST({n} AS VARCHAR) || ' days ago' WHEN {n} = -1 THEN 'in 1 day' "
            f"ELSE 'in ' || CAST(-{n} AS VARCHAR) || ' days' END")


# ========================================================== P: policy ======
@query("p1_due_dates", """SELECT l.LoanID, l.UserID, l.CheckoutDate, {DUE} AS DueDate
 FROM loan l CROSS JOIN policy p""".replace("{DUE}", DUE))
def _p1(t, spark):
    return policy.due_dates(t["loan"], _pol(t)).select("LoanID", "UserID", "CheckoutDate", "DueDate")


@query("p2_loan_status", """WITH x AS (SELECT l.LoanID, {DUE} AS DueDate, l.ReturnDate FROM loan l CROSS JOIN policy p)
SELECT LoanID, DueDate, ReturnDate,
 CASE WHEN ReturnDate IS NOT NULL AND ReturnDate <= {D} THEN 'Returned' WHEN DueDate > {D} THEN 'On Time'
      WHEN DueDate = {D} THEN 'Due Today' ELSE 'Overdue' END AS LoanStatus FROM x""".replace("{DUE}", DUE))
def _p2(t, spark):
    return policy.loan_status(t["loan"], AS_OF, _pol(t)).select("LoanID", "DueDate", "ReturnDate", "LoanStatus")


@query("p3_assess_fines", """WITH x AS (SELECT l.LoanID, l.UserID, coalesce(l.ReturnDate, {D}) AS IssueDate,
   CAST(date_diff('day', {DUE}, coalesce(l.ReturnDate, {D})) AS INTEGER) AS DaysLate, p.GracePeriodDays AS g, p.FineRatePerDay AS r
   FROM loan l CROSS JOIN policy p WHERE l.CheckoutDate <= {D})
SELECT LoanID, UserID, IssueDate, DaysLate, CAST(greatest(DaysLate - g, 0) AS INTEGER) AS BillableDays,
 CAST(greatest(DaysLate - g, 0) * r AS DECIMAL(8,2)) AS Amount FROM x WHERE greatest(DaysLate - g, 0) > 0""".replace("{DUE}", DUE))
def _p3(t, spark):
    return policy.assess_fines(t, _pol(t), AS_OF)


@query("p4_allowance", f"""WITH ob AS ({OPEN_BOOKS})
SELECT u.UserID, coalesce(ob.OpenBooks, 0) AS OpenBooks, p.MaxBooks,
 CAST(greatest(p.MaxBooks - coalesce(ob.OpenBooks, 0), 0) AS BIGINT) AS Remaining,
 coalesce(ob.OpenBooks, 0) > p.MaxBooks AS OverLimit
 FROM library_user u LEFT JOIN ob ON u.UserID = ob.UserID CROSS JOIN policy p""")
def _p4(t, spark):
    return policy.allowance(t, _pol(t), AS_OF)


@query("p5_expire_reservations", """SELECT ReservationID, UserID, ReservationDate, ExpiryDate,
 CASE WHEN Status = 'Active' AND ExpiryDate < {D} THEN 'Expired' ELSE Status END AS Status FROM reservation""")
def _p5(t, spark):
    return policy.expire_reservations(t, AS_OF)


@query("p6_overdue_loans", """WITH l AS (SELECT l.LoanID, l.UserID, l.CheckoutDate, {DUE} AS DueDate
   FROM loan l CROSS JOIN policy p WHERE {OPEN})
SELECT l.LoanID, l.UserID, u.Name AS Member, i.ISBN, b.Title, l.CheckoutDate, l.DueDate,
 CAST(date_diff('day', l.DueDate, {D}) AS INTEGER) AS DaysLate,
 CAST(greatest(date_diff('day', l.DueDate, {D}) - p.GracePeriodDays, 0) * p.FineRatePerDay AS DECIMAL(8,2)) AS AccruedFine
 FROM l JOIN loan_item i ON l.LoanID = i.LoanID LEFT JOIN library_user u ON l.UserID = u.UserID
 LEFT JOIN book b ON i.ISBN = b.ISBN CROSS JOIN policy p WHERE l.DueDate < {D}""".replace("{DUE}", DUE).replace("{OPEN}", OPEN))
def _p6(t, spark):
    return policy.overdue_loans(t, _pol(t), AS_OF)


# =========================================================== A: admin ======
@query("a1_total_librarians", """SELECT CAST(count(*) FILTER (WHERE Role = 'Librarian') AS BIGINT) AS TotalLibrarians FROM employee""")
def _a1(t, spark):
    return figures.total_librarians(t)


@query("a2_total_books", """SELECT count(*) AS TotalBooks FROM book""")
def _a2(t, spark):
    return figures.total_books(t)


@query("a3_books_added_this_month", """SELECT count(DISTINCT EntityID) AS BooksAddedThisMonth FROM processed_by
 WHERE EntityType = 'Book' AND ActionDate BETWEEN {M0} AND {D}""")
def _a3(t, spark):
    return figures.books_added_this_month(t, AS_OF)


@query("a4_member_totals", """SELECT count(*) AS TotalMembers,
 CAST(count(*) FILTER (WHERE MembershipDate BETWEEN {M0} AND {D}) AS BIGINT) AS NewThisMonth FROM library_user""")
def _a4(t, spark):
    return figures.member_totals(t, AS_OF)


@query("a5_total_revenue", """SELECT CAST(coalesce(sum(AmountPaid), 0) AS DECIMAL(18,2)) AS TotalRevenue FROM payment""")
def _a5(t, spark):
    return figures.total_revenue(t)


@query("a6_librarian_roster", f"""SELECT {_code('L', 'EmployeeID', 3)} AS Code, EmployeeID, Name, Email, Position, AccessLevel
 FROM employee WHERE Role = 'Librarian'""")
def _a6(t, spark):
    return figures.librarian_roster(t)


@query("a7_monthly_revenue", """SELECT CAST(date_trunc('month', PaymentDate) AS DATE) AS Month, PaymentMethod,
 count(*) AS Payments, CAST(coalesce(sum(AmountPaid), 0) AS DECIMAL(18,2)) AS Amount FROM payment GROUP BY 1, 2""")
def _a7(t, spark):
    return figures.monthly_revenue(t)


@query("a7_monthly_revenue_period", """SELECT CAST(date_trunc('month', PaymentDate) AS DATE) AS Month, PaymentMethod,
 count(*) AS Payments, CAST(coalesce(sum(AmountPaid), 0) AS DECIMAL(18,2)) AS Amount FROM payment
 WHERE PaymentDate BETWEEN DATE '2001-01-01' AND DATE '2001-12-31' GROUP BY 1, 2""")
def _a7p(t, spark):
    """Monthly revenue report for the calendar year 2001 (period pushed to the scan)."""
    return figures.monthly_revenue(t, "2001-01-01", "2001-12-31")


@query("a8_inventory_report", """SELECT Genre, Status, count(*) AS Books,
 round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY Genre) AS DOUBLE), 4) AS ShareOfGenre
 FROM book GROUP BY Genre, Status""")
def _a8(t, spark):
    return figures.inventory_report(t)


@query("a9_recent_reports", f"""WITH top AS (SELECT ReportID, Type, GenerationDate, GeneratedBy FROM report
   WHERE GenerationDate <= {{D}} ORDER BY GenerationDate DESC, ReportID DESC LIMIT 10)
SELECT row_number() OVER (ORDER BY r.GenerationDate DESC, r.ReportID DESC) AS RowNo,
 r.ReportID, r.Type, r.GenerationDate, r.GeneratedBy, e.Name AS Author,
 CAST(date_diff('day', r.GenerationDate, {{D}}) AS INTEGER) AS AgeDays, {_age('r.GenerationDate')} AS Age
 FROM top r LEFT JOIN employee e ON r.GeneratedBy = e.EmployeeID""")
def _a9(t, spark):
    return figures.recent_reports(t, AS_OF, 10)


@query("a10_activity_log", """WITH top AS (SELECT * FROM processed_by WHERE ActionDate <= {D}
   ORDER BY ActionDate DESC, ProcessID DESC LIMIT 20)
SELECT row_number() OVER (ORDER BY a.ActionDate DESC, a.ProcessID DESC) AS RowNo,
 a.ProcessID, a.EmployeeID, e.Name AS EmployeeName, a.EntityType, a.EntityID, a.ActionDate,
 CAST(date_diff('day', a.ActionDate, {D}) AS INTEGER) AS AgeDays
 FROM top a LEFT JOIN employee e ON a.EmployeeID = e.EmployeeID""")
def _a10(t, spark):
    return figures.activity_log(t, AS_OF, 20)


@query("a11_resolve_processed", """WITH tg AS (SELECT DISTINCT * FROM (SELECT 'Loan' AS _type, LoanID AS _id FROM loan
   UNION ALL SELECT 'Reservation', ReservationID FROM reservation))
SELECT pb.EntityType, count(*) AS Actions, count(tg._id) AS Resolved,
 CAST(count(*) FILTER (WHERE tg._id IS NULL) AS BIGINT) AS Unresolved
 FROM processed_by pb LEFT JOIN tg ON pb.EntityType = tg._type AND pb.EntityID = tg._id GROUP BY pb.EntityType""")
def _a11(t, spark):
    return figures.resolve_processed(t)


@query("a12_staff_activity", """WITH a AS (SELECT EmployeeID, count(*) FILTER (WHERE EntityType = 'Loan') AS l,
   count(*) FILTER (WHERE EntityType = 'Reservation') AS r, count(*) FILTER (WHERE EntityType = 'Book') AS b, count(*) AS n
   FROM processed_by GROUP BY EmployeeID)
SELECT e.EmployeeID, e.Name, CAST(coalesce(a.l, 0) AS BIGINT) AS LoanActions,
 CAST(coalesce(a.r, 0) AS BIGINT) AS ReservationActions, CAST(coalesce(a.b, 0) AS BIGINT) AS BookActions,
 CAST(coalesce(a.n, 0) AS BIGINT) AS TotalActions
 FROM employee e LEFT JOIN a ON e.EmployeeID = a.EmployeeID""")
def _a12(t, spark):
    return figures.staff_activity(t)


# ======================================================= L: librarian ======
@query("l1_checked_out_on", """SELECT count(*) AS CheckedOutToday FROM loan_item i JOIN loan l ON i.LoanID = l.LoanID
 WHERE l.CheckoutDate = {D}""")
def _l1(t, spark):
    return figures.checked_out_on(t, AS_OF)


@query("l2_active_members", """SELECT CAST(count(*) FILTER (WHERE AccountStatus = 'Active') AS BIGINT) AS ActiveMembers,
 CAST(count(*) FILTER (WHERE MembershipDate = {D}) AS BIGINT) AS JoinedToday FROM library_user""")
def _l2(t, spark):
    return figures.active_members(t, AS_OF)


@query("l3_due_today_count", """SELECT count(*) AS DueToday FROM loan l JOIN loan_item i ON l.LoanID = i.LoanID
 CROSS JOIN policy p WHERE {OPEN} AND {DUE} = {D}""".replace("{OPEN}", OPEN).replace("{DUE}", DUE))
def _l3(t, spark):
    return figures.due_today_count(t, AS_OF, _pol(t))


@query("l4_pending_fines", """SELECT CAST(coalesce(sum(Amount), 0) AS DECIMAL(18,2)) AS UnpaidTotal,
 count(DISTINCT UserID) AS MembersOwing FROM fine WHERE Status = 'Unpaid'""")
def _l4(t, spark):
    return figures.pending_fines(t)


TX_SQL = """items AS (SELECT l.LoanID, l.UserID, l.CheckoutDate, l.DueDate, l.ReturnDate, i.ISBN
   FROM loan l JOIN loan_item i ON l.LoanID = i.LoanID WHERE l.CheckoutDate <= {D}),
 tx AS (SELECT LoanID, UserID, ISBN, 'Borrow' AS TxType, CheckoutDate AS TxDate, DueDate,
   CASE WHEN ReturnDate IS NOT NULL AND ReturnDate <= {D} THEN 'Returned' ELSE 'Active' END AS Status FROM items
   UNION ALL SELECT LoanID, UserID, ISBN, 'Return', ReturnDate, CAST(NULL AS DATE), 'Returned' FROM items
   WHERE ReturnDate IS NOT NULL AND ReturnDate <= {D})"""
TX_ENRICH = f"""SELECT row_number() OVER (ORDER BY t.TxDate DESC, t.LoanID DESC, t.TxType, t.ISBN) AS RowNo,
 {_code('#TRX', 't.LoanID', 3)} AS TransactionID, t.LoanID, t.UserID, u.Name AS Member, t.ISBN, b.Title,
 t.TxType, t.TxDate, t.DueDate, t.Status
 FROM top t LEFT JOIN library_user u ON t.UserID = u.UserID LEFT JOIN book b ON t.ISBN = b.ISBN"""


@query("l5_recent_transactions", f"""WITH {TX_SQL},
 top AS (SELECT * FROM tx ORDER BY TxDate DESC, LoanID DESC, TxType, ISBN LIMIT 10)
{TX_ENRICH}""")
def _l5(t, spark):
    return figures.recent_transactions(t, AS_OF, 10)


@query("l6_transaction_history", f"""WITH {TX_SQL},
 top AS (SELECT * FROM tx WHERE TxDate BETWEEN DATE '2001-07-01' AND {{D}}
   ORDER BY TxDate DESC, LoanID DESC, TxType, ISBN LIMIT 100)
{TX_ENRICH}""")
def _l6(t, spark):
    """Transactions of July 2001, first page of 100 rows in L5 order."""
    return figures.transaction_history(t, AS_OF, date_from="2001-07-01", date_to=AS_OF, page=100)


@query("l6_transaction_history_next_page", f"""WITH {TX_SQL},
 top AS (SELECT * FROM tx WHERE TxDate BETWEEN DATE '2001-07-01' AND {{D}} AND TxType = 'Return'
   AND (TxDate < DATE '2001-07-20'
        OR (TxDate = DATE '2001-07-20' AND LoanID < 2147483647)
        OR (TxDate = DATE '2001-07-20' AND LoanID = 2147483647 AND TxType > 'Return')
        OR (TxDate = DATE '2001-07-20' AND LoanID = 2147483647 AND TxType = 'Return' AND ISBN > ''))
   ORDER BY TxDate DESC, LoanID DESC, TxType, ISBN LIMIT 25)
{TX_ENRICH}""")
def _l6b(t, spark):
    """Returns of July 2001, the 25-row page that follows the cursor
    (2001-07-20, LoanID 2147483647, 'Return', '') in L5 order."""
    return figures.transaction_history(t, AS_OF, date_from="2001-07-01", date_to=AS_OF, tx_type="Return",
                                       after=("2001-07-20", 2147483647, "Return", ""), page=25)


@query("l7_books_due", f"""WITH l AS (SELECT l.LoanID, l.UserID, {DUE} AS DueDate FROM loan l CROSS JOIN policy p WHERE {OPEN})
SELECT l.LoanID, i.ISBN, b.Title, l.UserID, u.Name AS Borrower, {_code('M', 'l.UserID', 4)} AS MemberCode, l.DueDate
 FROM l JOIN loan_item i ON l.LoanID = i.LoanID LEFT JOIN library_user u ON l.UserID = u.UserID
 LEFT JOIN book b ON i.ISBN = b.ISBN WHERE l.DueDate = {{D}}""".replace("{OPEN}", OPEN))
def _l7(t, spark):
    return figures.books_due(t, AS_OF, _pol(t))


@query("l8_member_activity", """WITH ev AS (
   SELECT 'Registration' AS Kind, MembershipDate AS EventDate, UserID AS RefID, UserID, CAST(NULL AS INTEGER) AS FineID,
     CAST(NULL AS DECIMAL(8,2)) AS Amount FROM library_user WHERE MembershipDate <= {D}
   UNION ALL SELECT 'Payment', PaymentDate, PaymentID, CAST(NULL AS INTEGER), FineID, AmountPaid FROM payment WHERE PaymentDate <= {D}),
 top AS (SELECT * FROM ev ORDER BY EventDate DESC, Kind, RefID LIMIT 10),
 en AS (SELECT t.Kind, t.EventDate, t.RefID, coalesce(t.UserID, f.UserID) AS UserID, t.Amount
   FROM top t LEFT JOIN fine f ON t.FineID = f.FineID)
SELECT row_number() OVER (ORDER BY en.EventDate DESC, en.Kind, en.RefID) AS RowNo,
 en.Kind, en.EventDate, en.RefID, en.UserID, u.Name AS Member, en.Amount,
 CASE WHEN en.Kind = 'Registration' THEN 'New Member Registration' ELSE 'Fine Payment' END AS Title,
 CASE WHEN en.Kind = 'Registration' THEN coalesce(u.Name, 'Unknown member') || ' registered as a new member'
      ELSE coalesce(u.Name, 'Unknown member') || ' paid $' || format('{:,.2f}', CAST(en.Amount AS DOUBLE)) || ' in late fees' END AS Message,
 CAST(date_diff('day', en.EventDate, {D}) AS INTEGER) AS AgeDays
 FROM en LEFT JOIN library_user u ON en.UserID = u.UserID""")
def _l8(t, spark):
    return figures.member_activity(t, AS_OF, 10)


@query("l9_member_list", f"""WITH ob AS ({OPEN_BOOKS}),
 uf AS (SELECT UserID, sum(Amount) AS s FROM fine WHERE Status = 'Unpaid' GROUP BY UserID)
SELECT {_code('M', 'u.UserID', 4)} AS MemberCode, u.UserID, u.Name, u.AccountStatus, u.City,
 coalesce(ob.OpenBooks, 0) AS OpenBooks, CAST(coalesce(uf.s, 0) AS DECIMAL(18,2)) AS UnpaidFines
 FROM library_user u LEFT JOIN ob ON u.UserID = ob.UserID LEFT JOIN uf ON u.UserID = uf.UserID""")
def _l9(t, spark):
    return figures.member_list(t, AS_OF)


AUTHORS_SQL = """authors AS (SELECT ISBN, string_agg(AuthorName, '; ' ORDER BY AuthorName) AS Authors, count(*) AS AuthorCount
   FROM (SELECT DISTINCT ISBN, AuthorName FROM (SELECT ISBN, Author AS AuthorName FROM book
         UNION ALL SELECT ISBN, AuthorName FROM book_authors) WHERE AuthorName IS NOT NULL) GROUP BY ISBN)"""


@query("l10_browse_catalog", f"""WITH {AUTHORS_SQL}
SELECT b.ISBN, b.Title, b.PublicationYear, b.Genre, b.Status, a.Authors FROM book b LEFT JOIN authors a ON b.ISBN = a.ISBN
 WHERE b.Genre = 'MEDIUM' AND b.Title ILIKE '%widget%' AND b.PublicationYear BETWEEN 1960 AND 1990""")
def _l10(t, spark):
    """Catalogue search: genre MEDIUM, title like '%widget%', years 1960-1990."""
    return figures.browse_catalog(t, genre="MEDIUM", title_like="%widget%", year_range=(1960, 1990))


@query("l10_browse_catalog_index", f"""WITH {AUTHORS_SQL}
SELECT b.ISBN, b.Title, b.PublicationYear, b.Genre, b.Status, a.Authors FROM book b LEFT JOIN authors a ON b.ISBN = a.ISBN
 WHERE b.Title ILIKE '%wid_et%'""")
def _l10x(t, spark):
    """Catalogue search for '%wid_et%' by a gram index that was built from two batches of titles."""
    from circula.operators.title_index import add_titles
    from circula.sources.paths import scratch_dir
    path = scratch_dir(spark, "l10-index")
    titles = t["book"].select("ISBN", "Title")
    half = F.pmod(F.xxhash64("ISBN"), F.lit(2)) == 0
    add_titles(titles.filter(half), path)
    return figures.browse_catalog(t, title_like="%wid_et%", title_index=add_titles(titles.filter(~half), path))


@query("l11_book_authors_list", f"""WITH {AUTHORS_SQL} SELECT ISBN, Authors, AuthorCount FROM authors""")
def _l11(t, spark):
    return figures.book_authors_list(t)


# ========================================================== U: member ======
@query("u1_borrowed_count", f"""WITH ob AS ({OPEN_BOOKS})
SELECT u.UserID, coalesce(ob.OpenBooks, 0) AS OpenBooks, p.MaxBooks,
 CAST(greatest(p.MaxBooks - coalesce(ob.OpenBooks, 0), 0) AS BIGINT) AS Remaining
 FROM library_user u LEFT JOIN ob ON u.UserID = ob.UserID CROSS JOIN policy p""")
def _u1(t, spark):
    return member.borrowed_count(t, _pol(t), AS_OF)


@query("u2_due_soon", """WITH l AS (SELECT l.LoanID, l.UserID, {DUE} AS DueDate FROM loan l CROSS JOIN policy p WHERE {OPEN})
SELECT l.UserID, count(*) AS DueSoonItems, CAST(min(date_diff('day', {D}, l.DueDate)) AS INTEGER) AS NearestDueInDays
 FROM l JOIN loan_item i ON l.LoanID = i.LoanID WHERE l.DueDate BETWEEN {D} AND {D} + 3 GROUP BY l.UserID"""
       .replace("{DUE}", DUE).replace("{OPEN}", OPEN))
def _u2(t, spark):
    return member.due_soon(t, AS_OF, _pol(t), 3)


U3_SQL = """SELECT i.ISBN, r.ReservationID, r.UserID, r.ReservationDate,
 row_number() OVER (PARTITION BY i.ISBN ORDER BY r.ReservationDate ASC NULLS LAST, r.ReservationID) AS QueuePosition
 FROM reservation_item i JOIN reservation r ON i.ReservationID = r.ReservationID
 WHERE r.Status = 'Active' AND (r.ExpiryDate IS NULL OR r.ExpiryDate >= {D})"""


@query("u3_waiting_list", U3_SQL)
def _u3(t, spark):
    return member.waiting_list(t, AS_OF)


@query("u3_reservations_per_member", """WITH q AS (SELECT i.ISBN, r.ReservationID, r.UserID,
   row_number() OVER (PARTITION BY i.ISBN ORDER BY r.ReservationDate ASC NULLS LAST, r.ReservationID) AS QueuePosition
   FROM reservation_item i JOIN reservation r ON i.ReservationID = r.ReservationID
   WHERE r.Status = 'Active' AND (r.ExpiryDate IS NULL OR r.ExpiryDate >= {D}))
SELECT UserID, count(*) AS ReservedItems, min(QueuePosition) AS BestQueuePosition FROM q GROUP BY UserID""")
def _u3m(t, spark):
    return member.reservations_per_member(t, AS_OF)


@query("u4_fine_balance", """WITH f AS (SELECT UserID, sum(Amount) AS amt, count(*) AS n FROM fine WHERE Status = 'Unpaid' GROUP BY UserID)
SELECT u.UserID, CAST(coalesce(f.amt, 0) AS DECIMAL(18,2)) AS UnpaidAmount, coalesce(f.n, 0) AS UnpaidFines
 FROM library_user u LEFT JOIN f ON u.UserID = f.UserID""")
def _u4(t, spark):
    return member.fine_balance(t)


@query("u5_current_loans", """WITH l AS (SELECT l.LoanID, l.UserID, l.CheckoutDate, l.ReturnDate, {DUE} AS DueDate
   FROM loan l CROSS JOIN policy p WHERE {OPEN})
SELECT l.UserID, l.LoanID, i.ISBN, b.Title, l.CheckoutDate AS BorrowedOn, l.DueDate,
 CASE WHEN l.ReturnDate IS NOT NULL AND l.ReturnDate <= {D} THEN 'Returned' WHEN l.DueDate > {D} THEN 'On Time'
      WHEN l.DueDate = {D} THEN 'Due Today' ELSE 'Overdue' END AS Status
 FROM l JOIN loan_item i ON l.LoanID = i.LoanID LEFT JOIN book b ON i.ISBN = b.ISBN""".replace("{DUE}", DUE).replace("{OPEN}", OPEN))
def _u5(t, spark):
    return member.current_loans(t, AS_OF, _pol(t))


@query("u6_reading_history", """WITH x AS (SELECT l.UserID, l.LoanID, i.ISBN, l.ReturnDate,
   row_number() OVER (PARTITION BY l.UserID ORDER BY l.ReturnDate DESC, l.LoanID DESC, i.ISBN) AS RankNo
   FROM loan l JOIN loan_item i ON l.LoanID = i.LoanID WHERE l.ReturnDate IS NOT NULL)
SELECT x.UserID, x.RankNo, x.LoanID, x.ISBN, b.Title, b.Author, x.ReturnDate FROM x LEFT JOIN book b ON x.ISBN = b.ISBN
 WHERE x.RankNo <= 5""")
def _u6(t, spark):
    return member.reading_history(t, 5)


@query("u7_recommend_books", """WITH h AS (SELECT DISTINCT l.UserID, i.ISBN FROM loan l JOIN loan_item i ON l.LoanID = i.LoanID
   WHERE l.CheckoutDate <= {D}),
 e AS (SELECT ISBN, RelatedISBN FROM related_books WHERE ISBN <> RelatedISBN
   UNION SELECT RelatedISBN, ISBN FROM related_books WHERE ISBN <> RelatedISBN),
 pairs AS (SELECT h.UserID, h.ISBN AS src, e.RelatedISBN AS cand FROM h JOIN e ON h.ISBN = e.ISBN
   UNION SELECT h.UserID, h.ISBN, c.ISBN FROM h JOIN book b ON h.ISBN = b.ISBN JOIN book c ON b.Author = c.Author),
 scored AS (SELECT p.UserID, p.cand AS ISBN, count(DISTINCT p.src) AS Score FROM pairs p JOIN book c ON p.cand = c.ISBN
   WHERE c.Status = 'Available' AND NOT EXISTS (SELECT 1 FROM h h2 WHERE h2.UserID = p.UserID AND h2.ISBN = p.cand)
   GROUP BY p.UserID, p.cand),
 ranked AS (SELECT s.UserID, s.ISBN, s.Score, row_number() OVER (PARTITION BY s.UserID ORDER BY s.Score DESC, s.ISBN) AS RankNo
   FROM scored s)
SELECT r.UserID, r.RankNo, r.ISBN, b.Title, b.Author, r.Score FROM ranked r JOIN book b ON r.ISBN = b.ISBN WHERE r.RankNo <= 5""")
def _u7(t, spark):
    return member.recommend_books(t, 5, AS_OF)


@query("u3_waiting_list_changed", U3_SQL)
def _u3c(t, spark):
    """The queues kept by days: numbered once up to 2001-06, then changed by the reservations of three later periods, the
    last of which brings back some that had been left out."""
    items = member.queue_items(t, AS_OF).checkpoint(eager=True)  # every period reads it
    day, late = F.col("ReservationDate"), F.col("ReservationID") % 17 == 5
    cuts = ["2001-06-01", "2001-07-01", "2001-07-20"]
    start = items.filter((day < F.lit(cuts[0])) & ~late)
    queue = member.sequence_numbers(start, [day.asc_nulls_last(), F.col("ReservationID")], ["ISBN"], "QueuePosition")
    counts = member.queue_counts(start)
    for lo, hi in ((cuts[0], cuts[1]), (cuts[1], cuts[2])):
        queue, counts = member.change_queue(queue, counts, items.filter((day >= F.lit(lo)) & (day < F.lit(hi)) & ~late))
    rest = items.filter(late | day.isNull() | (day >= F.lit(cuts[2])))
    return member.change_queue(queue, counts, rest)[0].select("ISBN", "ReservationID", "UserID", "ReservationDate", "QueuePosition")


# ==================================================== C: reconcile ======
@query("c1_fine_amount_drift_ranges", """WITH f AS (SELECT LoanID, sum(Amount) AS total FROM fine GROUP BY LoanID)
SELECT * FROM (SELECT coalesce(l.LoanID, f.LoanID) AS LoanID, CAST(coalesce(l.FineAmount, 0) AS DECIMAL(18,2)) AS LoanFineAmount,
 CAST(coalesce(f.total, 0) AS DECIMAL(18,2)) AS FineTotal, l.LoanID IS NOT NULL AS LoanExists
 FROM loan l FULL OUTER JOIN f ON l.LoanID = f.LoanID) WHERE LoanFineAmount <> FineTotal""")
def _c1r(t, spark):
    """C1 by checksums of 16 LoanIDs: rows are joined only where the sides disagree."""
    return reconcile.fine_amount_drift(t, range_size=16)


@query("c2_fine_settlement_drift_ranges", """WITH p AS (SELECT FineID, sum(AmountPaid) AS paid FROM payment GROUP BY FineID),
 x AS (SELECT f.FineID, f.LoanID, f.UserID, f.Status, CAST(f.Amount AS DECIMAL(18,2)) AS Amount,
   CAST(coalesce(p.paid, 0) AS DECIMAL(18,2)) AS Paid, CAST(f.Amount - coalesce(p.paid, 0) AS DECIMAL(18,2)) AS Balance
   FROM fine f LEFT JOIN p ON f.FineID = p.FineID)
SELECT *, CASE WHEN Status = 'Paid' AND Balance > 0 THEN 'Paid with balance'
  WHEN Status = 'Unpaid' AND Balance <= 0 THEN 'Unpaid but settled' END AS Issue FROM x
 WHERE (Status = 'Paid' AND Balance > 0) OR (Status = 'Unpaid' AND Balance <= 0)""")
def _c2r(t, spark):
    """C2 by checksums of 16 FineIDs."""
    return reconcile.fine_settlement_drift(t, range_size=16)


@query("c1_fine_amount_drift", """WITH f AS (SELECT LoanID, sum(Amount) AS total FROM fine GROUP BY LoanID)
SELECT * FROM (SELECT coalesce(l.LoanID, f.LoanID) AS LoanID, CAST(coalesce(l.FineAmount, 0) AS DECIMAL(18,2)) AS LoanFineAmount,
 CAST(coalesce(f.total, 0) AS DECIMAL(18,2)) AS FineTotal, l.LoanID IS NOT NULL AS LoanExists
 FROM loan l FULL OUTER JOIN f ON l.LoanID = f.LoanID) WHERE LoanFineAmount <> FineTotal""")
def _c1(t, spark):
    return reconcile.fine_amount_drift(t)


@query("c2_fine_settlement_drift", """WITH p AS (SELECT FineID, sum(AmountPaid) AS paid FROM payment GROUP BY FineID),
 x AS (SELECT f.FineID, f.LoanID, f.UserID, f.Status, CAST(f.Amount AS DECIMAL(18,2)) AS Amount,
   CAST(coalesce(p.paid, 0) AS DECIMAL(18,2)) AS Paid, CAST(f.Amount - coalesce(p.paid, 0) AS DECIMAL(18,2)) AS Balance
   FROM fine f LEFT JOIN p ON f.FineID = p.FineID)
SELECT *, CASE WHEN Status = 'Paid' AND Balance > 0 THEN 'Paid with balance'
  WHEN Status = 'Unpaid' AND Balance <= 0 THEN 'Unpaid but settled' END AS Issue FROM x
 WHERE (Status = 'Paid' AND Balance > 0) OR (Status = 'Unpaid' AND Balance <= 0)""")
def _c2(t, spark):
    return reconcile.fine_settlement_drift(t)


@query("c3_book_status_drift", """WITH ol AS (SELECT DISTINCT i.ISBN FROM loan_item i JOIN loan l ON i.LoanID = l.LoanID WHERE {OPEN}),
 rv AS (SELECT DISTINCT i.ISBN FROM reservation_item i JOIN reservation r ON i.ReservationID = r.ReservationID
   WHERE r.Status = 'Active' AND (r.ExpiryDate IS NULL OR r.ExpiryDate >= {D})),
 d AS (SELECT b.ISBN, b.Status AS StoredStatus, CASE WHEN b.Status = 'Lost' THEN 'Lost' WHEN ol.ISBN IS NOT NULL THEN 'Borrowed'
   WHEN rv.ISBN IS NOT NULL THEN 'Reserved' ELSE 'Available' END AS DerivedStatus
   FROM book b LEFT JOIN ol ON b.ISBN = ol.ISBN LEFT JOIN rv ON b.ISBN = rv.ISBN)
SELECT * FROM d WHERE StoredStatus IS DISTINCT FROM DerivedStatus""".replace("{OPEN}", OPEN))
def _c3(t, spark):
    return reconcile.book_status_drift(t, AS_OF)


@query("c4_author_drift", """SELECT b.ISBN, b.Title, b.Author FROM book b WHERE b.Author IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM book_authors a WHERE a.ISBN = b.ISBN AND a.AuthorName = b.Author)""")
def _c4(t, spark):
    return reconcile.author_drift(t)


@query("c5_stale_reservations", """SELECT * FROM reservation WHERE Status = 'Active' AND ExpiryDate < {D}""")
def _c5(t, spark):
    return reconcile.stale_reservations(t, AS_OF)


@query("c6_fine_user_drift", """SELECT f.FineID, f.LoanID, f.UserID AS FineUserID, l.UserID AS LoanUserID
 FROM raw_fine f JOIN loan l ON f.LoanID = l.LoanID WHERE f.UserID <> l.UserID""")
def _c6(t, spark):
    """Runs on the dirty ``raw_fine`` input, where user mismatches are seeded."""
    return reconcile.fine_user_drift(t["raw_fine"], t["loan"])


@query("c7_symmetric_related", """SELECT ISBN, RelatedISBN FROM related_books WHERE ISBN <> RelatedISBN
 UNION SELECT RelatedISBN, ISBN FROM related_books WHERE ISBN <> RelatedISBN""")
def _c7(t, spark):
    return reconcile.symmetric_related(t)


# ================================================ Q: ingest & quality ======
def _key(*cols: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in cols)


@query("q1_apply_defaults", """SELECT UserID, Name, Email, Phone, CAST(NULL AS VARCHAR) AS Street, City, Zip,
 'Active' AS AccountStatus, MembershipDate FROM raw_user""")
def _q1(t, spark):
    """Raw member rows (no Street, no AccountStatus) completed with defaults."""
    return quality.apply_defaults(t["raw_user"], "library_user", AS_OF)


@query("q2_check_primary_key", f"""SELECT 'loan_item' AS table_name, 'PRIMARY KEY' AS rule, {_key('LoanID', 'ISBN')} AS row_key,
 'null key' AS detail FROM raw_loan_item WHERE LoanID IS NULL OR ISBN IS NULL
UNION ALL SELECT 'loan_item', 'PRIMARY KEY', {_key('LoanID', 'ISBN')}, 'repeated ' || CAST(n AS VARCHAR) || ' times'
 FROM (SELECT LoanID, ISBN, count(*) AS n FROM raw_loan_item WHERE LoanID IS NOT NULL AND ISBN IS NOT NULL
       GROUP BY LoanID, ISBN HAVING count(*) > 1)""")
def _q2(t, spark):
    return quality.check_primary_key(t["raw_loan_item"], "loan_item")


@query("q3_check_unique", f"""SELECT 'library_user' AS table_name, 'UNIQUE(Email)' AS rule, {_key('u.UserID')} AS row_key,
 r.Email || ' x' || CAST(r.n AS VARCHAR) AS detail
 FROM raw_user u JOIN (SELECT Email, count(*) AS n FROM raw_user WHERE Email IS NOT NULL GROUP BY Email HAVING count(*) > 1) r
 ON u.Email = r.Email""")
def _q3(t, spark):
    return quality.check_unique(t["raw_user"], "library_user")


def _not_null_sql(src: str, tname: str, pk: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{tname}' AS table_name, 'NOT NULL({c})' AS rule, {_key(pk)} AS row_key, '{c}' AS detail "
        f"FROM {src} WHERE {c} IS NULL" for c in cols)


@query("q4_check_not_null", _not_null_sql("raw_fine", "fine", "FineID", ["LoanID", "UserID", "Amount"]))
def _q4(t, spark):
    return quality.check_not_null(t["raw_fine"], "fine")


@query("q5_check_length", "\nUNION ALL ".join(
    f"SELECT 'library_user' AS table_name, 'LENGTH({c}<={n})' AS rule, {_key('UserID')} AS row_key, "
    f"'{c}: ' || CAST(length({c}) AS VARCHAR) || ' > {n}' AS detail FROM raw_user WHERE length({c}) > {n}"
    for c, n in [("Name", 100), ("Email", 100), ("Phone", 20), ("City", 50), ("Zip", 10)]))
def _q5(t, spark):
    return quality.check_length(t["raw_user"], "library_user")


@query("q6_check_enum", f"""SELECT 'book' AS table_name, 'ENUM(Status)' AS rule, {_key('ISBN')} AS row_key,
 'Status=' || Status AS detail FROM raw_book
 WHERE Status IS NOT NULL AND Status NOT IN ('Available', 'Borrowed', 'Reserved', 'Lost')""")
def _q6(t, spark):
    return quality.check_enum(t["raw_book"], "book")


@query("q7_check_decimal", f"""SELECT 'fine' AS table_name, 'DECIMAL(Amount,8,2)' AS rule, {_key('FineID')} AS row_key,
 'Amount=' || CAST(Amount AS VARCHAR) AS detail FROM raw_fine WHERE abs(Amount) >= 1000000""")
def _q7(t, spark):
    return quality.check_decimal(t["raw_fine"], "fine")


@query("q8_check_year", f"""SELECT 'book' AS table_name, 'YEAR(PublicationYear)' AS rule, {_key('ISBN')} AS row_key,
 'PublicationYear=' || CAST(PublicationYear AS VARCHAR) AS detail FROM raw_book
 WHERE PublicationYear IS NOT NULL AND NOT (PublicationYear BETWEEN 1901 AND 2155 OR PublicationYear = 0)""")
def _q8(t, spark):
    return quality.check_year(t["raw_book"], "book")


@query("q9_check_foreign_key", f"""SELECT 'fine' AS table_name, 'FOREIGN KEY(LoanID->loan)' AS rule, {_key('f.FineID')} AS row_key,
 'LoanID=' || {_key('f.LoanID')} AS detail FROM raw_fine f
 WHERE f.LoanID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM loan l WHERE l.LoanID = f.LoanID)
UNION ALL SELECT 'fine', 'FOREIGN KEY(UserID->library_user)', {_key('f.FineID')}, 'UserID=' || {_key('f.UserID')} FROM raw_fine f
 WHERE f.UserID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM library_user u WHERE u.UserID = f.UserID)""")
def _q9(t, spark):
    return quality.check_foreign_key(t["raw_fine"], {"loan": t["loan"], "library_user": t["library_user"]}, "fine")


Q10_FLAGS = """WITH rep AS (SELECT FineID FROM raw_fine WHERE FineID IS NOT NULL GROUP BY FineID HAVING count(*) > 1),
 x AS (SELECT f.*, concat_ws(',',
   CASE WHEN f.FineID IS NULL THEN 'PRIMARY KEY(null)' END,
   CASE WHEN f.FineID IN (SELECT FineID FROM rep) THEN 'PRIMARY KEY(repeated)' END,
   CASE WHEN f.LoanID IS NULL THEN 'NOT NULL(LoanID)' END,
   CASE WHEN f.UserID IS NULL THEN 'NOT NULL(UserID)' END,
   CASE WHEN f.Amount IS NULL THEN 'NOT NULL(Amount)' END,
   CASE WHEN length(f.Description) > 255 THEN 'LENGTH(Description<=255)' END,
   CASE WHEN f.Status NOT IN ('Unpaid', 'Paid') THEN 'ENUM(Status)' END,
   CASE WHEN abs(f.Amount) >= 1000000 THEN 'DECIMAL(Amount,8,2)' END,
   CASE WHEN f.LoanID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM loan l WHERE l.LoanID = f.LoanID) THEN 'FOREIGN KEY(LoanID->loan)' END,
   CASE WHEN f.UserID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM library_user u WHERE u.UserID = f.UserID)
        THEN 'FOREIGN KEY(UserID->library_user)' END) AS BrokenRules FROM raw_fine f)"""


@query("q10_split_valid", Q10_FLAGS + """
SELECT FineID, LoanID, UserID, IssueDate, Amount, Status, Description, BrokenRules FROM x WHERE BrokenRules <> ''""")
def _q10(t, spark):
    """Quarantined raw fines, each with the comma-joined list of broken rules."""
    return quality.split_valid(t, "fine", t["raw_fine"])[1]


@query("q10_split_valid_good", Q10_FLAGS + """
SELECT FineID, LoanID, UserID, IssueDate, Amount, Status, Description FROM x WHERE BrokenRules = ''""")
def _q10g(t, spark):
    """Raw fines that pass every declared rule."""
    return quality.split_valid(t, "fine", t["raw_fine"])[0]


#: The raw fines with values that do not fit their declared types: ids that are too large or have a fraction,
#: days that are none, and times of day.
MISFIT_FINES = """SELECT CASE WHEN FineID % 50 = 3 THEN FineID + 3000000000 ELSE FineID END AS FineID,
   CASE WHEN FineID % 50 = 7 THEN LoanID + CAST(0.9 AS DOUBLE) ELSE CAST(LoanID AS DOUBLE) END AS LoanID,
   CASE WHEN FineID % 50 = 9 THEN '3.9' ELSE CAST(UserID AS VARCHAR) END AS UserID,
   CASE WHEN FineID % 50 = 11 THEN '2001-13-40' WHEN FineID % 50 = 13 THEN CAST(IssueDate AS VARCHAR) || ' 10:30'
    ELSE CAST(IssueDate AS VARCHAR) END AS IssueDate,
   CAST(Amount AS DOUBLE) AS Amount, Status, Description, FineID AS Row FROM raw_fine"""
MISFIT_FLAGS = f"""WITH m AS ({MISFIT_FINES}),
 f AS (SELECT *, CASE WHEN FineID <= 2147483647 THEN FineID END AS fid, CASE WHEN LoanID = floor(LoanID) THEN LoanID END AS lid,
   TRY_CAST(CASE WHEN UserID <> '3.9' THEN UserID END AS INTEGER) AS uid FROM m),
 rep AS (SELECT fid FROM f WHERE fid IS NOT NULL GROUP BY fid HAVING count(*) > 1),
 x AS (SELECT f.*, concat_ws(',',
   CASE WHEN f.fid IS NULL THEN 'PRIMARY KEY(null)' END,
   CASE WHEN f.fid IN (SELECT fid FROM rep) THEN 'PRIMARY KEY(repeated)' END,
   CASE WHEN f.LoanID IS NULL THEN 'NOT NULL(LoanID)' END,
   CASE WHEN f.UserID IS NULL THEN 'NOT NULL(UserID)' END,
   CASE WHEN f.Amount IS NULL THEN 'NOT NULL(Amount)' END,
   CASE WHEN length(f.Description) > 255 THEN 'LENGTH(Description<=255)' END,
   CASE WHEN f.Status NOT IN ('Unpaid', 'Paid') THEN 'ENUM(Status)' END,
   CASE WHEN f.FineID IS NOT NULL AND f.fid IS NULL THEN 'TYPE(FineID int)' END,
   CASE WHEN f.LoanID IS NOT NULL AND f.lid IS NULL THEN 'TYPE(LoanID int)' END,
   CASE WHEN f.UserID IS NOT NULL AND f.uid IS NULL THEN 'TYPE(UserID int)' END,
   CASE WHEN f.Row % 50 IN (11, 13) AND f.IssueDate IS NOT NULL THEN 'TYPE(IssueDate date)' END,
   CASE WHEN abs(f.Amount) >= 1000000 THEN 'DECIMAL(Amount,8,2)' END,
   CASE WHEN f.lid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM loan l WHERE l.LoanID = f.lid) THEN 'FOREIGN KEY(LoanID->loan)' END,
   CASE WHEN f.uid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM library_user u WHERE u.UserID = f.uid)
        THEN 'FOREIGN KEY(UserID->library_user)' END) AS BrokenRules FROM f)"""


def _misfit_fines(t):
    f = t["raw_fine"]
    at = F.col("FineID") % 50
    day = F.col("IssueDate").cast("string")
    return f.select(
        F.when(at == 3, F.col("FineID") + 3_000_000_000).otherwise(F.col("FineID").cast("bigint")).alias("FineID"),
        F.when(at == 7, F.col("LoanID") + F.lit(0.9)).otherwise(F.col("LoanID").cast("double")).alias("LoanID"),
        F.when(at == 9, F.lit("3.9")).otherwise(F.col("UserID").cast("string")).alias("UserID"),
        F.when(at == 11, F.lit("2001-13-40")).when(at == 13, F.concat(day, F.lit(" 10:30"))).otherwise(day).alias("IssueDate"),
        F.col("Amount").cast("double").alias("Amount"), "Status", "Description")


@query("q10_split_valid_types", MISFIT_FLAGS + """
SELECT FineID, LoanID, UserID, IssueDate, Amount, Status, Description, BrokenRules FROM x WHERE BrokenRules <> ''""")
def _q10t(t, spark):
    """Quarantined raw fines of a feed with other types than declared: fractions, too large ids, days that are none and times of day do not fit."""
    return quality.split_valid(t, "fine", _misfit_fines(t))[1]


@query("q10_ingest_types", MISFIT_FLAGS + """
SELECT CAST(fid AS INTEGER) AS FineID, CAST(lid AS INTEGER) AS LoanID, uid AS UserID, CAST(IssueDate AS DATE) AS IssueDate,
 CAST(Amount AS DECIMAL(8,2)) AS Amount, Status, Description FROM x WHERE BrokenRules = ''""")
def _q10it(t, spark):
    """The good rows of that feed after the whole ingest flow, cast to the declared types."""
    from circula.sources.paths import scratch_dir
    base = scratch_dir(spark, "q10-types")
    ingest.ingest_table({"loan": t["loan"], "library_user": t["library_user"]}, "fine", _misfit_fines(t),
                        f"{base}/good", f"{base}/quarantine", AS_OF)
    return spark.read.parquet(f"{base}/good")


@query("q2_check_primary_key_user", f"""SELECT 'library_user' AS table_name, 'PRIMARY KEY' AS rule, {_key('UserID')} AS row_key,
 'null key' AS detail FROM raw_user WHERE UserID IS NULL
UNION ALL SELECT 'library_user', 'PRIMARY KEY', {_key('UserID')}, 'repeated ' || CAST(n AS VARCHAR) || ' times'
 FROM (SELECT UserID, count(*) AS n FROM raw_user WHERE UserID IS NOT NULL GROUP BY UserID HAVING count(*) > 1)""")
def _q2u(t, spark):
    """Repeated member ids in the raw member feed."""
    return quality.check_primary_key(t["raw_user"], "library_user")


@query("q4_check_not_null_book", _not_null_sql("raw_book", "book", "ISBN", ["Title"]))
def _q4b(t, spark):
    """Raw catalogue rows without a Title."""
    return quality.check_not_null(t["raw_book"], "book")


@query("q10_split_valid_user", """WITH rep AS (SELECT UserID FROM raw_user WHERE UserID IS NOT NULL GROUP BY UserID HAVING count(*) > 1),
 rem AS (SELECT Email FROM raw_user WHERE Email IS NOT NULL GROUP BY Email HAVING count(*) > 1),
 x AS (SELECT u.*, concat_ws(',',
   CASE WHEN u.UserID IS NULL THEN 'PRIMARY KEY(null)' END,
   CASE WHEN u.UserID IN (SELECT UserID FROM rep) THEN 'PRIMARY KEY(repeated)' END,
   CASE WHEN u.Email IN (SELECT Email FROM rem) THEN 'UNIQUE(Email)' END,
   CASE WHEN u.Name IS NULL THEN 'NOT NULL(Name)' END,
   CASE WHEN length(u.Name) > 100 THEN 'LENGTH(Name<=100)' END,
   CASE WHEN length(u.Email) > 100 THEN 'LENGTH(Email<=100)' END,
   CASE WHEN length(u.Phone) > 20 THEN 'LENGTH(Phone<=20)' END,
   CASE WHEN length(u.City) > 50 THEN 'LENGTH(City<=50)' END,
   CASE WHEN length(u.Zip) > 10 THEN 'LENGTH(Zip<=10)' END) AS BrokenRules FROM raw_user u)
SELECT UserID, Name, Email, Phone, City, Zip, MembershipDate, BrokenRules FROM x WHERE BrokenRules <> ''""")
def _q10u(t, spark):
    """Quarantined raw member rows (keys, unique e-mail, NOT NULL, lengths)."""
    return quality.split_valid(t, "library_user", t["raw_user"])[1]


@query("q10_split_valid_book", """WITH rep AS (SELECT ISBN FROM raw_book WHERE ISBN IS NOT NULL GROUP BY ISBN HAVING count(*) > 1),
 x AS (SELECT b.*, concat_ws(',',
   CASE WHEN b.ISBN IS NULL THEN 'PRIMARY KEY(null)' END,
   CASE WHEN b.ISBN IN (SELECT ISBN FROM rep) THEN 'PRIMARY KEY(repeated)' END,
   CASE WHEN b.Title IS NULL THEN 'NOT NULL(Title)' END,
   CASE WHEN length(b.ISBN) > 20 THEN 'LENGTH(ISBN<=20)' END,
   CASE WHEN length(b.Title) > 200 THEN 'LENGTH(Title<=200)' END,
   CASE WHEN length(b.Genre) > 100 THEN 'LENGTH(Genre<=100)' END,
   CASE WHEN length(b.Author) > 100 THEN 'LENGTH(Author<=100)' END,
   CASE WHEN b.Status NOT IN ('Available', 'Borrowed', 'Reserved', 'Lost') THEN 'ENUM(Status)' END,
   CASE WHEN NOT (b.PublicationYear BETWEEN 1901 AND 2155 OR b.PublicationYear = 0) THEN 'YEAR(PublicationYear)' END
   ) AS BrokenRules FROM raw_book b)
SELECT ISBN, Title, PublicationYear, Genre, Author, Status, BrokenRules FROM x WHERE BrokenRules <> ''""")
def _q10b(t, spark):
    """Quarantined raw catalogue rows (title, status enum, YEAR range)."""
    return quality.split_valid(t, "book", t["raw_book"])[1]


@query("q10_ingest_table", Q10_FLAGS + """
SELECT FineID, LoanID, UserID, IssueDate, CAST(Amount AS DECIMAL(8,2)) AS Amount, Status, Description FROM x
 WHERE BrokenRules = ''""")
def _q10i(t, spark):
    """Ingest of the raw fine feed from files: S1 load of the raw parquet as
    stored, defaults, all checks in one pass, good rows written with the
    declared types (quarantine written beside them); the good table is read
    back."""
    from circula.sources.paths import scratch_dir
    base = scratch_dir(spark, "q10-ingest")
    t["raw_fine"].write.parquet(f"{base}/raw")
    ingest.ingest_files({"loan": t["loan"], "library_user": t["library_user"]}, "fine", f"{base}/raw",
                        "parquet", f"{base}/good", f"{base}/quarantine", AS_OF)
    return spark.read.parquet(f"{base}/good")


Q13_SQL = """s AS (SELECT SubmissionID, concat_ws(' ', trim(firstName), trim(lastName)) AS Name, lower(trim(email)) AS Email,
   trim(phone) AS Phone, trim(address) AS Street, coalesce(terms, false) AS terms_ok,
   trim(firstName) AS fn, trim(lastName) AS ln FROM raw_signup),
 r1 AS (SELECT *, CASE
   WHEN fn IS NULL OR fn = '' OR ln IS NULL OR ln = '' OR Email IS NULL OR Email = '' OR Phone IS NULL OR Phone = ''
        OR Street IS NULL OR Street = '' THEN 'missing field'
   WHEN NOT terms_ok THEN 'terms not accepted'
   WHEN NOT regexp_matches(Email, '^[^@]+@[^@]+$') THEN 'invalid email'
   WHEN Email IN (SELECT lower(trim(Email)) FROM library_user WHERE Email IS NOT NULL) THEN 'email already registered'
   END AS Reason0 FROM s),
 firsts AS (SELECT Email AS first_email, min(SubmissionID) AS first_id FROM r1 WHERE Reason0 IS NULL GROUP BY Email),
 decided AS (SELECT r1.SubmissionID, Name, Email, Phone, Street,
   coalesce(Reason0, CASE WHEN firsts.first_id IS NULL THEN 'email repeated in batch' END) AS Reason
   FROM r1 LEFT JOIN firsts ON r1.Email = firsts.first_email AND r1.SubmissionID = firsts.first_id)"""


@query("q11_assign_ids", f"""WITH {Q13_SQL}
SELECT CAST(row_number() OVER (ORDER BY SubmissionID, Email, Name, Phone, Street) + (SELECT coalesce(max(UserID), 0) FROM library_user) AS INTEGER) AS UserID,
 Name, Email, Phone, Street, CAST(NULL AS VARCHAR) AS City, CAST(NULL AS VARCHAR) AS Zip, 'Active' AS AccountStatus,
 {{D}} AS MembershipDate FROM decided WHERE Reason IS NULL""")
def _q11(t, spark):
    """Accepted sign-ups (Q13) become User rows with ids continuing max(UserID)."""
    decided = ingest.normalize_signups(t["raw_signup"], t["library_user"], AS_OF)
    return ingest.signups_to_users(decided, t["library_user"], AS_OF)


@query("q12_upsert", """WITH latest AS (SELECT UserID, Name, Email, Phone, City, Zip, MembershipDate FROM (
   SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY MembershipDate DESC NULLS LAST, UserID DESC NULLS LAST,
     Name DESC NULLS LAST, Email DESC NULLS LAST, Phone DESC NULLS LAST, City DESC NULLS LAST, Zip DESC NULLS LAST) AS rn
   FROM raw_user) WHERE rn = 1)
SELECT u.* FROM library_user u WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.UserID = u.UserID)
UNION ALL SELECT l.UserID, l.Name, l.Email, l.Phone, CASE WHEN c.UserID IS NOT NULL THEN c.Street END AS Street, l.City, l.Zip,
 CASE WHEN c.UserID IS NOT NULL THEN c.AccountStatus ELSE 'Active' END AS AccountStatus, l.MembershipDate
 FROM latest l LEFT JOIN library_user c ON l.UserID = c.UserID""")
def _q12(t, spark):
    """Member edits from the raw feed: the last change per UserID wins (by
    MembershipDate, ties to the greatest change row); Street and
    AccountStatus, absent from the feed, keep their current values."""
    return ingest.upsert(t["library_user"], t["raw_user"], ["UserID"], ["MembershipDate"],
                         tname="library_user", as_of=AS_OF)


#: Member edits as a form would send them: days and ids as text or numbers, some of which do not fit.
MISFIT_CHANGES = """SELECT CASE WHEN UserID % 40 = 5 THEN UserID + CAST(0.9 AS DOUBLE) WHEN UserID % 40 = 6 THEN CAST(99999999999 AS DOUBLE)
   ELSE CAST(UserID AS DOUBLE) END AS UserID, Name, Zip,
   CASE WHEN UserID % 40 = 8 THEN '2001-13-40' ELSE CAST(MembershipDate AS VARCHAR) END AS MembershipDate, UserID AS Row FROM raw_user"""
MISFIT_REASONS = f"""WITH m AS ({MISFIT_CHANGES}),
 x AS (SELECT *, concat_ws(',', CASE WHEN UserID IS NULL THEN 'NULL KEY(UserID)' END,
   CASE WHEN Row % 40 IN (5, 6) THEN 'TYPE(UserID int)' END,
   CASE WHEN Row % 40 = 8 THEN 'TYPE(MembershipDate date)' END,
   CASE WHEN Name IS NULL THEN 'NOT NULL(Name)' END,
   CASE WHEN length(Name) > 100 THEN 'LENGTH(Name<=100)' END,
   CASE WHEN length(Zip) > 10 THEN 'LENGTH(Zip<=10)' END) AS Reason FROM m)"""


def _misfit_changes(t):
    at = F.col("UserID") % 40
    return t["raw_user"].select(
        F.when(at == 5, F.col("UserID") + F.lit(0.9)).when(at == 6, F.lit(99999999999.0))
        .otherwise(F.col("UserID").cast("double")).alias("UserID"), "Name", "Zip",
        F.when(at == 8, F.lit("2001-13-40")).otherwise(F.col("MembershipDate").cast("string")).alias("MembershipDate"))


@query("q12_upsert_checked", MISFIT_REASONS + """,
 latest AS (SELECT CAST(UserID AS INTEGER) AS UserID, Name, Zip, CAST(MembershipDate AS DATE) AS MembershipDate FROM (
   SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY CAST(MembershipDate AS DATE) DESC NULLS LAST, Name DESC NULLS LAST,
     Zip DESC NULLS LAST) AS rn FROM x WHERE Reason = '') WHERE rn = 1)
SELECT u.* FROM library_user u WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.UserID = u.UserID)
UNION ALL SELECT l.UserID, l.Name, c.Email, c.Phone, c.Street, c.City, l.Zip,
 CASE WHEN c.UserID IS NOT NULL THEN c.AccountStatus ELSE 'Active' END AS AccountStatus, l.MembershipDate
 FROM latest l LEFT JOIN library_user c ON l.UserID = c.UserID""")
def _q12c(t, spark):
    """Member edits some of whose values do not fit (3.9 for an id, 2001-13-40 for a day) or break a rule: those alone are left out."""
    return ingest.upsert(t["library_user"], _misfit_changes(t), ["UserID"], ["MembershipDate"],
                         tname="library_user", as_of=AS_OF, rules=ingest.CHANGE_RULES)


@query("q12_rejected_changes", MISFIT_REASONS + """
SELECT UserID, Name, Zip, MembershipDate, Reason FROM x WHERE Reason <> ''""")
def _q12r(t, spark):
    """The edits left out, with what is wrong with each."""
    return ingest.rejected_changes(_misfit_changes(t), ["UserID"], t["library_user"], "library_user", ingest.CHANGE_RULES)


@query("q13_normalize_signups", f"""WITH {Q13_SQL}
SELECT SubmissionID, Name, Email, Phone, Street, CASE WHEN Reason IS NULL THEN 'Active' END AS AccountStatus,
 CASE WHEN Reason IS NULL THEN {{D}} END AS MembershipDate, Reason FROM decided""")
def _q13(t, spark):
    return ingest.normalize_signups(t["raw_signup"], t["library_user"], AS_OF)


# ------------------------------------------- every constraint, all tables
@query("q1_apply_defaults_all", constraints.sql_defaults(AS_OF))
def _q1_all(t, spark):
    """All 18 declared defaults: the columns are left out of their tables and filled in."""
    return constraints.default_values(t, AS_OF)


@query("q2_check_primary_key_all", constraints.sql_primary_keys())
def _q2_all(t, spark):
    """All 14 primary keys, on tables with repeated rows and lost key parts."""
    return constraints.check_primary_keys(t)


@query("q4_check_not_null_all", constraints.sql_rows("not_null"))
def _q4_all(t, spark):
    """All NOT NULL columns, on tables with faults."""
    return constraints.check_rows(t, "not_null")


@query("q5_check_length_all", constraints.sql_rows("length"))
def _q5_all(t, spark):
    """All declared text lengths, on tables with faults."""
    return constraints.check_rows(t, "length")


@query("q6_check_enum_all", constraints.sql_rows("enum"))
def _q6_all(t, spark):
    """All enumerations, on tables with faults."""
    return constraints.check_rows(t, "enum")


@query("q7_check_decimal_all", constraints.sql_rows("decimal"))
def _q7_all(t, spark):
    """All decimal columns, on tables with faults."""
    return constraints.check_rows(t, "decimal")


@query("q9_check_foreign_key_all", constraints.sql_foreign_keys())
def _q9_all(t, spark):
    """All 14 foreign keys, on tables with faults."""
    return constraints.check_foreign_keys(t)


# ============================================ R: referential actions ======
def _survivors(tables: dict) -> DataFrame:
    """(table_name, row_key) of every row that an action leaves."""
    from circula.functions.common import key_text
    from circula.schema import TABLES
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(n).alias("table_name"), key_text(*TABLES[n].primary_key).alias("row_key"))
        for n, df in tables.items()])


def _sql_survivors(parts: dict[str, str]) -> str:
    """The same in SQL: per table the condition of the rows that stay."""
    from circula.schema import TABLES
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, concat_ws('|', "
        + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in TABLES[n].primary_key)
        + f") AS row_key FROM {n} WHERE {cond}" for n, cond in parts.items())


_DL = "SELECT LoanID FROM loan WHERE UserID IN (SELECT UserID FROM delete_user)"
_DF = f"SELECT FineID FROM fine WHERE LoanID IN ({_DL}) OR UserID IN (SELECT UserID FROM delete_user)"
_DR = "SELECT ReservationID FROM reservation WHERE UserID IN (SELECT UserID FROM delete_user)"


@query("r4_rekey_books_survivors", """WITH m AS (SELECT DISTINCT OldISBN, NewISBN FROM rekey_book),
 ok AS (SELECT OldISBN, NewISBN FROM m WHERE OldISBN IN (SELECT ISBN FROM book) AND length(NewISBN) <= 20
   AND OldISBN NOT IN (SELECT ISBN FROM related_books) AND OldISBN NOT IN (SELECT RelatedISBN FROM related_books)
   AND OldISBN NOT IN (SELECT ISBN FROM reservation_item) AND OldISBN NOT IN (SELECT ISBN FROM loan_item)
   AND NewISBN NOT IN (SELECT ISBN FROM book)
   AND (SELECT count(*) FROM m x WHERE x.OldISBN = m.OldISBN) = 1 AND (SELECT count(*) FROM m x WHERE x.NewISBN = m.NewISBN) = 1)
SELECT 'book' AS table_name, coalesce(NewISBN, ISBN) AS row_key FROM book LEFT JOIN ok ON ISBN = OldISBN
UNION ALL SELECT 'book_authors', coalesce(NewISBN, ISBN) || '|' || AuthorName FROM book_authors LEFT JOIN ok ON ISBN = OldISBN""")
def _r4s(t, spark):
    """Every book and author row after R4, by its new key."""
    return _survivors(actions.rekey_books(t, t["rekey_book"])[0])


@query("r1_delete_users_survivors", _sql_survivors({
    "library_user": "UserID NOT IN (SELECT UserID FROM delete_user)", "loan": f"LoanID NOT IN ({_DL})",
    "loan_item": f"LoanID NOT IN ({_DL})", "fine": f"FineID NOT IN ({_DF})", "payment": f"FineID NOT IN ({_DF})",
    "reservation": f"ReservationID NOT IN ({_DR})", "reservation_item": f"ReservationID NOT IN ({_DR})"}))
def _r1s(t, spark):
    """Every row that R1 leaves, by table and key."""
    return _survivors(actions.delete_users(t, t["delete_user"])[0])


_GONE = """SELECT b.ISBN FROM book b WHERE b.ISBN IN (SELECT ISBN FROM delete_book)
   AND b.ISBN NOT IN (SELECT ISBN FROM loan_item) AND b.ISBN NOT IN (SELECT ISBN FROM reservation_item)"""


@query("r2_delete_books_survivors", _sql_survivors({
    "book": f"ISBN NOT IN ({_GONE})", "book_authors": f"ISBN NOT IN ({_GONE})",
    "related_books": f"ISBN NOT IN ({_GONE}) AND RelatedISBN NOT IN ({_GONE})"}))
def _r2s(t, spark):
    """Every row that R2 leaves, by table and key."""
    return _survivors(actions.delete_books(t, t["delete_book"])[0])


@query("r3_delete_employees_survivors", _sql_survivors({
    "employee": "EmployeeID NOT IN (SELECT EmployeeID FROM delete_employee)",
    "processed_by": "EmployeeID IS NULL OR EmployeeID NOT IN (SELECT EmployeeID FROM delete_employee)"}) + """
UNION ALL SELECT 'report', concat_ws('|', CAST(ReportID AS VARCHAR), coalesce(CAST(CASE WHEN GeneratedBy IN
 (SELECT EmployeeID FROM delete_employee) THEN NULL ELSE GeneratedBy END AS VARCHAR), 'NULL')) FROM report""")
def _r3s(t, spark):
    """Every row that R3 leaves, by table and key; reports with their author, null if deleted."""
    from circula.functions.common import key_text
    tables = dict(actions.delete_employees(t, t["delete_employee"])[0])
    report = tables.pop("report").select(F.lit("report").alias("table_name"),
                                         key_text("ReportID", "GeneratedBy").alias("row_key"))
    return _survivors(tables).unionByName(report)


_DL5 = "SELECT LoanID FROM loan WHERE LoanID % 37 = 0"
_DF5 = f"SELECT FineID FROM fine WHERE LoanID IN ({_DL5})"


@query("r5_delete_loans_survivors", _sql_survivors({
    "loan": f"LoanID NOT IN ({_DL5})", "loan_item": f"LoanID NOT IN ({_DL5})", "fine": f"FineID NOT IN ({_DF5})",
    "payment": f"FineID NOT IN ({_DF5})"}))
def _r5s(t, spark):
    """Every row that R5 leaves when each 37th loan goes, by table and key."""
    keys = t["loan"].filter(F.col("LoanID") % 37 == 0).select("LoanID")
    return _survivors(actions.delete_loans(t, keys)[0])


_DR5 = "SELECT ReservationID FROM reservation WHERE Status IN ('Cancelled', 'Expired')"


@query("r5_delete_reservations_survivors", _sql_survivors({
    "reservation": f"ReservationID NOT IN ({_DR5})", "reservation_item": f"ReservationID NOT IN ({_DR5})"}))
def _r5rs(t, spark):
    """Every row that the purge of cancelled and expired reservations leaves, by table and key."""
    keys = t["reservation"].filter(F.col("Status").isin("Cancelled", "Expired")).select("ReservationID")
    return _survivors(actions.delete_reservations(t, keys)[0])


@query("r1_published_version", _sql_survivors({"library_user": "UserID NOT IN (SELECT UserID FROM delete_user)"}))
def _r1v(t, spark):
    """The members that R1 leaves, published as a version with its other tables and read back."""
    from circula.sources.paths import scratch_dir
    root = scratch_dir(spark, "r1-version")
    actions.apply_action(actions.delete_users(t, t["delete_user"])[0], root, "1")
    return _survivors({"library_user": actions.read_version(spark, root, "library_user", "1")})


@query("r1_delete_users", """WITH du AS (SELECT UserID FROM library_user WHERE UserID IN (SELECT UserID FROM delete_user)),
 dl AS (SELECT LoanID FROM loan WHERE UserID IN (SELECT UserID FROM du)),
 dfi AS (SELECT FineID FROM fine WHERE LoanID IN (SELECT LoanID FROM dl) OR UserID IN (SELECT UserID FROM du)),
 dr AS (SELECT ReservationID FROM reservation WHERE UserID IN (SELECT UserID FROM du))
SELECT 'library_user' AS table_name, 'DELETE' AS action, count(*) AS row_count FROM du
UNION ALL SELECT 'loan', 'CASCADE', count(*) FROM dl
UNION ALL SELECT 'loan_item', 'CASCADE', count(*) FROM loan_item WHERE LoanID IN (SELECT LoanID FROM dl)
UNION ALL SELECT 'fine', 'CASCADE', count(*) FROM dfi
UNION ALL SELECT 'payment', 'CASCADE', count(*) FROM payment WHERE FineID IN (SELECT FineID FROM dfi)
UNION ALL SELECT 'reservation', 'CASCADE', count(*) FROM dr
UNION ALL SELECT 'reservation_item', 'CASCADE', count(*) FROM reservation_item WHERE ReservationID IN (SELECT ReservationID FROM dr)""")
def _r1(t, spark):
    return actions.delete_users(t, t["delete_user"])[1]


R2_OUTCOMES = """o AS (SELECT k.ISBN, CASE WHEN NOT EXISTS (SELECT 1 FROM book b WHERE b.ISBN = k.ISBN) THEN 'not found'
   WHEN EXISTS (SELECT 1 FROM loan_item i WHERE i.ISBN = k.ISBN) OR EXISTS (SELECT 1 FROM reservation_item r WHERE r.ISBN = k.ISBN)
   THEN 'refused' ELSE 'deleted' END AS Outcome FROM (SELECT DISTINCT ISBN FROM delete_book) k)"""


@query("r2_delete_books", f"""WITH {R2_OUTCOMES},
 g AS (SELECT ISBN FROM o WHERE Outcome = 'deleted')
SELECT 'book' AS table_name, 'DELETE' AS action, count(*) AS row_count FROM book WHERE ISBN IN (SELECT ISBN FROM g)
UNION ALL SELECT 'book', 'REFUSED', count(*) FROM o WHERE Outcome = 'refused'
UNION ALL SELECT 'book_authors', 'CASCADE', count(*) FROM book_authors WHERE ISBN IN (SELECT ISBN FROM g)
UNION ALL SELECT 'related_books', 'CASCADE', count(*) FROM (SELECT DISTINCT ISBN, RelatedISBN FROM related_books
  WHERE ISBN IN (SELECT ISBN FROM g) OR RelatedISBN IN (SELECT ISBN FROM g))""")
def _r2(t, spark):
    return actions.delete_books(t, t["delete_book"])[1]


@query("r2_delete_books_outcomes", f"""WITH {R2_OUTCOMES} SELECT ISBN, Outcome FROM o""")
def _r2o(t, spark):
    return actions.book_delete_outcomes(t, t["delete_book"])


@query("r3_delete_employees", """WITH de AS (SELECT EmployeeID FROM employee WHERE EmployeeID IN (SELECT EmployeeID FROM delete_employee))
SELECT 'employee' AS table_name, 'DELETE' AS action, count(*) AS row_count FROM de
UNION ALL SELECT 'processed_by', 'CASCADE', count(*) FROM processed_by WHERE EmployeeID IN (SELECT EmployeeID FROM de)
UNION ALL SELECT 'report', 'SET NULL', count(*) FROM report WHERE GeneratedBy IN (SELECT EmployeeID FROM de)""")
def _r3(t, spark):
    return actions.delete_employees(t, t["delete_employee"])[1]


@query("r4_rekey_books", """WITH m AS (SELECT DISTINCT OldISBN, NewISBN FROM rekey_book)
SELECT m.OldISBN, m.NewISBN, CASE
  WHEN NOT EXISTS (SELECT 1 FROM book b WHERE b.ISBN = m.OldISBN) THEN 'not found'
  WHEN EXISTS (SELECT 1 FROM related_books r WHERE r.ISBN = m.OldISBN OR r.RelatedISBN = m.OldISBN)
    OR EXISTS (SELECT 1 FROM reservation_item r WHERE r.ISBN = m.OldISBN)
    OR EXISTS (SELECT 1 FROM loan_item i WHERE i.ISBN = m.OldISBN) THEN 'referenced'
  WHEN (SELECT count(*) FROM m m2 WHERE m2.OldISBN = m.OldISBN) > 1
    OR (SELECT count(*) FROM m m3 WHERE m3.NewISBN = m.NewISBN) > 1 THEN 'ambiguous'
  WHEN EXISTS (SELECT 1 FROM book b WHERE b.ISBN = m.NewISBN) THEN 'new key exists'
  ELSE 'renamed' END AS Outcome FROM m""")
def _r4(t, spark):
    return actions.rekey_books(t, t["rekey_book"])[2]


R5_LOAN_SQL = """WITH dl AS (SELECT LoanID FROM loan WHERE ReturnDate < DATE '1996-01-01'),
 dfi AS (SELECT FineID FROM fine WHERE LoanID IN (SELECT LoanID FROM dl))
SELECT 'loan' AS table_name, 'DELETE' AS action, count(*) AS row_count FROM dl
UNION ALL SELECT 'loan_item', 'CASCADE', count(*) FROM loan_item WHERE LoanID IN (SELECT LoanID FROM dl)
UNION ALL SELECT 'fine', 'CASCADE', count(*) FROM dfi
UNION ALL SELECT 'payment', 'CASCADE', count(*) FROM payment WHERE FineID IN (SELECT FineID FROM dfi)"""


@query("r5_delete_loans", R5_LOAN_SQL)
def _r5l(t, spark):
    """Retention purge: loans returned before 1996 and everything hanging off them."""
    keys = t["loan"].filter(F.col("ReturnDate") < F.lit("1996-01-01").cast("date")).select("LoanID")
    return actions.delete_loans(t, keys)[1]


@query("r5_delete_reservations", """WITH dr AS (SELECT ReservationID FROM reservation WHERE Status IN ('Cancelled', 'Expired'))
SELECT 'reservation' AS table_name, 'DELETE' AS action, count(*) AS row_count FROM dr
UNION ALL SELECT 'reservation_item', 'CASCADE', count(*) FROM reservation_item WHERE ReservationID IN (SELECT ReservationID FROM dr)""")
def _r5r(t, spark):
    """Purge of cancelled and expired reservations with their items."""
    keys = t["reservation"].filter(F.col("Status").isin("Cancelled", "Expired")).select("ReservationID")
    return actions.delete_reservations(t, keys)[1]


# =========================================================== T: circulation ======
@query("t1_issue_loans", f"""WITH ob AS ({OPEN_BOOKS}),
 r AS (SELECT q.RequestID, q.UserID, q.ISBN, q.RequestDate, CASE WHEN u.UserID IS NULL THEN 'unknown user'
   WHEN u.AccountStatus IS NULL OR u.AccountStatus <> 'Active' THEN 'account not active'
   WHEN b.ISBN IS NULL THEN 'unknown book' WHEN b.Status IS NULL OR b.Status <> 'Available' THEN 'book not available' END AS Reason
   FROM loan_request q LEFT JOIN library_user u ON q.UserID = u.UserID LEFT JOIN book b ON q.ISBN = b.ISBN),
 w AS (SELECT min(RequestID) AS RequestID FROM r WHERE Reason IS NULL GROUP BY ISBN),
 r2 AS (SELECT r.RequestID, r.UserID, r.ISBN, r.RequestDate,
   coalesce(r.Reason, CASE WHEN w.RequestID IS NULL THEN 'book taken by an earlier request' END) AS Reason
   FROM r LEFT JOIN w ON r.RequestID = w.RequestID),
 rk AS (SELECT RequestID, UserID, row_number() OVER (PARTITION BY UserID ORDER BY RequestDate, RequestID) AS urank
   FROM r2 WHERE Reason IS NULL),
 ok AS (SELECT rk.RequestID FROM rk LEFT JOIN ob ON rk.UserID = ob.UserID CROSS JOIN policy p
   WHERE coalesce(ob.OpenBooks, 0) + rk.urank <= p.MaxBooks),
 r3 AS (SELECT r2.*, coalesce(r2.Reason, CASE WHEN ok.RequestID IS NULL THEN 'over loan limit' END) AS Reason2
   FROM r2 LEFT JOIN ok ON r2.RequestID = ok.RequestID)
SELECT RequestID, UserID, ISBN, RequestDate, CASE WHEN Reason2 IS NULL THEN 'accepted' ELSE 'rejected' END AS Decision,
 Reason2 AS Reason, CASE WHEN Reason2 IS NULL THEN RequestDate + p.LoanPeriodDays END AS DueDate FROM r3 CROSS JOIN policy p""")
def _t1(t, spark):
    return circulation.issue_loans(t, t["loan_request"], _pol(t), AS_OF)


T2_SQL = """ev AS (SELECT LoanID, Kind, Seq, min(EventDate) AS EventDate, arg_min(UserID, EventDate) AS UserID
   FROM circulation_event WHERE EventDate IS NOT NULL GROUP BY LoanID, Kind, Seq),
 pl AS (SELECT LoanID, min(EventDate) FILTER (WHERE Kind = 'ISSUE') AS CheckoutDate,
   min(EventDate) FILTER (WHERE Kind = 'RETURN') AS ReturnDate FROM ev GROUP BY LoanID),
 iu AS (SELECT LoanID, UserID FROM (SELECT LoanID, UserID, row_number() OVER (PARTITION BY LoanID ORDER BY EventDate, Seq) AS rn
   FROM ev WHERE Kind = 'ISSUE') WHERE rn = 1),
 rn AS (SELECT e.LoanID, count(*) AS n FROM ev e JOIN pl ON e.LoanID = pl.LoanID
   WHERE e.Kind = 'RENEW' AND (pl.ReturnDate IS NULL OR e.EventDate <= pl.ReturnDate) GROUP BY e.LoanID)"""
T2_SELECT = """SELECT pl.LoanID, iu.UserID, pl.CheckoutDate,
 pl.CheckoutDate + CAST(p.LoanPeriodDays * (coalesce(rn.n, 0) + 1) AS INTEGER) AS DueDate, pl.ReturnDate,
 coalesce(rn.n, 0) AS Renewals
 FROM pl LEFT JOIN iu ON pl.LoanID = iu.LoanID LEFT JOIN rn ON pl.LoanID = rn.LoanID CROSS JOIN policy p
 WHERE pl.CheckoutDate IS NOT NULL"""


@query("t2_fold_circulation", f"WITH {T2_SQL}\n{T2_SELECT}")
def _t2(t, spark):
    return circulation.fold_circulation(t["circulation_event"], _pol(t))[0]


@query("t2_fold_rejects", f"""WITH {T2_SQL.replace("EventDate IS NOT NULL", "EventDate IS NOT NULL AND NOT (Kind = 'ISSUE' AND LoanID % 13 = 0)", 1)}
SELECT LoanID, 'no ISSUE event' AS Reason FROM pl WHERE CheckoutDate IS NULL""")
def _t2r(t, spark):
    """The fold's reject frame: loans without an ISSUE, of all events but the
    issues of every 13th loan."""
    ev = t["circulation_event"].filter("NOT (Kind = 'ISSUE' AND LoanID % 13 = 0)")
    return circulation.fold_circulation(ev, _pol(t))[1]


@query("t2_fold_rejects_null_keys", f"""WITH circulation_event_ AS (SELECT * EXCLUDE (LoanID),
 CASE WHEN LoanID % 7 <> 2 THEN LoanID END AS LoanID FROM circulation_event),
 {T2_SQL.replace("FROM circulation_event WHERE EventDate IS NOT NULL",
                 "FROM circulation_event_ WHERE LoanID IS NOT NULL AND EventDate IS NOT NULL AND NOT (Kind = 'ISSUE' AND LoanID % 13 = 0)", 1)}
SELECT LoanID, 'no ISSUE event' AS Reason FROM pl WHERE CheckoutDate IS NULL
UNION ALL SELECT NULL, 'no LoanID' FROM circulation_event_ WHERE LoanID IS NULL""")
def _t2n(t, spark):
    """The reject frame when the events of every 7th loan have lost their LoanID: each of them, and loans without an ISSUE."""
    ev = t["circulation_event"].filter("NOT (Kind = 'ISSUE' AND LoanID % 13 = 0 AND LoanID % 7 <> 2)")
    return circulation.fold_circulation(ev.withColumn("LoanID", F.when(F.col("LoanID") % 7 != 2, F.col("LoanID"))), _pol(t))[1]


@query("l6_member_history", f"""WITH {TX_SQL},
 top AS (SELECT * FROM tx WHERE UserID = (SELECT min(UserID) FROM loan) AND TxDate >= DATE '1995-01-01'
   ORDER BY TxDate DESC, LoanID DESC, TxType, ISBN LIMIT 40)
{TX_ENRICH}""")
def _l6m(t, spark):
    """The newest 40 transactions of the first member who has a loan."""
    first = t["loan"].agg(F.min("UserID")).first()[0]
    return figures.transaction_history(t, AS_OF, member=first, date_from="1995-01-01", page=40)


# ============================================================ F: formats ======
from circula.functions import formats as fmt  # noqa: E402


@query("f1_code", f"""SELECT UserID, {_code('M', 'UserID', 4)} AS MemberCode, {_code('L', 'UserID', 3)} AS StaffStyleCode,
 {_code('#TRX', 'UserID', 3)} AS TransactionStyleCode FROM library_user""")
def _f1(t, spark):
    """Member codes for every member (and the other two code styles on the same ids)."""
    u = t["library_user"]
    return u.select("UserID", fmt.code("M", "UserID", 4).alias("MemberCode"),
                    fmt.code("L", "UserID", 3).alias("StaffStyleCode"),
                    fmt.code("#TRX", "UserID", 3).alias("TransactionStyleCode"))


@query("f2_money", """SELECT PaymentID, '$' || format('{:,.2f}', CAST(AmountPaid AS DOUBLE)) AS AmountText,
 '$' || format('{:,.0f}', CAST(AmountPaid AS DOUBLE)) AS AmountWhole FROM payment""")
def _f2(t, spark):
    """Every payment amount as $x,xxx.xx and as whole dollars."""
    return t["payment"].select("PaymentID", fmt.money("AmountPaid", 2).alias("AmountText"),
                               fmt.money("AmountPaid", 0).alias("AmountWhole"))


@query("f3_thousands", """SELECT Genre, count(*) AS Books, format('{:,}', count(*)) AS BooksText FROM book GROUP BY Genre""")
def _f3(t, spark):
    """Books per genre, count and its 1,234 text."""
    return (t["book"].groupBy("Genre").agg(F.count(F.lit(1)).alias("Books"))
            .withColumn("BooksText", fmt.thousands("Books")))


@query("f4_day", """SELECT LoanID, strftime(CheckoutDate, '%b %-d, %Y') AS CheckoutDay FROM loan""")
def _f4(t, spark):
    """Every loan's checkout day as 'Nov 1, 2025'."""
    return t["loan"].select("LoanID", fmt.day("CheckoutDate").alias("CheckoutDay"))


@query("f5_age_days", f"""SELECT ProcessID, {_age('ActionDate')} AS Age FROM processed_by""")
def _f5(t, spark):
    """Every staff action's age as 'today' / '1 day ago' / 'n days ago'."""
    return t["processed_by"].select("ProcessID", fmt.age_days("ActionDate", AS_OF).alias("Age"))


# ============================================================ S: sources ======
@query("s1_load_table", """SELECT LoanID, UserID, CheckoutDate, DueDate, ReturnDate, FineAmount FROM loan""")
def _s1(t, spark):
    """Round trip: the loan table written as CSV, read back with its declared schema."""
    from circula.sources.paths import scratch_dir
    from circula.sources.tables import load_table, write_table
    path = scratch_dir(spark, "s1-loan-csv")
    write_table(t["loan"], path, fmt="csv")
    df = load_table(spark, "loan", path, fmt="csv")
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


ODD_TEXTS = """SELECT ReportID, GeneratedBy, GenerationDate, CASE WHEN ReportID % 6 = 0 THEN '' ELSE Type END AS Type,
 CASE ReportID % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN Content || chr(10) || 'a second line, with "quotes"' || chr(13) || chr(10) || chr(10)
  WHEN 3 THEN '  ' || Content || ' \\ "' WHEN 4 THEN '"' ELSE Content END AS Content FROM report"""


def _odd_reports(t):
    """The reports with line ends, quotes, commas, backslashes and spaces at the ends in their texts, and empty and null texts."""
    at, text = F.col("ReportID") % 6, F.col("Content")
    return t["report"].select(
        "ReportID", "GeneratedBy", "GenerationDate", F.when(at == 0, F.lit("")).otherwise(F.col("Type")).alias("Type"),
        F.when(at == 0, F.lit(None).cast("string")).when(at == 1, F.lit(""))
        .when(at == 2, F.concat(text, F.lit('\na second line, with "quotes"\r\n\n')))
        .when(at == 3, F.concat(F.lit("  "), text, F.lit(' \\ "'))).when(at == 4, F.lit('"')).otherwise(text).alias("Content"))


def _through_csv(spark, name: str, rows):
    """A table's rows written as CSV and read back, ``_corrupt_record`` included."""
    from circula.sources.paths import scratch_dir
    from circula.sources.tables import load_table, write_table
    path = scratch_dir(spark, f"s1-{name}-csv")
    write_table(rows, path, fmt="csv")
    return load_table(spark, name, path, fmt="csv")


@query("s1_load_table_texts", ODD_TEXTS.replace("FROM report", ", CAST(NULL AS VARCHAR) AS _corrupt_record FROM report"))
def _s1t(t, spark):
    """Round trip of the report table through CSV, with texts that hold line ends and quotes."""
    return _through_csv(spark, "report", _odd_reports(t))


@query("s1_load_table_all", "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS RowsRead, CAST(0 AS BIGINT) AS Corrupt, CAST(0 AS BIGINT) AS Lost, CAST(0 AS BIGINT) AS Added FROM {n}" for n in TABLES))
def _s1a(t, spark):
    """Round trips of all 14 tables through CSV: rows read, corrupt ones, and rows in which the two sides differ."""
    out = []
    for n, spec in TABLES.items():
        rows = t[n].select(*spec.column_names)
        back = _through_csv(spark, n, rows).withColumn("_read", F.lit(1))
        both = rows.withColumns({"_corrupt_record": F.lit(None).cast("string"), "_read": F.lit(0)}).unionByName(back)
        count = lambda cond: F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
        corrupt = F.col("_corrupt_record").isNotNull()
        each = both.groupBy(*spec.column_names, corrupt.alias("_bad")).agg(
            F.sum("_read").alias("_in"), count(F.col("_read") == 0).alias("_out"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        out.append(each.agg(
            total(F.col("_in")).alias("RowsRead"), total(F.when(F.col("_bad"), F.col("_in"))).alias("Corrupt"),
            total(F.greatest(F.col("_out") - F.col("_in"), F.lit(0))).alias("Lost"),
            total(F.when(~F.col("_bad"), F.greatest(F.col("_in") - F.col("_out"), F.lit(0)))).alias("Added"))
            .select(F.lit(n).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, out)


@query("s2_write_report", """SELECT CAST(date_trunc('month', PaymentDate) AS DATE) AS Month, PaymentMethod,
 count(*) AS Payments, CAST(coalesce(sum(AmountPaid), 0) AS DECIMAL(18,2)) AS Amount FROM payment GROUP BY 1, 2""")
def _s2(t, spark):
    """A7's monthly revenue stored as a report (a Report row and JSON parts),
    then the stored report read back and its parts decoded into rows."""
    from circula.sources.paths import scratch_dir
    from circula.sources.reports import read_report_rows, write_report
    path = scratch_dir(spark, "s2-report")
    row = write_report(figures.monthly_revenue(t), "Monthly Revenue Report", 2, AS_OF, path).first()
    return read_report_rows(spark, path, row.ReportID,
                            "Month: date, PaymentMethod: string, Payments: bigint, Amount: decimal(18,2)")


@query("s2_write_report_members", f"""WITH ob AS ({OPEN_BOOKS}),
 uf AS (SELECT UserID, sum(Amount) AS s FROM fine WHERE Status = 'Unpaid' GROUP BY UserID)
SELECT {_code('M', 'u.UserID', 4)} AS MemberCode, u.UserID, u.Name, u.AccountStatus, u.City,
 coalesce(ob.OpenBooks, 0) AS OpenBooks, CAST(coalesce(uf.s, 0) AS DECIMAL(18,2)) AS UnpaidFines
 FROM library_user u LEFT JOIN ob ON u.UserID = ob.UserID LEFT JOIN uf ON u.UserID = uf.UserID""")
def _s2m(t, spark):
    """L9's full member list stored as a report in JSON parts, and every row read back."""
    from circula.sources.paths import scratch_dir
    from circula.sources.reports import read_report_rows, write_report
    path = scratch_dir(spark, "s2-members")
    row = write_report(figures.member_list(t, AS_OF), "Members", 2, AS_OF, path).first()
    return read_report_rows(spark, path, row.ReportID,
                            "MemberCode: string, UserID: int, Name: string, AccountStatus: string, City: string, "
                            "OpenBooks: bigint, UnpaidFines: decimal(18,2)")


# ========================================================== W: streaming ======
def _time_parts(events):
    """The events in four parts by time; those without a time are in the last one."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    cuts = events.select(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("q")).first()["q"] or []
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = events if lo is None else events.filter((at > lo) | at.isNull() if hi is None else at > lo)
        yield part if hi is None else part.filter(at <= hi)


def _w1_stream(spark, parts):
    """Run W1 over the parts, a trigger each; returns the sink."""
    from circula.sources.paths import scratch_dir
    from circula.streaming.daily_counts import stream_daily_counts
    base = scratch_dir(spark, "w1")
    for part in parts:
        part.write.mode("append").parquet(f"{base}/source")
        stream_daily_counts(spark, f"{base}/source", f"{base}/sink", f"{base}/checkpoint", delay="1 day")
    return f"{base}/sink"


@query("w1_stream_daily_counts", """SELECT CAST(ts AS DATE) AS Day, event_type AS Kind, count(*) AS Events FROM events GROUP BY 1, 2""")
def _w1(t, spark):
    """Daily counts per event kind, run as a stream over the events in four
    parts by time, a micro-batch each."""
    from circula.streaming.daily_counts import read_daily_counts
    return read_daily_counts(spark, _w1_stream(spark, _time_parts(spark.read.parquet(f"{t.sf_dir}/events.parquet"))))


FAULTY_EVENTS = """e AS (SELECT event_id, CASE WHEN event_id % 13 = 4 THEN NULL ELSE ts END AS ts,
 CASE WHEN event_id % 11 = 3 THEN NULL ELSE event_type END AS event_type FROM events)"""


def _faulty_events(t, spark):
    """All events; every 11th has no kind, every 13th no time, and every part is delivered again with the next one."""
    ev = spark.read.parquet(f"{t.sf_dir}/events.parquet")
    ev = (ev.withColumn("ts", F.when(F.col("event_id") % 13 != 4, F.col("ts")))
          .withColumn("event_type", F.when(F.col("event_id") % 11 != 3, F.col("event_type"))))
    parts = list(_time_parts(ev))
    return [parts[0], *(later.unionByName(part.filter("ts IS NOT NULL")) for part, later in zip(parts, parts[1:], strict=False))]


@query("w1_stream_faulty_events", f"""WITH {FAULTY_EVENTS} SELECT CAST(ts AS DATE) AS Day, event_type AS Kind, count(*) AS Events
 FROM e WHERE ts IS NOT NULL GROUP BY 1, 2""")
def _w1f(t, spark):
    """The same with null kinds in several batches, events without a time, and redelivered events, which count once."""
    from circula.streaming.daily_counts import read_daily_counts
    return read_daily_counts(spark, _w1_stream(spark, _faulty_events(t, spark)))


@query("w1_stream_rejects", f"""WITH {FAULTY_EVENTS} SELECT event_id, event_type FROM e WHERE ts IS NULL""")
def _w1r(t, spark):
    """The events without a time that the same stream leaves out."""
    from circula.streaming.daily_counts import read_rejects
    return read_rejects(spark, _w1_stream(spark, _faulty_events(t, spark))).select("event_id", "event_type")


def _w2_stream(t, spark, parts, between=None):
    """Run W2 over the parts, a trigger each (calling ``between`` after each), and return the state folder."""
    from circula.sources.paths import scratch_dir
    from circula.streaming.circulation_stream import stream_circulation
    base = scratch_dir(spark, "w2")
    for part in parts:
        part.write.mode("append").parquet(f"{base}/source")
        stream_circulation(spark, f"{base}/source", f"{base}/state", f"{base}/checkpoint", _pol(t))
        if between:
            between(spark, f"{base}/state")
    return f"{base}/state"


def _loan_parts(ev):
    """Events in four parts by loan; those without a LoanID are in the last one."""
    own = F.coalesce(F.pmod("LoanID", F.lit(4)), F.lit(3))
    return [ev.filter(own == k) for k in range(4)]


@query("w2_stream_circulation", f"WITH {T2_SQL}\n{T2_SELECT}")
def _w2(t, spark):
    """Loan state kept current by a stream over the circulation events in
    four micro-batches; the final state equals the batch fold (T2)."""
    from circula.streaming.circulation_stream import current_loans
    return current_loans(spark, _w2_stream(t, spark, _loan_parts(t["circulation_event"])))


@query("w2_stream_compacted", f"WITH {T2_SQL}\n{T2_SELECT}")
def _w2c(t, spark):
    """The same by kind of event (returns first), so that every batch changes the same loans, with a compaction after each micro-batch."""
    from circula.streaming.circulation_stream import compact, current_loans
    ev = t["circulation_event"]
    parts = [ev.filter("Kind = 'RETURN'"), ev.filter("Kind = 'ISSUE'"), ev.filter("Kind IS NULL OR Kind NOT IN ('ISSUE', 'RETURN')")]
    return current_loans(spark, _w2_stream(t, spark, parts, compact))


@query("w2_stream_rejects", """SELECT CASE WHEN LoanID % 7 = 2 THEN NULL ELSE LoanID END AS LoanID, UserID, Kind, EventDate, Seq
 FROM circulation_event WHERE LoanID % 7 = 2 OR LoanID IS NULL""")
def _w2r(t, spark):
    """The reject frame of the stream when the events of every 7th loan have lost their LoanID."""
    from circula.streaming.circulation_stream import rejected_events
    ev = t["circulation_event"].withColumn("LoanID", F.when(F.col("LoanID") % 7 != 2, F.col("LoanID")))
    return rejected_events(spark, _w2_stream(t, spark, _loan_parts(ev)))


@query("w2_stream_loan_state", f"WITH {T2_SQL}\n{T2_SELECT}")
def _w2s(t, spark):
    """The same when returns and renewals come before the issues, and some
    issues come again: the final state still equals the batch fold (T2)."""
    from circula.streaming.circulation_stream import current_loans
    ev = t["circulation_event"]
    return current_loans(spark, _w2_stream(t, spark, [
        ev.filter("Kind = 'RETURN'"), ev.filter("Kind = 'RENEW'"),
        ev.filter("Kind = 'ISSUE'"), ev.filter("Kind = 'ISSUE' AND LoanID % 3 = 0")]))
