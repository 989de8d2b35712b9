"""Fixture views as DuckDB SQL, for the oracle side of the correctness gate.

The driver registers only the raw tables; each oracle query is therefore
sent as ``WITH <needed fixture views> <query>``.  The view texts are the
specification in FIXTURES.md with ``DAYS(a, b)`` written as DuckDB's
``date_diff('day', a, b)``.
"""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {
    "policy": """SELECT 1 AS PolicyID, 'Standard' AS Name, 14 AS LoanPeriodDays, 5 AS MaxBooks,
 CAST(0.50 AS DECIMAL(5,2)) AS FineRatePerDay, 2 AS GracePeriodDays""",
    "library_user": """SELECT CAST(c_custkey AS INT) AS UserID, c_name AS Name,
 concat(lower(replace(c_name,'#','.')),'@example.org') AS Email, CAST(NULL AS STRING) AS Phone, CAST(NULL AS STRING) AS Street,
 n_name AS City, CAST(10000 + c_nationkey AS STRING) AS Zip,
 CASE WHEN c_acctbal < 0 THEN 'Suspended' ELSE 'Active' END AS AccountStatus,
 DATE '1995-01-01' + CAST(2398 - (c_custkey * 37) % 2399 AS INT) AS MembershipDate
 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "employee": """SELECT CAST(s_suppkey + 1 AS INT) AS EmployeeID, s_name AS Name, concat(lower(replace(s_name,'#','.')),'@example.org') AS Email,
 'Staff' AS Position, CAST(1 + s_suppkey % 3 AS INT) AS AccessLevel,
 CASE s_suppkey % 10 WHEN 0 THEN 'Administrator' WHEN 1 THEN 'Other' ELSE 'Librarian' END AS Role FROM supplier""",
    "loan_base": """SELECT CAST(o_orderkey AS INT) AS LoanID, CAST(o_custkey AS INT) AS UserID, CAST(o_orderdate AS DATE) AS CheckoutDate,
 CAST(o_orderdate AS DATE) + 14 AS DueDate,
 CASE WHEN o_orderkey % 50 = 0 THEN NULL
      WHEN CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7919) % 40 AS INT) > DATE '2001-07-26' THEN NULL
      ELSE CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7919) % 40 AS INT) END AS ReturnDate
 FROM orders WHERE o_orderstatus IN ('F','O') AND CAST(o_orderdate AS DATE) <= DATE '2001-07-26'""",
    "fine_base": """SELECT LoanID, UserID, date_diff('day', DueDate, coalesce(ReturnDate, DATE '2001-07-26')) - 2 AS BillDays,
 coalesce(ReturnDate, DATE '2001-07-26') AS IssueDate
 FROM loan_base WHERE date_diff('day', DueDate, coalesce(ReturnDate, DATE '2001-07-26')) > 2""",
    "fine": """SELECT LoanID + 1 AS FineID, LoanID, UserID, IssueDate, CAST(BillDays * 0.50 AS DECIMAL(8,2)) AS Amount,
 CASE WHEN LoanID % 3 = 0 THEN 'Unpaid' ELSE 'Paid' END AS Status, 'Late return' AS Description FROM fine_base""",
    "payment": """SELECT FineID * 2 AS PaymentID, FineID, IssueDate AS PaymentDate,
 CASE WHEN LoanID % 11 = 0 THEN CAST(0.50 AS DECIMAL(8,2)) ELSE Amount END AS AmountPaid,
 CASE LoanID % 4 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Credit' WHEN 2 THEN 'Online' ELSE 'Other' END AS PaymentMethod
 FROM fine WHERE Status = 'Paid'""",
    "loan": """SELECT b.LoanID, b.UserID, b.CheckoutDate, b.DueDate, b.ReturnDate,
 CASE WHEN f.Amount IS NULL OR b.LoanID % 17 = 0 THEN CAST(0 AS DECIMAL(8,2)) ELSE f.Amount END AS FineAmount
 FROM loan_base b LEFT JOIN fine f ON b.LoanID = f.LoanID""",
    "loan_item": """SELECT DISTINCT LoanID, CAST(l_partkey AS STRING) AS ISBN FROM lineitem JOIN loan_base ON l_orderkey = LoanID""",
    "reservation": """SELECT CAST(o_orderkey AS INT) AS ReservationID, CAST(o_custkey AS INT) AS UserID, CAST(o_orderdate AS DATE) AS ReservationDate,
 CAST(o_orderdate AS DATE) + 365 AS ExpiryDate,
 CASE WHEN o_orderkey % 10 = 0 THEN 'Cancelled' WHEN o_orderkey % 7 = 0 THEN 'Active'
      WHEN CAST(o_orderdate AS DATE) + 365 < DATE '2001-07-26' THEN 'Expired' ELSE 'Active' END AS Status
 FROM orders WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) <= DATE '2001-07-26'""",
    "reservation_item": """SELECT DISTINCT ReservationID, CAST(l_partkey AS STRING) AS ISBN FROM lineitem JOIN reservation ON l_orderkey = ReservationID""",
    "book": """SELECT CAST(p_partkey AS STRING) AS ISBN, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS Title, CAST(1950 + p_size AS INT) AS PublicationYear,
 p_type AS Genre, p_brand AS Author,
 CASE WHEN p_partkey % 97 = 0 THEN 'Lost' WHEN p_partkey % 13 = 0 THEN 'Available'
      WHEN o.ISBN IS NOT NULL THEN 'Borrowed' WHEN r.ISBN IS NOT NULL THEN 'Reserved' ELSE 'Available' END AS Status,
 concat('S', CAST(p_partkey % 20 AS STRING)) AS ShelfLocation
 FROM part LEFT JOIN (SELECT DISTINCT ISBN FROM loan_item i JOIN loan_base l ON i.LoanID = l.LoanID WHERE ReturnDate IS NULL) o ON CAST(p_partkey AS STRING) = o.ISBN
 LEFT JOIN (SELECT DISTINCT ISBN FROM reservation_item i JOIN reservation v ON i.ReservationID = v.ReservationID WHERE Status = 'Active' AND ExpiryDate >= DATE '2001-07-26') r ON CAST(p_partkey AS STRING) = r.ISBN
 UNION ALL SELECT CAST(9000000 + r_regionkey AS STRING), concat('New title ', r_name), 2001, 'NEW', 'New Author', 'Available', 'S0' FROM region""",
    "book_authors": """SELECT CAST(p_partkey AS STRING) AS ISBN, p_brand AS AuthorName FROM part WHERE p_partkey % 29 <> 0
 UNION ALL SELECT CAST(p_partkey AS STRING), concat('Co-', p_type) FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT CAST(9000000 + r_regionkey AS STRING), 'New Author' FROM region""",
    "related_books": """SELECT ISBN, RelatedISBN FROM (SELECT CAST(p_partkey AS STRING) AS ISBN,
  CAST(lead(p_partkey, 1) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS STRING) AS RelatedISBN FROM part
  UNION ALL SELECT CAST(p_partkey AS STRING), CAST(lead(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS STRING) FROM part) x WHERE RelatedISBN IS NOT NULL""",
    "processed_by": """SELECT CAST(event_id AS INT) AS ProcessID, CAST(1 + user_id % 10 AS INT) AS EmployeeID,
 CASE event_type WHEN 'view' THEN 'Book' WHEN 'signup' THEN 'Reservation' ELSE 'Loan' END AS EntityType,
 CAST(event_id % 1500 AS INT) AS EntityID, CAST(ts AS DATE) + (-8219) AS ActionDate
 FROM events WHERE CAST(ts AS DATE) + (-8219) <= DATE '2001-07-26'""",
    "report": """SELECT CAST(s_suppkey + 1 AS INT) AS ReportID, CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE CAST(s_suppkey + 1 AS INT) END AS GeneratedBy,
 DATE '2001-07-26' + (0 - CAST(s_suppkey % 30 AS INT)) AS GenerationDate,
 CASE s_suppkey % 2 WHEN 0 THEN 'Monthly Revenue Report' ELSE 'Book Inventory Report' END AS Type, '{}' AS Content FROM supplier""",
    "raw_user": """SELECT UserID, CASE WHEN UserID % 25 = 3 THEN NULL ELSE Name END AS Name,
 CASE WHEN UserID % 10 = 1 THEN NULL WHEN UserID % 40 = 2 THEN 'shared@example.org' WHEN UserID % 30 = 4 THEN 'not-an-email' ELSE Email END AS Email,
 CASE WHEN UserID % 35 = 5 THEN '555-0100-0000-0000-0000-0000' ELSE '555-0100' END AS Phone, City, Zip, MembershipDate
 FROM library_user UNION ALL SELECT UserID, Name, concat('dup.', Email), '555-0101', City, Zip, MembershipDate FROM library_user WHERE UserID % 60 = 6""",
    "raw_book": """SELECT ISBN, CASE WHEN CAST(ISBN AS INT) % 30 = 7 THEN NULL ELSE Title END AS Title,
 CASE WHEN CAST(ISBN AS INT) % 41 = 8 THEN 1850 ELSE PublicationYear END AS PublicationYear, Genre, Author,
 CASE WHEN CAST(ISBN AS INT) % 20 = 9 THEN 'Missing' WHEN CAST(ISBN AS INT) % 20 = 10 THEN lower(Status) ELSE Status END AS Status FROM book""",
    "raw_fine": """SELECT FineID, CASE WHEN FineID % 50 = 1 THEN LoanID + 100000000 ELSE LoanID END AS LoanID,
 CASE WHEN FineID % 45 = 2 THEN UserID + 100000000 WHEN FineID % 45 = 3 THEN NULL ELSE UserID END AS UserID, IssueDate,
 CASE WHEN FineID % 40 = 4 THEN CAST(1234567.89 AS DECIMAL(12,2)) WHEN FineID % 40 = 5 THEN NULL ELSE CAST(Amount AS DECIMAL(12,2)) END AS Amount,
 Status, Description FROM fine""",
    "raw_loan_item": """SELECT LoanID, CAST(l_partkey AS STRING) AS ISBN FROM lineitem JOIN loan_base ON l_orderkey = LoanID""",
    "delete_user": """SELECT UserID FROM library_user WHERE UserID % 50 = 0""",
    "delete_book": """SELECT ISBN FROM book WHERE CAST(ISBN AS INT) % 97 = 0 OR CAST(ISBN AS INT) IN (9000000, 9000001, 9000002) UNION ALL SELECT '99999999' AS ISBN""",
    "delete_employee": """SELECT EmployeeID FROM employee WHERE EmployeeID % 5 = 0""",
    "rekey_book": """SELECT ISBN AS OldISBN, CASE WHEN ISBN = '9000004' THEN '1' ELSE concat('978-', ISBN) END AS NewISBN FROM book
 WHERE CAST(ISBN AS INT) % 53 = 0 OR CAST(ISBN AS INT) >= 9000003""",
    "circulation_event": """SELECT LoanID, UserID, 'ISSUE' AS Kind, CheckoutDate AS EventDate, 1 AS Seq FROM loan_base
 UNION ALL SELECT LoanID, UserID, 'RENEW', DueDate + (-1), 2 FROM loan_base WHERE LoanID % 8 = 0 AND DueDate + (-1) <= coalesce(ReturnDate, DATE '2001-07-26')
 UNION ALL SELECT LoanID, UserID, 'RETURN', ReturnDate, 3 FROM loan_base WHERE ReturnDate IS NOT NULL""",
    "loan_request": """SELECT CAST(event_id AS INT) AS RequestID, CAST(user_id AS INT) AS UserID,
 CASE WHEN event_id % 50 = 0 THEN '99999999' ELSE CAST((event_id * 31) % 210 AS STRING) END AS ISBN, DATE '2001-07-26' AS RequestDate
 FROM events WHERE event_type = 'purchase'""",
    "raw_signup": """SELECT UserID AS SubmissionID, CASE WHEN UserID % 25 = 3 THEN '' ELSE split_part(Name, '#', 1) END AS firstName,
 split_part(Name, '#', 2) AS lastName,
 CASE WHEN Email IS NULL THEN NULL WHEN UserID % 4 = 0 THEN upper(Email) ELSE upper(concat('new.', Email)) END AS email,
 Phone AS phone, City AS address, UserID % 15 <> 0 AS terms FROM raw_user""",
}

_VIEW_ORDER = list(VIEW_SQL)
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _deps(sql: str) -> set[str]:
    return {w for w in _WORD.findall(sql) if w in VIEW_SQL}


def with_views(query: str) -> str:
    """Prefix ``query`` with the fixture views it names (and their inputs)."""
    need: set[str] = set()
    todo = list(_deps(query))
    while todo:
        v = todo.pop()
        if v in need:
            continue
        need.add(v)
        todo.extend(_deps(VIEW_SQL[v]) - need)
    if not need:
        return query
    ctes = ",\n".join(f"{v} AS (\n{VIEW_SQL[v]}\n)" for v in _VIEW_ORDER if v in need)
    body = query.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
