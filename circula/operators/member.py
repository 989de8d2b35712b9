"""Member figures and lists U1-U7, computed for all members at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circula.functions.common import MONEY_SUM, as_date, is_active_reservation, is_open_loan
from circula.operators.policy import allowance, due_dates, status_label
from circula.operators.ranking import sequence_numbers, spread_join, top_k_per_group
from circula.operators.reconcile import symmetric_related
from circula.session import ensure_checkpoint_dir


def borrowed_count(t: dict, policy, as_of) -> DataFrame:
    """Books on loan and allowance per member (= P4)."""
    return allowance(t, policy, as_of).select("UserID", "OpenBooks", "MaxBooks", "Remaining")


def due_soon(t: dict, as_of, policy, days: int = 3) -> DataFrame:
    """Per member, open items due within [as_of, as_of + days] and the
    days to the nearest of them."""
    d = as_date(as_of)
    loans = due_dates(t["loan"].filter(is_open_loan(as_of)), policy).filter(
        F.col("DueDate").between(d, F.date_add(d, F.lit(int(days)))))
    items = loans.select("LoanID", "UserID", "DueDate").join(
        t["loan_item"].select("LoanID"), "LoanID")
    return items.groupBy("UserID").agg(
        F.count(F.lit(1)).alias("DueSoonItems"),
        F.min(F.datediff(F.col("DueDate"), d)).alias("NearestDueInDays"))


def waiting_list(t: dict, as_of, num_partitions: int | None = None) -> DataFrame:
    """Queue position of every active reservation item, per ISBN, by
    ReservationDate then ReservationID.

    A long queue is split over many tasks (see ``sequence_numbers``).
    """
    return sequence_numbers(
        queue_items(t, as_of), order_cols=[F.col("ReservationDate").asc_nulls_last(), F.col("ReservationID")],
        partition_cols=["ISBN"], out_col="QueuePosition", num_partitions=num_partitions,
    ).select("ISBN", "ReservationID", "UserID", "ReservationDate", "QueuePosition")


def queue_items(t: dict, as_of) -> DataFrame:
    """The active reservation items that stand in queues: ISBN, ReservationID, UserID, ReservationDate."""
    active = t["reservation"].filter(is_active_reservation(as_of)).select("ReservationID", "UserID", "ReservationDate")
    return t["reservation_item"].select("ReservationID", "ISBN").join(active, "ReservationID").select(
        "ISBN", "ReservationID", "UserID", "ReservationDate")


#: The day of items without a date, which come last.
LAST_DAY = "9999-12-31"


def _queue_day() -> Column:
    return F.coalesce("ReservationDate", F.lit(LAST_DAY).cast("date"))


def queue_counts(items: DataFrame) -> DataFrame:
    """Items of each ISBN and day (ISBN, Day, n): what new places are counted from."""
    return items.groupBy("ISBN", _queue_day().alias("Day")).agg(F.count(F.lit(1)).alias("n"))


def change_queue(queue: DataFrame, counts: DataFrame, new: DataFrame, gone: DataFrame | None = None,
                 num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """U3 after some days: (queue, counts) with the items ``new`` (rows of :func:`queue_items`) and
    without those ``gone`` (ISBN, ReservationID).

    An item's place depends on the items of its title before it only.  So in each queue that changes, items of days before the
    first change stay as they are, their number is the sum of that title's day counts, and only
    the items from that day on are numbered (a day's reservations, usually), from that number on.  Rows of other
    queues are not sorted or numbered.  Equal to :func:`waiting_list` over all items.
    """
    queue = queue.select("ISBN", "ReservationID", "UserID", "ReservationDate", "QueuePosition")
    items = queue.drop("QueuePosition")
    left = items.limit(0)
    if gone is not None:
        left = spread_join(items, gone.select("ISBN", "ReservationID").distinct(), ["ISBN", "ReservationID"], "left_semi")
    ensure_checkpoint_dir(queue.sparkSession)
    first = (new.select("ISBN", _queue_day().alias("_day")).unionByName(left.select("ISBN", _queue_day().alias("_day")))
             .groupBy("ISBN").agg(F.min("_day").alias("_first")).checkpoint(eager=True))
    before = (spread_join(counts, first, ["ISBN"], "inner").filter(F.col("Day") < F.col("_first"))
              .groupBy("ISBN").agg(F.sum("n").alias("_before")))
    changed = spread_join(queue, first, ["ISBN"], "left").withColumn("_behind", F.coalesce(_queue_day() >= F.col("_first"), F.lit(False)))
    # read by the sampling, the numbering and the result, each of which would join anew
    changed = changed.checkpoint(eager=True)
    behind = changed.filter("_behind").select(*items.columns)
    if gone is not None:
        behind = spread_join(behind, gone.select("ISBN", "ReservationID").distinct(), ["ISBN", "ReservationID"], "left_anti")
    numbered = sequence_numbers(
        behind.unionByName(new.select(*items.columns)),
        order_cols=[F.col("ReservationDate").asc_nulls_last(), F.col("ReservationID")],
        partition_cols=["ISBN"], out_col="_place", num_partitions=num_partitions)
    placed = spread_join(numbered, before, ["ISBN"], "left").select(
        *items.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias("QueuePosition"))
    kept = changed.filter(~F.col("_behind")).select(*queue.columns)
    signed = (counts.unionByName(queue_counts(new))
              .unionByName(queue_counts(left).withColumn("n", -F.col("n"))))
    return kept.unionByName(placed), signed.groupBy("ISBN", "Day").agg(F.sum("n").alias("n")).filter("n > 0")


def reservations_per_member(t: dict, as_of, num_partitions: int | None = None) -> DataFrame:
    """U3 per member: active reserved items and the best (lowest) queue place."""
    return (waiting_list(t, as_of, num_partitions).groupBy("UserID")
            .agg(F.count(F.lit(1)).alias("ReservedItems"), F.min("QueuePosition").alias("BestQueuePosition")))


def fine_balance(t: dict) -> DataFrame:
    """U4: per member unpaid sum and count; 0.00 / 0 when none."""
    unpaid = (t["fine"].filter(F.col("Status") == "Unpaid").groupBy("UserID")
              .agg(F.sum("Amount").alias("_amt"), F.count(F.lit(1)).alias("_n")))
    return (t["library_user"].select("UserID").join(unpaid, "UserID", "left")
            .select("UserID",
                    F.coalesce("_amt", F.lit(0)).cast(MONEY_SUM).alias("UnpaidAmount"),
                    F.coalesce("_n", F.lit(0)).cast("bigint").alias("UnpaidFines")))


def current_loans(t: dict, as_of, policy) -> DataFrame:
    """Open items with title, borrowed day, due day and P2 status."""
    loans = due_dates(t["loan"].filter(is_open_loan(as_of)), policy)
    items = loans.select("LoanID", "UserID", "CheckoutDate", "DueDate", "ReturnDate").join(
        t["loan_item"].select("LoanID", "ISBN"), "LoanID")
    return (items.join(t["book"].select("ISBN", "Title"), "ISBN", "left")
            .select("UserID", "LoanID", "ISBN", "Title",
                    F.col("CheckoutDate").alias("BorrowedOn"), "DueDate",
                    status_label(as_of).alias("Status")))


def reading_history(t: dict, k: int = 5) -> DataFrame:
    """Last k returned items per member with title and author.

    The per-member top-k is taken on (user, loan, ISBN, date) before titles
    are joined, so only k rows per member meet the book table.
    """
    returned = (t["loan"].filter(F.col("ReturnDate").isNotNull())
                .select("LoanID", "UserID", "ReturnDate")
                .join(t["loan_item"].select("LoanID", "ISBN"), "LoanID"))
    top = top_k_per_group(returned, ["UserID"],
                          [F.col("ReturnDate").desc(), F.col("LoanID").desc(), F.col("ISBN")],
                          k, "RankNo")
    return (top.join(t["book"].select("ISBN", "Title", "Author"), "ISBN", "left")
            .select("UserID", F.col("RankNo").cast("bigint").alias("RankNo"), "LoanID", "ISBN", "Title",
                    "Author", "ReturnDate"))


def borrow_history(t: dict, as_of) -> DataFrame:
    """Distinct (UserID, ISBN) a member ever borrowed up to ``as_of``."""
    loans = t["loan"].filter(F.col("CheckoutDate") <= as_date(as_of)).select("LoanID", "UserID")
    return loans.join(t["loan_item"].select("LoanID", "ISBN"), "LoanID").select(
        "UserID", "ISBN").distinct()


def recommend_books(t: dict, k: int = 5, as_of=None, num_partitions: int | None = None) -> DataFrame:
    """Top-k 'Available' books per member that the member never borrowed.

    Candidates are books related (C7) to a borrowed book and books by the
    author (Book.Author) of a borrowed book.  Score = number of distinct
    borrowed ISBNs that lead to the candidate; ties by ISBN.

    Exact without emitting every (member, book-by-author) or (member,
    related title) pair:
      * author path: history aggregated to (member, author, n, b) with b the
        borrowed titles that are Available now.  Per (member, author) only
        the author's first ``k + b`` available titles in ISBN order are
        looked up, by an equi-join on (Author, rank): at most ``b`` of them
        are borrowed, so any later title has at least k unborrowed titles
        with the same or a higher score and a smaller ISBN ahead of it;
      * floor: if an author with n = T alone offers at least k unborrowed
        available titles, every top-k score is >= T (T is a per-member
        ``max`` aggregate, combined map-side).  Authors with n < T are left out;
      * related path: a source by the candidate's own author adds nothing to
        n, so only edges between authors (to available titles) remain, and a
        candidate's score is at most n plus the number of edges that lead to it,
        its ``_in``.  A source's edges to one author have a bound too, n plus the largest
        ``_in``: (member, source, author) rows under the floor go before any
        related title is listed, and then titles under it;
      * both paths are unioned and merged per (member, ISBN) with ``max``
        (the related score already includes the author part), borrowed books
        are removed once, and the per-member top-k is a WindowGroupLimit.
    """
    k = int(k)
    # read by three branches below: materialized once in spark.checkpoint.dir
    ensure_checkpoint_dir(t["loan"].sparkSession)
    history = borrow_history(t, as_of).checkpoint(eager=True)
    books = t["book"].select("ISBN", "Title", "Author", "Status")
    available = books.filter(F.col("Status") == "Available").select("ISBN", "Author")
    written = available.filter(F.col("Author").isNotNull())

    # -- (member, author): n borrowed titles, b of them Available now, and the floor T
    per_author_avail = written.groupBy("Author").agg(F.count(F.lit(1)).alias("_avail"))
    per_author = (history.join(books.filter(F.col("Author").isNotNull()).select("ISBN", "Author", "Status"), "ISBN")
                  .groupBy("UserID", "Author")
                  .agg(F.count(F.lit(1)).alias("_n"),
                       F.count(F.when(F.col("Status") == "Available", F.lit(1))).alias("_b")))
    cand = spread_join(per_author, per_author_avail, ["Author"], "left").checkpoint(eager=True)  # read by three branches
    floor = cand.groupBy("UserID").agg(
        F.max(F.when(F.col("_avail") - F.col("_b") >= k, F.col("_n"))).alias("_floor"))

    # -- author path
    kept = (cand.filter(F.col("_avail").isNotNull()).join(floor, "UserID")
            .filter(F.col("_floor").isNull() | (F.col("_n") >= F.col("_floor"))))
    window = kept.select(
        "UserID", "Author", "_n",
        F.explode(F.sequence(F.lit(1).cast("bigint"),
                             F.least(F.lit(k) + F.col("_b"), F.col("_avail")))).alias("_arank"))
    scored_author = (window.join(_author_ranks(written, cand, k, num_partitions), ["Author", "_arank"])
                     .select("UserID", "ISBN", F.col("_n").alias("Score")))
    scored_rel = _related_scores(history, _author_edges(t, books, available), cand.select("UserID", "Author", "_n"), floor)

    merged = (scored_rel.unionByName(scored_author)
              .groupBy("UserID", "ISBN").agg(F.max("Score").alias("Score"))
              .join(history, ["UserID", "ISBN"], "left_anti"))
    top = top_k_per_group(merged, ["UserID"], [F.col("Score").desc(), F.col("ISBN")], k, "RankNo")
    return (top.join(books.select("ISBN", "Title", "Author"), "ISBN", "left")
            .select("UserID", F.col("RankNo").cast("bigint").alias("RankNo"), "ISBN", "Title", "Author",
                    F.col("Score").cast("bigint").alias("Score")))


def _author_ranks(written: DataFrame, cand: DataFrame, k: int, num_partitions: int | None) -> DataFrame:
    """ISBN, Author and ``_arank``, the place of the title among its author's in
    ISBN order, as far as any member's window of k + b titles reaches."""
    limit = int(written.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    reach = k + (cand.agg(F.max("_b")).first()[0] or 0)
    if reach <= limit:  # each task ships an author's first titles only
        return top_k_per_group(written, ["Author"], ["ISBN"], reach, "_arank").withColumn(
            "_arank", F.col("_arank").cast("bigint"))
    return sequence_numbers(written, order_cols=["ISBN"], partition_cols=["Author"], out_col="_arank",
                            num_partitions=num_partitions)


def _author_edges(t: dict, books: DataFrame, available: DataFrame) -> DataFrame:
    """Edges (C7) to available titles of another author than the source's: ISBN, RelatedISBN, Author (of
    the title) and ``_in``, the number of such edges that lead to the title."""
    edges = (symmetric_related(t)
             .join(available.select(F.col("ISBN").alias("RelatedISBN"), "Author"), "RelatedISBN")
             .join(books.select("ISBN", F.col("Author").alias("_src_author")), "ISBN", "left")
             .filter(~F.coalesce(F.col("_src_author") == F.col("Author"), F.lit(False)))
             .select("ISBN", "RelatedISBN", "Author"))
    return spread_join(edges, edges.groupBy("RelatedISBN").agg(F.count(F.lit(1)).alias("_in")), ["RelatedISBN"], "inner")


def _related_scores(history: DataFrame, edges: DataFrame, per_author: DataFrame, floor: DataFrame) -> DataFrame:
    """UserID, ISBN and Score of the related titles that can reach the member's
    floor; (member, source, title) triples are unique, so a count is the distinct-source count."""
    edges = edges.withColumn("_by", F.xxhash64("Author")).checkpoint(eager=True)  # a null author is one, too
    heads = edges.groupBy("ISBN", "_by").agg(F.first("Author").alias("Author"), F.max("_in").alias("_most"))
    reach = F.coalesce(F.col("_n"), F.lit(0))
    able = (spread_join(history, heads, ["ISBN"], "inner")
            .join(floor, "UserID", "left").join(per_author, ["UserID", "Author"], "left")
            .filter(reach + F.col("_most") >= F.coalesce("_floor", F.lit(0)))
            .select("UserID", "ISBN", "_by", reach.alias("_n"), F.coalesce("_floor", F.lit(0)).alias("_floor")))
    pairs = spread_join(able, edges.select("ISBN", "_by", "RelatedISBN", "_in"), ["ISBN", "_by"], "inner").filter(
        F.col("_n") + F.col("_in") >= F.col("_floor"))
    return (pairs.groupBy("UserID", F.col("RelatedISBN").alias("ISBN"))
            .agg((F.max("_n") + F.count(F.lit(1))).alias("Score")))
