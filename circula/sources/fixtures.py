"""Fixture views: the driver's read-only tables mapped onto the 14 declared tables.

The mapping is the one written down in FIXTURES.md; it only shapes input rows
(plus a few deliberately dirty or event inputs) and does none of the
operators' work.  Every view is a lazy DataFrame over the parquet files, so a
query reads only the columns and rows it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.session import AS_OF

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
              "lineitem", "events", "documents", "embeddings", "pages",
              "benchmark", "labels", "conversations")

FIXTURE_VIEWS = (
    "policy", "library_user", "employee", "loan_base", "fine_base", "fine",
    "payment", "loan", "loan_item", "reservation", "reservation_item", "book",
    "book_authors", "related_books", "processed_by", "report", "raw_user",
    "raw_book", "raw_fine", "raw_loan_item", "delete_user", "delete_book",
    "delete_employee", "rekey_book", "circulation_event", "loan_request",
    "raw_signup",
)


def _i(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _dplus(d: Column, n) -> Column:
    return F.date_add(d, n if isinstance(n, Column) else F.lit(n))


class Fixtures:
    """Lazily built fixture DataFrames for one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = F.lit(as_of).cast("date")
        self._cache: dict[str, DataFrame] = {}

    # -- raw tables ---------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # Views that several others and many queries read, each derived through
    # lineitem / orders joins: kept in Spark's cache so a session running
    # many queries derives them once (a lost cache block is recomputed).
    CACHED = ("loan_base", "raw_loan_item", "reservation_item", "book")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            builder = getattr(self, f"_{name}", None)
            if builder is None:
                raise KeyError(name)
            df = builder()
            self._cache[name] = df.cache() if name in self.CACHED else df
        return self._cache[name]

    def __contains__(self, name: object) -> bool:
        return name in FIXTURE_VIEWS

    def tables(self, *names: str) -> dict[str, DataFrame]:
        names = names or FIXTURE_VIEWS
        return {n: self[n] for n in names}

    # -- declared tables ----------------------------------------------------
    def _policy(self) -> DataFrame:
        return self.spark.range(1).select(
            F.lit(1).alias("PolicyID"), F.lit("Standard").alias("Name"),
            F.lit(14).alias("LoanPeriodDays"), F.lit(5).alias("MaxBooks"),
            F.lit("0.50").cast("decimal(5,2)").alias("FineRatePerDay"),
            F.lit(2).alias("GracePeriodDays"))

    def _email(self, name_col: str) -> Column:
        return F.concat(F.lower(F.replace(F.col(name_col), F.lit("#"), F.lit("."))),
                        F.lit("@example.org"))

    def _library_user(self) -> DataFrame:
        c = self.raw("customer")
        n = self.raw("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            _i("c_custkey").alias("UserID"), F.col("c_name").alias("Name"),
            self._email("c_name").alias("Email"),
            F.lit(None).cast("string").alias("Phone"),
            F.lit(None).cast("string").alias("Street"),
            F.col("n_name").alias("City"),
            _s(F.lit(10000) + F.col("c_nationkey")).alias("Zip"),
            F.when(F.col("c_acctbal") < 0, "Suspended").otherwise("Active").alias("AccountStatus"),
            _dplus(F.lit("1995-01-01").cast("date"),
                   _i(F.lit(2398) - (F.col("c_custkey") * 37) % 2399)).alias("MembershipDate"))

    def _employee(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey") % 10
        return s.select(
            _i(F.col("s_suppkey") + 1).alias("EmployeeID"), F.col("s_name").alias("Name"),
            self._email("s_name").alias("Email"), F.lit("Staff").alias("Position"),
            _i(1 + F.col("s_suppkey") % 3).alias("AccessLevel"),
            F.when(k == 0, "Administrator").when(k == 1, "Other")
             .otherwise("Librarian").alias("Role"))

    def _loan_base(self) -> DataFrame:
        o = self.raw("orders")
        od = F.col("o_orderdate").cast("date")
        ret = _dplus(od, _i((F.col("o_orderkey") * 7919) % 40))
        return o.filter(F.col("o_orderstatus").isin("F", "O") & (od <= self.as_of)).select(
            _i("o_orderkey").alias("LoanID"), _i("o_custkey").alias("UserID"),
            od.alias("CheckoutDate"), _dplus(od, 14).alias("DueDate"),
            F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("date"))
             .when(ret > self.as_of, F.lit(None).cast("date"))
             .otherwise(ret).alias("ReturnDate"))

    def _fine_base(self) -> DataFrame:
        end = F.coalesce(F.col("ReturnDate"), self.as_of)
        late = F.datediff(end, F.col("DueDate"))
        return self["loan_base"].filter(late > 2).select(
            "LoanID", "UserID", (late - 2).cast("bigint").alias("BillDays"),
            end.alias("IssueDate"))

    def _fine(self) -> DataFrame:
        return self["fine_base"].select(
            (F.col("LoanID") + 1).alias("FineID"), "LoanID", "UserID", "IssueDate",
            (F.col("BillDays") * F.lit("0.50").cast("decimal(3,2)")).cast("decimal(8,2)").alias("Amount"),
            F.when(F.col("LoanID") % 3 == 0, "Unpaid").otherwise("Paid").alias("Status"),
            F.lit("Late return").alias("Description"))

    def _payment(self) -> DataFrame:
        m = F.col("LoanID") % 4
        return self["fine"].filter(F.col("Status") == "Paid").select(
            (F.col("FineID") * 2).alias("PaymentID"), "FineID",
            F.col("IssueDate").alias("PaymentDate"),
            F.when(F.col("LoanID") % 11 == 0, F.lit("0.50").cast("decimal(8,2)"))
             .otherwise(F.col("Amount")).alias("AmountPaid"),
            F.when(m == 0, "Cash").when(m == 1, "Credit").when(m == 2, "Online")
             .otherwise("Other").alias("PaymentMethod"))

    def _loan(self) -> DataFrame:
        b = self["loan_base"]
        f = self["fine"].select(F.col("LoanID").alias("f_LoanID"), "Amount")
        return b.join(f, b.LoanID == f.f_LoanID, "left").select(
            "LoanID", "UserID", "CheckoutDate", "DueDate", "ReturnDate",
            F.when(F.col("Amount").isNull() | (F.col("LoanID") % 17 == 0),
                   F.lit(0).cast("decimal(8,2)")).otherwise(F.col("Amount")).alias("FineAmount"))

    # The orders' side of these joins is hashed: a task need not sort its share of lineitem.
    def _raw_loan_item(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        lb = self["loan_base"].select("LoanID").hint("shuffle_hash")
        return li.join(lb, li.l_orderkey == lb.LoanID).select(
            "LoanID", _s("l_partkey").alias("ISBN"))

    def _loan_item(self) -> DataFrame:
        return self["raw_loan_item"].distinct()

    def _reservation(self) -> DataFrame:
        o = self.raw("orders")
        od = F.col("o_orderdate").cast("date")
        exp = _dplus(od, 365)
        return o.filter((F.col("o_orderstatus") == "P") & (od <= self.as_of)).select(
            _i("o_orderkey").alias("ReservationID"), _i("o_custkey").alias("UserID"),
            od.alias("ReservationDate"), exp.alias("ExpiryDate"),
            F.when(F.col("o_orderkey") % 10 == 0, "Cancelled")
             .when(F.col("o_orderkey") % 7 == 0, "Active")
             .when(exp < self.as_of, "Expired").otherwise("Active").alias("Status"))

    def _reservation_item(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        r = self["reservation"].select("ReservationID").hint("shuffle_hash")
        return li.join(r, li.l_orderkey == r.ReservationID).select(
            "ReservationID", _s("l_partkey").alias("ISBN")).distinct()

    def _book(self) -> DataFrame:
        p = self.raw("part")
        li, lb = self["loan_item"], self["loan_base"]
        on_loan = (li.join(lb.filter(F.col("ReturnDate").isNull()).select("LoanID"), "LoanID")
                   .select(F.col("ISBN").alias("o_ISBN")).distinct())
        ri, rv = self["reservation_item"], self["reservation"]
        reserved = (ri.join(rv.filter((F.col("Status") == "Active")
                                      & (F.col("ExpiryDate") >= self.as_of))
                            .select("ReservationID"), "ReservationID")
                    .select(F.col("ISBN").alias("r_ISBN")).distinct())
        key = _s("p_partkey")
        parts = (p.join(on_loan, key == F.col("o_ISBN"), "left")
                  .join(reserved, key == F.col("r_ISBN"), "left")
                  .select(
                      key.alias("ISBN"),
                      F.concat(F.col("p_name"), F.lit(" "), key).alias("Title"),
                      _i(1950 + F.col("p_size")).alias("PublicationYear"),
                      F.col("p_type").alias("Genre"), F.col("p_brand").alias("Author"),
                      F.when(F.col("p_partkey") % 97 == 0, "Lost")
                       .when(F.col("p_partkey") % 13 == 0, "Available")
                       .when(F.col("o_ISBN").isNotNull(), "Borrowed")
                       .when(F.col("r_ISBN").isNotNull(), "Reserved")
                       .otherwise("Available").alias("Status"),
                      F.concat(F.lit("S"), _s(F.col("p_partkey") % 20)).alias("ShelfLocation")))
        new = self.raw("region").select(
            _s(9000000 + F.col("r_regionkey")).alias("ISBN"),
            F.concat(F.lit("New title "), F.col("r_name")).alias("Title"),
            F.lit(2001).alias("PublicationYear"), F.lit("NEW").alias("Genre"),
            F.lit("New Author").alias("Author"), F.lit("Available").alias("Status"),
            F.lit("S0").alias("ShelfLocation"))
        return parts.unionByName(new)

    def _book_authors(self) -> DataFrame:
        p = self.raw("part")
        a = p.filter(F.col("p_partkey") % 29 != 0).select(
            _s("p_partkey").alias("ISBN"), F.col("p_brand").alias("AuthorName"))
        b = p.filter(F.col("p_partkey") % 4 == 0).select(
            _s("p_partkey").alias("ISBN"),
            F.concat(F.lit("Co-"), F.col("p_type")).alias("AuthorName"))
        c = self.raw("region").select(
            _s(9000000 + F.col("r_regionkey")).alias("ISBN"),
            F.lit("New Author").alias("AuthorName"))
        return a.unionByName(b).unionByName(c)

    def _related_books(self) -> DataFrame:
        from pyspark.sql import Window as W
        p = self.raw("part").select("p_partkey", "p_brand")
        w = W.partitionBy("p_brand").orderBy("p_partkey")
        edges = p.select(_s("p_partkey").alias("ISBN"),
                         F.array(_s(F.lead("p_partkey", 1).over(w)),
                                 _s(F.lead("p_partkey", 2).over(w))).alias("r"))
        return (edges.select("ISBN", F.explode("r").alias("RelatedISBN"))
                .filter(F.col("RelatedISBN").isNotNull()))

    def _processed_by(self) -> DataFrame:
        e = self.raw("events")
        ad = _dplus(F.col("ts").cast("date"), -8219)
        et = F.col("event_type")
        return e.filter(ad <= self.as_of).select(
            _i("event_id").alias("ProcessID"), _i(1 + F.col("user_id") % 10).alias("EmployeeID"),
            F.when(et == "view", "Book").when(et == "signup", "Reservation")
             .otherwise("Loan").alias("EntityType"),
            _i(F.col("event_id") % 1500).alias("EntityID"), ad.alias("ActionDate"))

    def _report(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            _i(F.col("s_suppkey") + 1).alias("ReportID"),
            F.when(F.col("s_suppkey") % 9 == 8, F.lit(None).cast("int"))
             .otherwise(_i(F.col("s_suppkey") + 1)).alias("GeneratedBy"),
            _dplus(self.as_of, _i(0 - F.col("s_suppkey") % 30)).alias("GenerationDate"),
            F.when(F.col("s_suppkey") % 2 == 0, "Monthly Revenue Report")
             .otherwise("Book Inventory Report").alias("Type"),
            F.lit("{}").alias("Content"))

    # -- dirty and event inputs --------------------------------------------
    def _raw_user(self) -> DataFrame:
        u = self["library_user"]
        uid = F.col("UserID")
        a = u.select(
            "UserID",
            F.when(uid % 25 == 3, F.lit(None).cast("string")).otherwise(F.col("Name")).alias("Name"),
            F.when(uid % 10 == 1, F.lit(None).cast("string"))
             .when(uid % 40 == 2, "shared@example.org")
             .when(uid % 30 == 4, "not-an-email").otherwise(F.col("Email")).alias("Email"),
            F.when(uid % 35 == 5, "555-0100-0000-0000-0000-0000").otherwise("555-0100").alias("Phone"),
            "City", "Zip", "MembershipDate")
        b = u.filter(uid % 60 == 6).select(
            "UserID", "Name", F.concat(F.lit("dup."), F.col("Email")).alias("Email"),
            F.lit("555-0101").alias("Phone"), "City", "Zip", "MembershipDate")
        return a.unionByName(b)

    def _raw_book(self) -> DataFrame:
        b = self["book"]
        k = F.col("ISBN").cast("int")
        return b.select(
            "ISBN", F.when(k % 30 == 7, F.lit(None).cast("string")).otherwise(F.col("Title")).alias("Title"),
            F.when(k % 41 == 8, 1850).otherwise(F.col("PublicationYear")).alias("PublicationYear"),
            "Genre", "Author",
            F.when(k % 20 == 9, "Missing").when(k % 20 == 10, F.lower("Status"))
             .otherwise(F.col("Status")).alias("Status"))

    def _raw_fine(self) -> DataFrame:
        f = self["fine"]
        fid = F.col("FineID")
        return f.select(
            "FineID",
            F.when(fid % 50 == 1, F.col("LoanID") + 100000000).otherwise(F.col("LoanID")).alias("LoanID"),
            F.when(fid % 45 == 2, F.col("UserID") + 100000000)
             .when(fid % 45 == 3, F.lit(None).cast("int")).otherwise(F.col("UserID")).alias("UserID"),
            "IssueDate",
            F.when(fid % 40 == 4, F.lit("1234567.89").cast("decimal(12,2)"))
             .when(fid % 40 == 5, F.lit(None).cast("decimal(12,2)"))
             .otherwise(F.col("Amount").cast("decimal(12,2)")).alias("Amount"),
            "Status", "Description")

    def _delete_user(self) -> DataFrame:
        return self["library_user"].filter(F.col("UserID") % 50 == 0).select("UserID")

    def _delete_book(self) -> DataFrame:
        k = F.col("ISBN").cast("int")
        keep = self["book"].filter((k % 97 == 0) | k.isin(9000000, 9000001, 9000002)).select("ISBN")
        return keep.unionByName(self.spark.range(1).select(F.lit("99999999").alias("ISBN")))

    def _delete_employee(self) -> DataFrame:
        return self["employee"].filter(F.col("EmployeeID") % 5 == 0).select("EmployeeID")

    def _rekey_book(self) -> DataFrame:
        k = F.col("ISBN").cast("int")
        return self["book"].filter((k % 53 == 0) | (k >= 9000003)).select(
            F.col("ISBN").alias("OldISBN"),
            F.when(F.col("ISBN") == "9000004", "1")
             .otherwise(F.concat(F.lit("978-"), F.col("ISBN"))).alias("NewISBN"))

    def _circulation_event(self) -> DataFrame:
        lb = self["loan_base"]
        issue = lb.select("LoanID", "UserID", F.lit("ISSUE").alias("Kind"),
                          F.col("CheckoutDate").alias("EventDate"), F.lit(1).alias("Seq"))
        renew_day = _dplus(F.col("DueDate"), -1)
        renew = lb.filter((F.col("LoanID") % 8 == 0)
                          & (renew_day <= F.coalesce(F.col("ReturnDate"), self.as_of))).select(
            "LoanID", "UserID", F.lit("RENEW").alias("Kind"), renew_day.alias("EventDate"),
            F.lit(2).alias("Seq"))
        ret = lb.filter(F.col("ReturnDate").isNotNull()).select(
            "LoanID", "UserID", F.lit("RETURN").alias("Kind"),
            F.col("ReturnDate").alias("EventDate"), F.lit(3).alias("Seq"))
        return issue.unionByName(renew).unionByName(ret)

    def _loan_request(self) -> DataFrame:
        e = self.raw("events")
        return e.filter(F.col("event_type") == "purchase").select(
            _i("event_id").alias("RequestID"), _i("user_id").alias("UserID"),
            F.when(F.col("event_id") % 50 == 0, "99999999")
             .otherwise(_s((F.col("event_id") * 31) % 210)).alias("ISBN"),
            self.as_of.alias("RequestDate"))

    def _raw_signup(self) -> DataFrame:
        r = self["raw_user"]
        uid = F.col("UserID")
        return r.select(
            uid.alias("SubmissionID"),
            F.when(uid % 25 == 3, "").otherwise(F.split_part("Name", F.lit("#"), F.lit(1))).alias("firstName"),
            F.split_part("Name", F.lit("#"), F.lit(2)).alias("lastName"),
            F.when(F.col("Email").isNull(), F.lit(None).cast("string"))
             .when(uid % 4 == 0, F.upper("Email"))
             .otherwise(F.upper(F.concat(F.lit("new."), F.col("Email")))).alias("email"),
            F.col("Phone").alias("phone"), F.col("City").alias("address"),
            (uid % 15 != 0).alias("terms"))


_REGISTRY: dict[tuple[str, str], Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """One lazily built fixture set per (session, folder)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _REGISTRY:
        _REGISTRY[key] = Fixtures(spark, sf_dir)
    return _REGISTRY[key]
