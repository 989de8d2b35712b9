"""Referential actions: bulk deletes with CASCADE / RESTRICT / SET NULL and
ISBN re-keying (R1-R5).

Each action returns ``(tables, counts)`` - the changed tables (survivors, as
lazy DataFrames to be written by the caller) and a count frame
``(table_name, action, row_count)`` - and R2 / R4 add a per-key outcome
frame as a third item.  Doomed keys flow down the foreign-key chain
with ``left_semi`` joins; survivors are ``left_anti`` joins against them.
Key lists can be large, so no side is forced to broadcast; AQE picks, and can
split a hot key (``spread_join``).

Every doomed key set is materialized once (``checkpoint`` into
``spark.checkpoint.dir``): the survivor tables and the counts all read it, so
the key chain (users -> loans -> fines -> payments ...) is derived once and
each table is scanned once per output, not once per dependent key set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.operators.ranking import spread_join
from circula.schema import table
from circula.session import ensure_checkpoint_dir
from circula.sources.paths import delete_path, list_dirs, path_exists
from circula.sources.tables import load_table

COUNT_COLS = "table_name string, action string, row_count bigint"


def _keys(df: DataFrame) -> DataFrame:
    """A doomed key set, materialized once for all its readers."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.distinct().checkpoint(eager=True)


def _count(df: DataFrame, tname: str, action: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(tname).alias("table_name"), F.lit(action).alias("action"), "row_count")


def _counts(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_count(df, n, a) for df, n, a in parts])


def _loan_chain(t: dict, doomed_loans: DataFrame, doomed_users: DataFrame | None = None):
    """Loans -> LoanItem, Fine (by loan or by user) -> Payment."""
    loan_keys = _keys(doomed_loans.select("LoanID"))
    items = spread_join(t["loan_item"], loan_keys, ["LoanID"], "left_semi")
    fine = t["fine"]
    by_loan = spread_join(fine, loan_keys, ["LoanID"], "left_semi")
    if doomed_users is not None:
        by_user = spread_join(fine, doomed_users, ["UserID"], "left_semi")
        doomed_fines = _keys(by_loan.unionByName(by_user).select("FineID"))
    else:
        doomed_fines = _keys(by_loan.select("FineID"))
    payments = spread_join(t["payment"], doomed_fines, ["FineID"], "left_semi")
    return loan_keys, items, doomed_fines, payments


def delete_users(t: dict, keys: DataFrame):
    """User -> Loan -> LoanItem; Fine (its loan *or* its user is deleted)
    -> Payment; User -> Reservation -> ReservationItem."""
    user_keys = _keys(t["library_user"].join(keys.select("UserID").distinct(), "UserID", "left_semi")
                      .select("UserID"))
    loans = spread_join(t["loan"], user_keys, ["UserID"], "left_semi")
    loan_keys, items, fine_keys, payments = _loan_chain(t, loans, user_keys)
    res_keys = _keys(spread_join(t["reservation"], user_keys, ["UserID"], "left_semi").select("ReservationID"))
    res_items = spread_join(t["reservation_item"], res_keys, ["ReservationID"], "left_semi")
    tables = {
        "library_user": spread_join(t["library_user"], user_keys, ["UserID"], "left_anti"),
        "loan": spread_join(t["loan"], loan_keys, ["LoanID"], "left_anti"),
        "loan_item": spread_join(t["loan_item"], loan_keys, ["LoanID"], "left_anti"),
        "fine": spread_join(t["fine"], fine_keys, ["FineID"], "left_anti"),
        "payment": spread_join(t["payment"], fine_keys, ["FineID"], "left_anti"),
        "reservation": spread_join(t["reservation"], res_keys, ["ReservationID"], "left_anti"),
        "reservation_item": spread_join(t["reservation_item"], res_keys, ["ReservationID"], "left_anti"),
    }
    # the keys are primary keys: counting the key sets is counting the rows
    counts = _counts([(user_keys, "library_user", "DELETE"), (loan_keys, "loan", "CASCADE"),
                      (items, "loan_item", "CASCADE"), (fine_keys, "fine", "CASCADE"),
                      (payments, "payment", "CASCADE"), (res_keys, "reservation", "CASCADE"),
                      (res_items, "reservation_item", "CASCADE")])
    return tables, counts


def delete_loans(t: dict, keys: DataFrame):
    """Loan -> LoanItem, Fine -> Payment."""
    loans = t["loan"].join(keys.select("LoanID").distinct(), "LoanID", "left_semi")
    loan_keys, items, fine_keys, payments = _loan_chain(t, loans)
    tables = {
        "loan": spread_join(t["loan"], loan_keys, ["LoanID"], "left_anti"),
        "loan_item": spread_join(t["loan_item"], loan_keys, ["LoanID"], "left_anti"),
        "fine": spread_join(t["fine"], fine_keys, ["FineID"], "left_anti"),
        "payment": spread_join(t["payment"], fine_keys, ["FineID"], "left_anti"),
    }
    counts = _counts([(loan_keys, "loan", "DELETE"), (items, "loan_item", "CASCADE"),
                      (fine_keys, "fine", "CASCADE"), (payments, "payment", "CASCADE")])
    return tables, counts


def delete_reservations(t: dict, keys: DataFrame):
    """Reservation -> ReservationItem."""
    res_keys = _keys(t["reservation"].join(keys.select("ReservationID").distinct(), "ReservationID", "left_semi")
                     .select("ReservationID"))
    res = spread_join(t["reservation"], res_keys, ["ReservationID"], "left_semi")
    items = spread_join(t["reservation_item"], res_keys, ["ReservationID"], "left_semi")
    tables = {
        "reservation": spread_join(t["reservation"], res_keys, ["ReservationID"], "left_anti"),
        "reservation_item": spread_join(t["reservation_item"], res_keys, ["ReservationID"], "left_anti"),
    }
    counts = _counts([(res, "reservation", "DELETE"), (items, "reservation_item", "CASCADE")])
    return tables, counts


def book_delete_outcomes(t: dict, keys: DataFrame) -> DataFrame:
    """R2 per key: 'not found', 'refused' (RESTRICT: a LoanItem or
    ReservationItem still points at it) or 'deleted'."""
    k = keys.select("ISBN").distinct()
    # the referencing rows are cut to the keys with k under an exchange of its own, so that AQE can
    # split a hot ISBN
    used = (spread_join(t["loan_item"].select("ISBN").unionByName(t["reservation_item"].select("ISBN")),
                        k, ["ISBN"], "left_semi").distinct().withColumn("_used", F.lit(True)))
    exists = t["book"].select("ISBN").join(k, "ISBN", "left_semi").withColumn("_exists", F.lit(True))
    return (k.join(exists, "ISBN", "left").join(used, "ISBN", "left")
            .select("ISBN", F.when(F.col("_exists").isNull(), F.lit("not found"))
                    .when(F.col("_used"), F.lit("refused"))
                    .otherwise(F.lit("deleted")).alias("Outcome")))


def delete_books(t: dict, keys: DataFrame):
    """R2: refuse books still referenced by LoanItem / ReservationItem (per
    key; the rest of the batch proceeds); for the others drop BookAuthors and
    both sides of RelatedBooks."""
    outcomes = _keys(book_delete_outcomes(t, keys))
    # the outcomes are distributed by ISBN and Outcome, so a join on ISBN gets exchanges on both sides
    gone = outcomes.filter(F.col("Outcome") == "deleted").select("ISBN")
    refused = outcomes.filter(F.col("Outcome") == "refused")
    books = t["book"].join(gone, "ISBN", "left_semi")
    authors = t["book_authors"].join(gone, "ISBN", "left_semi")
    rel = t["related_books"]
    rel_doomed = (rel.join(gone, "ISBN", "left_semi")
                  .unionByName(rel.join(gone.withColumnRenamed("ISBN", "RelatedISBN"), "RelatedISBN", "left_semi"))
                  .distinct())
    tables = {
        "book": t["book"].join(gone, "ISBN", "left_anti"),
        "book_authors": t["book_authors"].join(gone, "ISBN", "left_anti"),
        "related_books": (rel.join(gone, "ISBN", "left_anti")
                          .join(gone.withColumnRenamed("ISBN", "RelatedISBN"), "RelatedISBN", "left_anti")
                          .select("ISBN", "RelatedISBN")),
    }
    counts = _counts([(books, "book", "DELETE"), (refused, "book", "REFUSED"),
                      (authors, "book_authors", "CASCADE"), (rel_doomed, "related_books", "CASCADE")])
    return tables, counts, outcomes


def delete_employees(t: dict, keys: DataFrame):
    """ProcessedBy rows cascade; Report.GeneratedBy is set to null."""
    ek = _keys(t["employee"].join(keys.select("EmployeeID").distinct(), "EmployeeID", "left_semi")
               .select("EmployeeID"))
    emp = spread_join(t["employee"], ek, ["EmployeeID"], "left_semi")
    pb = spread_join(t["processed_by"], ek, ["EmployeeID"], "left_semi")
    rep_hit = spread_join(t["report"], ek.withColumnRenamed("EmployeeID", "GeneratedBy"), ["GeneratedBy"], "left_semi")
    flagged = spread_join(t["report"], ek.select(F.col("EmployeeID").alias("GeneratedBy"),
                                                 F.lit(True).alias("_gone")), ["GeneratedBy"], "left")
    report = flagged.select(*[F.when(F.col("_gone"), F.lit(None).cast("int")).otherwise(F.col(c)).alias(c)
                              if c == "GeneratedBy" else F.col(c) for c in t["report"].columns])
    tables = {
        "employee": spread_join(t["employee"], ek, ["EmployeeID"], "left_anti"),
        "processed_by": spread_join(t["processed_by"], ek, ["EmployeeID"], "left_anti"),
        "report": report,
    }
    counts = _counts([(emp, "employee", "DELETE"), (pb, "processed_by", "CASCADE"),
                      (rep_hit, "report", "SET NULL")])
    return tables, counts


def rekey_outcomes(t: dict, mapping: DataFrame) -> DataFrame:
    """R4 per map row, first failing rule wins: 'null key'; 'key too long' (for
    the ISBN column); 'not found'; 'referenced'
    (RelatedBooks, ReservationItem or LoanItem still use the old key - no ON
    UPDATE clause there, so RESTRICT); 'ambiguous' (an old key mapped twice
    or two old keys to one new key); 'new key exists'; else 'renamed'."""
    every = mapping.select("OldISBN", "NewISBN").distinct()
    m = every.dropna()
    old = m.select(F.col("OldISBN").alias("ISBN")).distinct()
    refs = (t["related_books"].select("ISBN")
            .unionByName(t["related_books"].select(F.col("RelatedISBN").alias("ISBN")))
            .unionByName(t["reservation_item"].select("ISBN"))
            .unionByName(t["loan_item"].select("ISBN")))
    refs = (spread_join(refs, old, ["ISBN"], "left_semi").distinct()
            .select(F.col("ISBN").alias("OldISBN"), F.lit(True).alias("_ref")))
    exists_old = (t["book"].select("ISBN").join(old, "ISBN", "left_semi")
                  .select(F.col("ISBN").alias("OldISBN"), F.lit(True).alias("_old")))
    exists_new = (t["book"].select("ISBN")
                  .join(m.select(F.col("NewISBN").alias("ISBN")), "ISBN", "left_semi").distinct()
                  .select(F.col("ISBN").alias("NewISBN"), F.lit(True).alias("_new")))
    per_old = m.groupBy("OldISBN").agg(F.count(F.lit(1)).alias("_n_old"))
    per_new = m.groupBy("NewISBN").agg(F.count(F.lit(1)).alias("_n_new"))
    j = spread_join(m, exists_old.distinct(), ["OldISBN"], "left")
    j = spread_join(j, refs, ["OldISBN"], "left")
    j = spread_join(j, per_old, ["OldISBN"], "left")
    j = spread_join(j, per_new, ["NewISBN"], "left")
    j = spread_join(j, exists_new, ["NewISBN"], "left")
    longest = table("book").lengths["ISBN"]
    outcome = (F.when(F.char_length("NewISBN") > longest, F.lit("key too long"))
               .when(F.col("_old").isNull(), F.lit("not found"))
               .when(F.col("_ref"), F.lit("referenced"))
               .when((F.col("_n_old") > 1) | (F.col("_n_new") > 1), F.lit("ambiguous"))
               .when(F.col("_new"), F.lit("new key exists"))
               .otherwise(F.lit("renamed")))
    nulls = every.filter(F.col("OldISBN").isNull() | F.col("NewISBN").isNull())
    return j.select("OldISBN", "NewISBN", outcome.alias("Outcome")).unionByName(
        nulls.withColumn("Outcome", F.lit("null key")))


def rekey_books(t: dict, mapping: DataFrame):
    """Change ISBNs; BookAuthors follows (its only ON UPDATE CASCADE)."""
    outcomes = _keys(rekey_outcomes(t, mapping))
    ok = outcomes.filter(F.col("Outcome") == "renamed").select("OldISBN", "NewISBN")

    def rename(df: DataFrame) -> DataFrame:
        j = df.join(ok.withColumnRenamed("OldISBN", "ISBN"), "ISBN", "left")
        return j.select(*[F.coalesce("NewISBN", "ISBN").alias("ISBN") if c == "ISBN" else F.col(c)
                          for c in df.columns])

    books_hit = t["book"].join(ok.select(F.col("OldISBN").alias("ISBN")), "ISBN", "left_semi")
    authors_hit = t["book_authors"].join(ok.select(F.col("OldISBN").alias("ISBN")), "ISBN", "left_semi")
    tables = {"book": rename(t["book"]), "book_authors": rename(t["book_authors"])}
    counts = _counts([(books_hit, "book", "UPDATE"), (authors_hit, "book_authors", "CASCADE"),
                      (outcomes.filter(F.col("Outcome") != "renamed"), "book", "REFUSED")])
    return tables, counts, outcomes


def apply_action(tables: dict, root: str, version: str) -> dict[str, str]:
    """Write the changed tables of an action as new version folders
    ``<root>/<table>/v=<version>``, then one completion mark for all of them, and return their paths.

    The survivors are computed from the current tables, which may live under
    the same root, so a new version is written instead of overwriting the
    folder being read; rerunning the same version takes its mark away first and rewrites the same folders.
    The mark, ``<root>/_versions/v=<version>``, is written last and names the tables, so a
    stop between two tables leaves no version.  Read a version back with :func:`read_version`,
    never by the table's own folder, which holds all its versions.
    """
    if not tables:
        raise ValueError("an action without tables makes no version")
    root = root.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    delete_path(spark, _mark(root, version))
    paths = {}
    for name, df in tables.items():
        path = f"{root}/{name}/v={version}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    names = spark.createDataFrame([(name,) for name in tables], "table_name string")
    names.coalesce(1).write.parquet(_mark(root, version))  # a handful of names
    return paths


def _mark(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/_versions/v={version}"


def versions(spark: SparkSession, root: str) -> list[str]:
    """The versions that were written to the end, in order of their names."""
    base = f"{root.rstrip('/')}/_versions"
    return [d[2:] for d in list_dirs(spark, base) if d.startswith("v=") and path_exists(spark, f"{base}/{d}/_SUCCESS")]


def version_tables(spark: SparkSession, root: str, version: str) -> list[str]:
    """The tables that an action wrote under ``version``; FileNotFoundError if it was not written to the end."""
    if not path_exists(spark, f"{_mark(root, version)}/_SUCCESS"):
        raise FileNotFoundError(f"no finished version {version!r} under {root}")
    return sorted(r.table_name for r in spark.read.parquet(_mark(root, version)).collect())  # a handful of names


def read_version(spark: SparkSession, root: str, tname: str, version: str) -> DataFrame:
    """The table as :func:`apply_action` wrote it under ``version``: FileNotFoundError if
    the version was not written to the end, KeyError if the action left the table alone."""
    if tname not in version_tables(spark, root, version):
        raise KeyError(f"version {version!r} has no table {tname}")
    return load_table(spark, tname, f"{root.rstrip('/')}/{tname}/v={version}")
