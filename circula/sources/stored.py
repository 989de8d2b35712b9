"""Tables at rest: the fixture views written once as parquet, read back typed.

This is how the operators meet data in production - every table is a
parquet folder - and it is what the bench times.

With ``buckets`` the parent/child pairs that are joined on their key in most
operators are written as bucketed catalog tables on that key (same bucket
count on both sides, sorted by the key), so those joins read co-located
buckets and shuffle neither side:

* loan / loan_item on LoanID (figures, fines, lists, recommendations, deletes)
* reservation / reservation_item on ReservationID (queues, status drift)
* fine / payment on FineID (settlement drift, revenue, deletes)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from circula.sources.fixtures import FIXTURE_VIEWS, Fixtures

# With ``by_date``, the dated event tables are partitioned by their date
# column, so the operators' own date predicates (checked out on as_of, a
# report period, actions this month, ...) become partition filters.
DATE_PARTITIONS = {"loan": "CheckoutDate", "payment": "PaymentDate", "processed_by": "ActionDate"}

BUCKET_KEYS = {
    "loan": "LoanID", "loan_item": "LoanID",
    "reservation": "ReservationID", "reservation_item": "ReservationID",
    "fine": "FineID", "payment": "FineID",
}


def _table_name(db: str, name: str) -> str:
    return f"{db}.{name}"


def materialize(spark: SparkSession, sf_dir: str, out_dir: str, names=FIXTURE_VIEWS,
                buckets: int | None = None, database: str = "circula_store",
                by_date: bool = False) -> None:
    fx = Fixtures(spark, sf_dir)
    root = out_dir.rstrip("/")
    if buckets:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/_catalog'")
    for name in names:
        df = fx[name]
        key = BUCKET_KEYS.get(name)
        if by_date and name in DATE_PARTITIONS:
            df.write.mode("overwrite").partitionBy(DATE_PARTITIONS[name]).parquet(f"{root}/{name}")
        elif buckets and key:
            (df.write.mode("overwrite").format("parquet").option("path", f"{root}/{name}")
             .bucketBy(buckets, key).sortBy(key).saveAsTable(_table_name(database, name)))
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")


class StoredTables:
    """Dict-like view of materialized tables (same keys as ``Fixtures``)."""

    def __init__(self, spark: SparkSession, root: str, sf_dir: str | None = None,
                 bucketed: bool = False, database: str = "circula_store"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.sf_dir = sf_dir
        self.bucketed = bucketed
        self.database = database
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in FIXTURE_VIEWS:
            raise KeyError(name)
        if name not in self._cache:
            if self.bucketed and name in BUCKET_KEYS:
                self._cache[name] = self.spark.table(_table_name(self.database, name))
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.root}/{name}")
        return self._cache[name]

    def __contains__(self, name: object) -> bool:
        return name in FIXTURE_VIEWS
