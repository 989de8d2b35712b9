"""Keep Loan rows current from a stream of ISSUE / RENEW / RETURN events.

The stream is T2's own aggregation (``loan_facts``) in update mode: one group
per LoanID, whose state is the earliest issue, the earliest return and the
distinct renewals, kept in the RocksDB state store.  A micro-batch costs its
own events and the touched loans' state, however long the history is, and
no event history is read again.  The fold is order-free, so late, repeated
and replayed events do no harm, and no watermark is needed.

Each micro-batch writes the loans it changed under ``loans/batch=<id>`` and
events without a LoanID under ``rejects/batch=<id>``; a replayed batch
rewrites its own folders.  ``compact`` folds all finished batches but the newest
(the only one that Spark can replay) into a snapshot beside them,
``snapshots/upto=<id>``, which is written under another name and published by one
rename.  The current Loan table is the newest row per LoanID (an aggregate, combined
map-side) over the newest snapshot and the finished batches after it; finished
are folders with Spark's ``_SUCCESS`` mark.  Batches up to a snapshot's id are not read any more, so it
does not matter whether they are still there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.functions.common import read_policy
from circula.operators.circulation import due_from_facts, loan_facts
from circula.sources.paths import delete_path, list_dirs, path_exists, rename_path
from circula.streaming.running import Running

EVENT_SCHEMA = "LoanID INT, UserID INT, Kind STRING, EventDate DATE, Seq INT"
LOAN_SCHEMA = "LoanID INT, UserID INT, CheckoutDate DATE, DueDate DATE, ReturnDate DATE, Renewals BIGINT"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(folder: str) -> int:
    return int(folder.split("=", 1)[1])


def _finished(spark: SparkSession, root: str, prefix: str = "batch=") -> list[str]:
    """Folders that were written to the end, oldest first."""
    dirs = [d for d in list_dirs(spark, root) if d.startswith(prefix)]
    return sorted((d for d in dirs if path_exists(spark, f"{root}/{d}/_SUCCESS")), key=_number)


def _read(spark: SparkSession, root: str, dirs: list[str], schema: str) -> DataFrame:
    if not dirs:
        return spark.createDataFrame([], f"{schema}, batch INT")
    return (spark.read.schema(f"{schema}, batch INT").option("basePath", root)
            .parquet(*[f"{root}/{d}" for d in dirs]))


def _newest(rows: DataFrame) -> DataFrame:
    """The row of the newest batch for each LoanID."""
    cols = [c for c in rows.columns if c not in ("LoanID", "batch")]
    newest = rows.groupBy("LoanID").agg(F.max_by(F.struct(*cols), "batch").alias("_r"))
    return newest.select("LoanID", *[F.col(f"_r.{c}").alias(c) for c in cols])


def _loans(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame:
    """Newest row per LoanID over the newest snapshot and the finished batches
    after it (those up to ``upto``, if given)."""
    made = _finished(spark, f"{state}/snapshots", "upto=")
    covered = _number(made[-1]) if made else -1
    dirs = [d for d in _finished(spark, f"{state}/loans") if covered < _number(d) and (upto is None or _number(d) <= upto)]
    rows = _read(spark, f"{state}/loans", dirs, LOAN_SCHEMA)
    if made:
        base = spark.read.schema(LOAN_SCHEMA).parquet(f"{state}/snapshots/{made[-1]}")
        rows = rows.unionByName(base.withColumn("batch", F.lit(covered)))
    return _newest(rows)


def current_loans(spark: SparkSession, state: str) -> DataFrame:
    """Newest row per LoanID over all finished batches."""
    return _loans(spark, state.rstrip("/"))


def rejected_events(spark: SparkSession, state: str) -> DataFrame:
    """Events without a LoanID, over all finished batches."""
    root = f"{state.rstrip('/')}/rejects"
    return _read(spark, root, _finished(spark, root), EVENT_SCHEMA).drop("batch")


def compact(spark: SparkSession, state: str) -> None:
    """Fold all finished batches but the newest into a snapshot, and remove what the snapshot covers.

    May run beside the stream (it only reads batches that are never rewritten),
    one compaction at a time, while no reader holds an older listing.  A stop at any point loses nothing: before the
    rename, the half-made folder is not read, and the next call deletes it;
    after it, covered folders that are left are not read, and the next call deletes them.
    """
    state = state.rstrip("/")
    snapshots = f"{state}/snapshots"
    for d in list_dirs(spark, snapshots):
        if d.startswith("making="):
            delete_path(spark, f"{snapshots}/{d}")
    batches = _finished(spark, f"{state}/loans")
    made = _finished(spark, snapshots, "upto=")
    covered = _number(made[-1]) if made else -1
    upto = _number(batches[-2]) if len(batches) > 1 else -1
    if upto > covered:
        making = f"{snapshots}/making={upto}"
        _loans(spark, state, upto).write.mode("overwrite").parquet(making)
        rename_path(spark, making, f"{snapshots}/upto={upto}")
        covered, made = upto, [*made, f"upto={upto}"]
    for d in batches:
        if _number(d) <= covered:
            delete_path(spark, f"{state}/loans/{d}")
    for d in made[:-1]:
        delete_path(spark, f"{snapshots}/{d}")


def stream_circulation(spark: SparkSession, source_dir: str, state: str, checkpoint: str, policy,
                       max_files_per_trigger: int | None = None, available_now: bool = True) -> Running:
    """Run W2 over parquet event files in ``source_dir``; returns the handles of
    the loans' query and the rejects' query (both finished if ``available_now``).

    The session's state store provider is set to RocksDB, so that the state
    of many loans lies on disk and in the checkpoint, not in the heap.
    """
    policy = read_policy(policy)
    state = state.rstrip("/")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def events():
        reader = spark.readStream.schema(EVENT_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(source_dir)

    def keep(batch: DataFrame, batch_id: int) -> None:
        due_from_facts(batch, policy).write.mode("overwrite").parquet(f"{state}/loans/batch={batch_id}")

    def start(frame: DataFrame, name: str):
        writer = frame.option("checkpointLocation", f"{checkpoint}/{name}")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def refuse(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/rejects/batch={batch_id}")

    query = start(loan_facts(events().filter(F.col("LoanID").isNotNull()))
                  .writeStream.outputMode("update").foreachBatch(keep), "loans")
    refused = start(events().filter(F.col("LoanID").isNull()).writeStream.foreachBatch(refuse), "rejects")
    running = Running(query, refused)
    if available_now:
        running.awaitTermination()
    return running
