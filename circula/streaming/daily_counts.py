"""Live daily counts per event kind ("checked out today", "new today").

A watermarked tumbling-window count in ``update`` mode; every micro-batch
upserts the changed (day, kind) rows into the sink by key.  The sink is a
plain parquet folder, so each batch writes a new version folder named by its
batch id (a replayed batch rewrites the same folder - idempotent) holding
the previous version minus the changed keys plus the changed rows.  Only
versions with Spark's ``_SUCCESS`` mark are read, so a version that a failed
attempt left half-written never is, and versions before the previous one are
removed.  State is one row per (day, kind) and old days are dropped by the watermark.

A redelivered event counts once: event ids are remembered until the watermark
has passed them (in the RocksDB state store), and a redelivery after that is late.  Events without an id
are told apart by all of their values.  A null kind is a kind.  Events
without a time belong to no day; they go to ``<sink>/rejects/batch=<id>``.

Late data: events inside ``delay`` always count (so the result equals the
batch count when no event is later than that); Spark drops an event that is
behind the watermark set by the previous micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.sources.paths import delete_path, list_dirs, path_exists
from circula.streaming.circulation_stream import ROCKSDB
from circula.streaming.running import Running

EVENTS_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                 "value DOUBLE, props STRING")


def daily_counts(events: DataFrame, delay: str = "1 day", ts_col: str = "ts",
                 kind_col: str = "event_type", id_col: str = "event_id") -> DataFrame:
    """Streaming (or batch) frame of running counts per (UTC day, kind).

    A wall-clock ``TIMESTAMP_NTZ`` event time is read as UTC (watermarks need
    an instant); windows are whole UTC days whatever the session time zone.
    """
    ts = F.col(ts_col)
    if events.schema[ts_col].dataType.typeName() == "timestamp_ntz":
        tz = events.sparkSession.conf.get("spark.sql.session.timeZone")
        ts = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts).cast("timestamp")
    row = F.when(F.col(id_col).isNull(), F.xxhash64(*events.columns))  # what tells events without an id apart
    timed = (events.withColumn("_event_time", ts).withColumn("_row", row).filter(F.col("_event_time").isNotNull())
             .withWatermark("_event_time", delay))
    once = (timed.dropDuplicatesWithinWatermark([id_col, "_row"]) if events.isStreaming
            else timed.dropDuplicates([id_col, "_row"]))
    return (once
            .groupBy(F.window("_event_time", "1 day").alias("w"), F.col(kind_col).alias("Kind"))
            .agg(F.count(F.lit(1)).alias("Events")))


def window_day(window_col: str = "w"):
    """The UTC calendar day of a 1-day window (independent of the session zone)."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(F.col(f"{window_col}.start")) / 86400).cast("int"))


def _version(batch_id: int) -> str:
    return f"v{batch_id:012d}"


def latest_version(spark: SparkSession, sink: str) -> str | None:
    versions = _finished(spark, sink)
    return f"{sink.rstrip('/')}/{versions[-1]}" if versions else None


def _finished(spark: SparkSession, sink: str) -> list[str]:
    """Versions that were written to the end, oldest first."""
    return [d for d in list_dirs(spark, sink)
            if d.startswith("v") and path_exists(spark, f"{sink.rstrip('/')}/{d}/_SUCCESS")]


def read_daily_counts(spark: SparkSession, sink: str) -> DataFrame:
    path = latest_version(spark, sink)
    if path is None:
        return spark.createDataFrame([], "Day date, Kind string, Events bigint")
    return spark.read.parquet(path)


def read_rejects(spark: SparkSession, sink: str) -> DataFrame:
    """Events without a time, over all finished batches."""
    root = f"{sink.rstrip('/')}/rejects"
    dirs = [d for d in list_dirs(spark, root) if path_exists(spark, f"{root}/{d}/_SUCCESS")]
    if not dirs:
        return spark.createDataFrame([], EVENTS_SCHEMA)
    return spark.read.schema(EVENTS_SCHEMA).parquet(*[f"{root}/{d}" for d in dirs])


def stream_daily_counts(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
                        delay: str = "1 day", glob: str | None = None,
                        max_files_per_trigger: int | None = None, available_now: bool = True) -> Running:
    """Run W1 from parquet files in ``source_dir`` into the versioned ``sink``.

    Returns the handles of the counts' query and the rejects' query (both
    finished if ``available_now``).
    """
    sink = sink.rstrip("/")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def events() -> DataFrame:
        reader = spark.readStream.schema(EVENTS_SCHEMA)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(source_dir)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        changed = batch.select(window_day("w").alias("Day"), "Kind", "Events")
        before = [v for v in _finished(s, sink) if v < _version(batch_id)]
        merged = changed
        if before:
            old, new = s.read.parquet(f"{sink}/{before[-1]}"), changed.select("Day", "Kind")
            same = old["Day"].eqNullSafe(new["Day"]) & old["Kind"].eqNullSafe(new["Kind"])
            merged = old.join(new, same, "left_anti").unionByName(changed)
        merged.write.mode("overwrite").parquet(f"{sink}/{_version(batch_id)}")
        for v in before[:-1]:  # the previous one stays for a replay of this batch
            delete_path(s, f"{sink}/{v}")

    def refuse(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/rejects/batch={batch_id}")

    def start(frame: DataFrame, mode: str, write, name: str):
        writer = (frame.writeStream.outputMode(mode).foreachBatch(write)
                  .option("checkpointLocation", f"{checkpoint}/{name}"))
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    running = Running(start(daily_counts(events(), delay), "update", upsert, "counts"),
                      start(events().filter(F.col("ts").isNull()), "append", refuse, "rejects"))
    if available_now:
        running.awaitTermination()
    return running
