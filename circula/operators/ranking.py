"""Ranking building blocks that stay correct and balanced when one key is hot.

* :func:`top_k_per_group` - ``row_number() <= k`` per group.  With a literal
  ``k`` Spark plans a partial ``WindowGroupLimit`` before the shuffle, so a
  group holding a third of all rows ships at most ``k`` rows per map task.
* :func:`sequence_numbers` - a full, gap-free ``row_number`` (global or per
  group) that never puts a hot group into one task: the rows are
  range-partitioned on (group, order) so a hot
  group is split across many tasks, each task numbers its rows locally, and
  per-partition offsets (a summary with at most one row per partition and
  group) turn local numbers into final ones.  The ranged input is
  checkpointed into ``spark.checkpoint.dir`` first, so the counting pass and
  the numbering pass see the very same partitions even if executors are lost
  and work is recomputed.  Inputs of every size take this one path.
* :func:`spread_join` - an equi-join whose hot keys AQE can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from circula.session import ensure_checkpoint_dir

# Largest (partition, group) summary that is broadcast (about 50 bytes a row).
SUMMARY_BROADCAST_ROWS = 500_000


def _sort_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """``left.join(right, on, how)`` whose hot keys AQE can split.

    A side that was just grouped on the key needs no exchange, and then Spark
    cannot split the other side.  Joining on a hash of the key as well puts an
    exchange under both sides.  Rows of ``left`` with a null in the key match
    nothing; their hash is that of the whole row, so they spread.
    """
    keys = list(on)
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    scalar = [c for c, kind in left.dtypes if not kind.startswith(("map", "variant"))]
    lhs = left.withColumn("_spread", F.when(some_null, F.xxhash64(*scalar)).otherwise(F.xxhash64(*keys)))
    rhs = right.withColumn("_spread", F.xxhash64(*keys))
    return lhs.join(rhs, ["_spread", *keys], how).drop("_spread")


def top_k_per_group(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence,
                    k: int, rank_col: str = "Rank") -> DataFrame:
    """Keep the first ``k`` rows of each group in a total order."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = Window.partitionBy(*partition_cols).orderBy(*[_sort_col(c) for c in order_cols])
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= F.lit(int(k))))


def sequence_numbers(df: DataFrame, order_cols: Sequence, partition_cols: Sequence[str] = (),
                     out_col: str = "Seq", num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by partition_cols order by order_cols)``.

    ``order_cols`` (with ``partition_cols``) must be a total order, e.g. end in
    a key column; otherwise numbering among ties is arbitrary.
    """
    keys = [F.col(c) for c in partition_cols] + [_sort_col(c) for c in order_cols]
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              # monotonically_increasing_id = (partition index << 33) + row index
              .withColumn("_li", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
              .checkpoint(eager=True))
    group = list(partition_cols)
    summary = ranged.groupBy("_pid", *group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_li").alias("_first"))
    w = (Window.partitionBy(*group).orderBy("_pid")
         .rowsBetween(Window.unboundedPreceding, -1))
    summary = summary.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if not group:
        # One row per partition: a proven size bound, so broadcast it.
        summary = F.broadcast(summary)
    else:
        # One row per (partition, group).  Materialize it once and broadcast
        # it only when its measured size is under the bound; beyond that the
        # join back stays a shuffle join.
        summary = summary.checkpoint(eager=True)
        if summary.limit(SUMMARY_BROADCAST_ROWS + 1).count() <= SUMMARY_BROADCAST_ROWS:
            summary = F.broadcast(summary)
    s = summary.select(F.col("_pid").alias("_spid"),
                       *[F.col(c).alias(f"_s_{c}") for c in group], "_before", "_first")
    # Null-safe on the group columns: a null group is a group too.
    cond = [F.col("_pid") == F.col("_spid")] + [
        F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group]
    out = ranged.join(s, cond)
    return (out.withColumn(out_col, F.col("_before") + F.col("_li") - F.col("_first") + 1)
            .drop("_pid", "_li", "_spid", "_before", "_first", *[f"_s_{c}" for c in group]))
