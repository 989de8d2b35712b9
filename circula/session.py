"""Spark session settings used by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# As-of date of all fixture runs (FIXTURES.md).
AS_OF = "2001-07-26"


def build_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "circula") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    shuffle_partitions = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoints that no DataFrame reads any more are removed
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("CIRCULA_DRIVER_MEMORY", _default_heap()))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _default_heap() -> str:
    """Local mode runs everything in the driver JVM: give it about 60% of the
    machine's memory, between 2 and 16 GiB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    gib = int(total * 0.6 / 2**30)
    return f"{max(2, min(16, gib))}g"


def cluster_settings(input_bytes: int, executor_cores_total: int,
                     target_partition_bytes: int = 256 * 2**20) -> dict[str, str]:
    """Settings for a large cluster, sized from the bytes the jobs read.

    Shuffle partitions are chosen so one partition is about
    ``target_partition_bytes`` (spill-free sort / aggregation buffers) and
    never fewer than two waves of tasks; AQE then coalesces small ones and
    splits skewed ones at run time.
    """
    parts = max(2 * executor_cores_total, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.session.timeZone": "UTC",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and is
    used as is.  Only a local test session with no setting gets a scratch
    folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="circula-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf
