"""Reading input tables and keeping intermediate ones.

Intermediate tables are Parquet files in the shared folder that
``spark.checkpoint.dir`` names, so a lost executor loses none of them and a
recomputed task reads the same rows again.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from circula.sources.paths import _fs, scratch_dir

_LEFT: dict[str, SparkSession] = {}


#: Rows that Python workers get at once: texts can be long, and some operators return them too.
BATCH_ROWS = 2000


def importable(spark: SparkSession) -> None:
    """Prepare the session for Python workers: batches of BATCH_ROWS rows at
    most, and in a local session the path of this package, whatever folder it was
    started in (on a cluster it is sent with --py-files)."""
    at_most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if at_most <= 0 or at_most > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if sc.master.startswith("local["):
        sc.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has."""
    while name in columns:
        name += "_"
    return name


def extended(schema: StructType, ddl: str) -> StructType:
    """A new schema: the fields given and those of ``ddl``."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def together(texts: pa.Array, chars: int) -> Iterator[list]:
    """The texts in order, in lists of about ``chars`` characters (bytes of binary texts), or of one longer text."""
    some, n = [], 0
    for text in texts:
        some.append(text.as_py())
        n += len(some[-1] or ())
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


class Staging:
    """Tables that one operator call writes and reads again.

    ``keep`` writes a DataFrame and returns it as read back; ``drop`` deletes
    a table that no later step reads.  What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch_dir(spark, label)
        if not _LEFT:
            atexit.register(_clear)
        _LEFT[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        # shuffle files go when Java forgets the plans that made them
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = _fs(self.spark, self.path(name))
            fs.delete(p, True)


def _clear() -> None:
    for root, spark in _LEFT.items():
        with contextlib.suppress(Exception):  # the session may have ended already
            fs, p = _fs(spark, root)
            fs.delete(p, True)
