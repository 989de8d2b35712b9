"""Read one of the 14 declared tables with its fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from circula.functions.common import fitted
from circula.schema import table

CORRUPT = "_corrupt_record"
#: Both directions: quotes are doubled, line ends within quotes belong to the text, no space is cut off.
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Rows of a CSV file that is written at most: files are read whole, by one task each.
FILE_ROWS = 250_000
NO_TEXT = "\0"  # how the reader marks a field of nothing, so that ``""`` stays an empty text


def load_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
               strict: bool = True) -> DataFrame:
    """Read table ``name`` from ``path`` with its declared schema.

    * parquet, ``strict=True``: the declared schema is imposed on the scan
      (column pruning and filter pushdown still apply).
    * parquet, ``strict=False`` (raw feeds): the declared columns that the
      files hold, in their stored types and declared order; absent columns
      stay absent so Q1 can add them with their defaults, and values that do
      not fit their declared type yet are left for the checks to report.
    * csv: columns are taken by the header's names, whatever their order;
      declared columns that the header lacks stay absent (Q1 adds them) and
      other columns are left out.  All files must have the first one's header.
      Records are quoted as RFC 4180 says (a quote in a text is doubled), so
      texts may hold line ends, quotes and commas; an empty text is ``""`` and null is
      nothing.  A file is therefore read by one task, row by row: give large
      feeds as many files, as :func:`write_table` does.  A row
      whose number of fields is wrong, or with a value that does not fit its
      declared type, keeps its raw text in ``_corrupt_record`` (null for good rows).
    """
    spec = table(name)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in spec.schema])
    if fmt == "parquet":
        if strict:
            return spark.read.schema(schema).parquet(path)
        raw = spark.read.parquet(path)
        have = set(raw.columns)
        return raw.select(*[F.col(c) for c, _ in spec.columns if c in have])
    if fmt == "csv":
        return _load_csv(spark, spec, path)
    raise ValueError(f"unsupported format {fmt!r}; use 'parquet' or 'csv'")


def _load_csv(spark: SparkSession, spec, path: str) -> DataFrame:
    header = spark.read.options(**CSV).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType(), True) for c in [*header, CORRUPT]])
    raw = (spark.read.schema(text).options(**CSV).option("nullValue", NO_TEXT).option("mode", "PERMISSIVE")
           .option("enforceSchema", False).option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    have = [(c, kind) for c, kind in spec.columns if c in header]
    misfit = F.lit(False)
    for c, kind in have:
        there = F.col(c).isNotNull() if kind.typeName() == "string" else F.coalesce(F.trim(c), F.lit("")) != ""
        misfit = misfit | (there & fitted(raw, c, kind).isNull())
    line = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in header])
    return raw.select(*[fitted(raw, c, kind).alias(c) for c, kind in have],
                      F.coalesce(F.col(CORRUPT), F.when(misfit, line)).alias(CORRUPT))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a table (parquet, or CSV with a header), optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.options(**CSV).option("dateFormat", "yyyy-MM-dd").option("maxRecordsPerFile", FILE_ROWS).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
