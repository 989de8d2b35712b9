"""Store any result as a report: a Report row and its rows in JSON parts.

The rows are numbered without one global sort partition (Q11's numbering) and
stored in parts of ``PART_ROWS`` rows, one JSON text per part, under
``<path>_parts/report=<id>``.  The Report row's Content is a small JSON
manifest: number of rows and of parts, and the place of the parts.  A result
of any size takes the same path, and no task holds more than one part.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.functions.common import as_date
from circula.operators.ranking import sequence_numbers
from circula.sources.paths import path_exists

PART_ROWS = 1000


def write_report(df: DataFrame, report_type: str, generated_by: int | None, as_of, path: str,
                 part_rows: int = PART_ROWS) -> DataFrame:
    """Append a Report row to the report table at ``path``, store the rows of
    ``df`` beside it, and return the row.

    Rows are in the order of their columns, so the parts are the same on
    every run.  ReportID continues the table's AUTO_INCREMENT.  The parts are
    written first: a Report row never names parts that are not whole.
    """
    spark = df.sparkSession
    next_id = 1
    if path_exists(spark, path):
        next_id = (spark.read.parquet(path).agg(F.max("ReportID")).first()[0] or 0) + 1
    place = f"{path.rstrip('/')}_parts/report={next_id}"
    numbered = sequence_numbers(df, [F.col(c) for c in df.columns], out_col="_row")
    part = F.floor((F.col("_row") - 1) / F.lit(part_rows)).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("_row", *df.columns)))
    parts = (numbered.groupBy(part.alias("Part")).agg(rows.alias("_rows"))
             .select("Part", F.size("_rows").cast("bigint").alias("RowCount"),
                     F.to_json(F.transform("_rows", lambda r: r.dropFields("_row"))).alias("Content")))
    parts.write.mode("overwrite").parquet(place)
    total = spark.read.parquet(place).agg(F.count(F.lit(1)), F.coalesce(F.sum("RowCount"), F.lit(0))).first()
    manifest = json.dumps({"rows": total[1], "parts": total[0], "place": place})
    row = spark.range(1).select(
        F.lit(next_id).cast("int").alias("ReportID"),
        F.lit(generated_by).cast("int").alias("GeneratedBy"),
        as_date(as_of).alias("GenerationDate"),
        F.lit(report_type).alias("Type"),
        F.lit(manifest).alias("Content"))
    row.write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("ReportID") == next_id)


def read_report_rows(spark, path: str, report_id: int, row_schema: str) -> DataFrame:
    """Decode one stored report's parts back into rows of ``row_schema``."""
    content = spark.read.parquet(path).filter(F.col("ReportID") == F.lit(report_id)).first()["Content"]
    parts = spark.read.schema("Part bigint, RowCount bigint, Content string").parquet(json.loads(content)["place"])
    decoded = parts.select(F.explode(F.from_json("Content", f"array<struct<{row_schema}>>")).alias("r"))
    return decoded.select("r.*")
