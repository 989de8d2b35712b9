"""A gram index of titles, for catalogue searches with a leading wildcard.

A posting (gram, ISBN) says that the lower-case title has these ``GRAM``
characters in a row.  Postings are stored by bucket (a hash of the gram) and sorted by gram, so a
search reads the buckets of its grams, and of those the row groups that hold them.  ``grams`` has the
number of postings of each gram.  A LIKE pattern's literal runs give grams that every match has; the titles of the
rarest ones' postings are candidates, and ``browse_catalog`` verifies those against the pattern, so the
result is that of a full scan.

New and changed titles are added by :func:`add_titles`, as a batch of postings; postings of titles that were changed or deleted do no
harm, as candidates are verified.  A half-written batch has no ``_SUCCESS`` mark and is not read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.sources.paths import list_dirs, path_exists

GRAM = 3
BUCKETS = 64
POSTINGS, COUNTS = "gram string, ISBN string, bucket int", "gram string, n bigint"
RAREST = 3               # grams whose postings a search intersects
BROADCAST_ROWS = 100_000  # candidates that are sent to the scan of the books; more are joined by a shuffle


@dataclass(frozen=True)
class TitleIndex:
    spark: SparkSession
    path: str

    def batches(self, kind: str) -> list[str]:
        root = f"{self.path}/{kind}"
        return [f"{root}/{d}" for d in list_dirs(self.spark, root) if path_exists(self.spark, f"{root}/{d}/_SUCCESS")]

    def candidates(self, pattern: str) -> DataFrame | None:
        """ISBNs of the titles that may match the LIKE pattern; None if the pattern has no ``GRAM`` literal characters in a row."""
        grams = pattern_grams(pattern)
        if not grams:
            return None
        none = self.spark.createDataFrame([], "ISBN string")
        stored = self.batches("postings")
        if not stored:
            return none
        counts = dict(self.spark.read.schema(COUNTS).parquet(*self.batches("grams")).filter(F.col("gram").isin(grams))
                      .groupBy("gram").agg(F.sum("n")).collect())  # no more rows than the pattern has characters
        if len(counts) < len(grams):
            return none  # a gram that no title has
        rare = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        buckets = [r.b for r in self.spark.createDataFrame([(g,) for g in rare], "gram string")
                   .select(_bucket().alias("b")).distinct().collect()]
        parts = [self.spark.read.schema(POSTINGS).parquet(p) for p in stored]
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        hits = hits.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(rare)).select("ISBN", "gram").distinct()
        if len(rare) == 1:
            return hits.select("ISBN")
        return hits.groupBy("ISBN").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("ISBN")


def _bucket():
    return F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")


def pattern_grams(pattern: str) -> list[str]:
    """Grams of the literal runs of a LIKE pattern (``%`` and ``_`` are wildcards, a backslash escapes)."""
    runs, run = [], ""
    for part in re.findall(r"\\.|.", pattern, re.S):
        if part in ("%", "_"):
            runs.append(run)
            run = ""
        else:
            run += part[-1]
    low = [r.lower() for r in [*runs, run]]
    return sorted({r[i:i + GRAM] for r in low for i in range(len(r) - GRAM + 1)})


def add_titles(books: DataFrame, path: str) -> TitleIndex:
    """Add the postings of ``books`` (ISBN, Title) as a batch to the index at ``path``, which need not be there yet.  Null titles match no pattern."""
    path = path.rstrip("/")
    batch = uuid.uuid4().hex[:12]
    low = F.lower("Title")
    starts = F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1))
    grams = F.when(F.char_length(low) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))))
    rows = books.filter(F.col("ISBN").isNotNull()).select("ISBN", F.explode(grams).alias("gram")).distinct()
    # a common gram's postings are split by ISBN, so no task has all of them
    spread = rows.withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64("ISBN"), F.lit(8)))
    (spread.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings/{batch}"))
    spark = books.sparkSession
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings/{batch}")
    stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/grams/{batch}")
    return TitleIndex(spark, path)
