"""Connected components of a graph given by its edges, on Spark.

Alternating large-star and small-star steps: every node sends its larger (then
its smaller) neighbours to the smallest node near it, until nothing changes.
Each step is an aggregate (combined before the shuffle) and a join, on
tables in the shared folder; a hub's edges are many rows of a join that AQE
can split, never one group.  The number of steps grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import Staging


def components(edges: DataFrame, stage: Staging, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (columns a and b, long);
    the component is its smallest node.  No edges give no rows; loops, repeated
    edges and either direction are fine."""
    now = stage.keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{name}_0")
    step, size = 0, _size(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage.keep(both.groupBy("a").agg(F.min("b").alias("m"))
                           .select(F.col("a").alias("u"), F.least("a", "m").alias("m")), f"{name}_{step}_large")
        large = stage.keep(both.where("b > a").join(least, F.col("a") == F.col("u"))
                           .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(),
                           f"{name}_{step}_mid")
        least2 = stage.keep(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"),
                            f"{name}_{step}_small")
        joined = large.join(least2, F.col("a") == F.col("u"))
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        now = stage.keep(new, f"{name}_{step}")
        stage.drop(f"{name}_{step - 1}", f"{name}_{step - 1}_large", f"{name}_{step - 1}_mid",
                   f"{name}_{step - 1}_small")
        old, size = size, _size(now)
        if old == size:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _size(edges: DataFrame) -> tuple:
    """Number and sums of a set of edges: equal for two steps only if nothing changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
