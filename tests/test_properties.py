"""Property tests: the skew-safe numbering equals a plain row_number for any
grouping."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from circula.operators.ranking import sequence_numbers

rows = st.lists(st.tuples(st.sampled_from(["hot", "a", "b", None]), st.integers(0, 30)), min_size=1, max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 7))
def test_sequence_numbers_equal_row_number(spark, data, parts):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v int, id int")
    got = sequence_numbers(df, ["v", "id"], ["g"], "n", num_partitions=parts)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("bigint"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 7))
def test_global_numbering_is_a_permutation_in_order(spark, data, parts):
    df = spark.createDataFrame([(v, i) for i, (_, v) in enumerate(data)], "v int, id int")
    got = sorted((r.v, r.id, r.n) for r in sequence_numbers(df, ["v", "id"], [], "n", num_partitions=parts).collect())
    assert [n for _, _, n in got] == list(range(1, len(data) + 1))
