"""Joins beside tables of any size."""

import pytest
from pyspark.sql import functions as F

from sievelight.plans import sizing


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limits", [(1000, 1000), (10, 50), (10, 10_000)])
def test_join_groups(spark, how, limits):
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("k"), "id")  # a third has no key
    groups = spark.range(35).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).unionAll(spark.sql("select cast(null as long), 7L"))
    made = sizing.join_groups(rows, groups, ["k"], how, *limits)
    want = rows.alias("r").join(groups.alias("g"), F.expr("r.k <=> g.k"), how).select("r.k", "id", "x")
    assert sorted(map(tuple, made.select("k", "id", "x").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_wide_rows_are_not_small(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"), F.array(F.lit("y")).alias("a"))
    assert sizing.is_small(wide) and not sizing.is_small(wide, bytes_=100_000) and not sizing.is_small(wide, rows=99)
    assert sizing.is_small(wide.limit(0))
