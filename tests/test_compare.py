from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from muster.operators.compare import (
    bag_difference,
    bag_difference_by_digest,
    bag_digests,
    differing_buckets,
    same_rows,
)

ROWS = [(1, "a"), (1, "a"), (2, None), (None, "b")]


def test_order_does_not_matter(spark):
    left = spark.createDataFrame(ROWS, "x long, y string")
    assert same_rows(left, spark.createDataFrame(ROWS[::-1], "x long, y string"))


def test_copies_count(spark):
    left = spark.createDataFrame(ROWS, "x long, y string")
    right = spark.createDataFrame([*ROWS[1:], (3, "c")], "x long, y string")
    found = bag_difference(left, right).collect()
    assert sorted(map(tuple, found)) == [(1, "a", 2, 1), (3, "c", 0, 1)]
    assert not same_rows(left, right)


def test_nan_and_zero(spark):
    left = spark.createDataFrame([(math.nan,), (0.0,)], "x double")
    right = spark.createDataFrame([(-0.0,), (math.nan,)], "x double")
    assert same_rows(left, right)


def test_nested_and_map_columns(spark):
    df = spark.range(50).select(
        F.create_map(F.lit("k"), "id").alias("m"), F.array("id").alias("a"), F.struct("id").alias("s")
    )
    assert same_rows(df, df.repartition(3))
    assert bag_difference(df, df.unionAll(df.limit(1))).count() == 1


@pytest.mark.parametrize("schema", ["x int, y string", "y long, x string", "x long, z string"])
def test_names_types_and_order_are_strict(spark, schema):
    left = spark.createDataFrame([], "x long, y string")
    right = spark.createDataFrame([], schema)
    assert not same_rows(left, right)
    with pytest.raises(ValueError):
        bag_difference(left, right)


def test_dotted_names(spark):
    df = spark.range(3).withColumnRenamed("id", "a.b")
    assert same_rows(df, df)


def test_count_columns_are_not_overwritten(spark):
    df = spark.range(1).withColumnRenamed("id", "left_count")
    with pytest.raises(ValueError):
        bag_difference(df, df)


def test_one_shuffle(spark):
    df = spark.range(10)
    plan = bag_difference(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_digests_find_what_counting_finds(spark):
    left = spark.range(2000).select((F.col("id") % 700).alias("x"), F.col("id").cast("string").alias("y"))
    right = left.where("y not in ('3', '4')").unionAll(left.where("y = '9'")).repartition(5)
    found = bag_difference_by_digest(left, right)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bag_difference(left, right).collect()))
    assert found.count() == 3
    assert len(differing_buckets(left, right)) <= 3
    assert differing_buckets(left, left.orderBy("y")) == []
    assert bag_difference_by_digest(left, left).count() == 0
    assert len(differing_buckets(left, left.limit(0))) == len(differing_buckets(left.limit(0), left)) > 500


@pytest.mark.parametrize(
    "kind, values",
    [
        ("array<int>", [[], [None], [0], [None, 0], [0, None], [0, 0], None]),
        ("array<array<int>>", [[], [[]], [[0]], [[], []], [[0, 0]], [[0], [0]], [[], [], []], [None], None]),
        ("struct<a: int, b: int>", [None, (None, None), (1, None), (None, 1), (0, 0)]),
        ("string", ["", None, "a", "A"]),
        ("double", [0.0, None, math.nan, 1.0]),
    ],
)
def test_values_that_hash_alike_are_told_apart(spark, kind, values):
    frames = [spark.createDataFrame([(v, 1), (v, 1)], f"v {kind}, n int") for v in values]
    digests = {tuple(map(str, bag_digests(df, 1).first())) for df in frames}
    assert len(digests) == len(values)


def test_digests_of_nulls_in_columns_and_copies(spark):
    left = spark.createDataFrame([(1, None), (None, 2), (-1, 3), (-1, 3)], "x int, y int")
    right = spark.createDataFrame([(None, 1), (2, None), (-1, 3), (-1, 3)], "x int, y int")
    assert differing_buckets(left, right)
    assert bag_difference_by_digest(left, right).count() == 4
    zero = spark.createDataFrame([(-0.0,), (math.nan,)], "a double").withColumnRenamed("a", "a.b")
    same = spark.createDataFrame([(math.nan,), (0.0,)], "a double").withColumnRenamed("a", "a.b")
    assert differing_buckets(zero, same) == []


def test_maps_have_no_digest_and_columns_have_to_agree(spark):
    df = spark.range(2).select(F.create_map(F.lit("k"), "id").alias("m"))
    with pytest.raises(ValueError, match="no digest"):
        bag_digests(df)
    with pytest.raises(ValueError):
        bag_difference_by_digest(spark.range(2), spark.range(2).withColumnRenamed("id", "x"))
