from __future__ import annotations

import math

import pytest
from conftest import final_plan
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muster.operators.compare import same_rows
from muster.operators.windows import with_max_over


def test_values_of_the_query(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (3, 5)], "a long, b long")
    rows = with_max_over(df, "a", ["b"], "c").collect()
    assert sorted(map(tuple, rows)) == [(1, 4, 2), (2, 4, 2), (3, 5, 3)]


def test_types_are_inferred_as_long(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (3, 5)], ["a", "b"])
    assert with_max_over(df, "a", ["b"], "c").dtypes == [
        ("a", "bigint"),
        ("b", "bigint"),
        ("c", "bigint"),
    ]


def test_nulls(spark):
    rows = [(1, None), (None, None), (5, None), (None, 7), (None, 7), (3, 8)]
    df = spark.createDataFrame(rows, "a long, b long")
    found = with_max_over(df, "a", ["b"], "c").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(
        map(
            str,
            [(1, None, 5), (None, None, 5), (5, None, 5), (None, 7, None), (None, 7, None)]
            + [(3, 8, 3)],
        )
    )


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(1.0, 1), (math.nan, 1)], "a double, b int")
    assert all(math.isnan(row.c) for row in with_max_over(df, "a", ["b"], "c").collect())


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert with_max_over(df, "a", ["b"], "c").columns == ["a", "b", "c"]
    assert with_max_over(df, "a", ["b"], "c").isEmpty()


def test_existing_column_is_replaced_in_place(spark):
    df = spark.createDataFrame([(1, 4, 0), (2, 4, 0)], "a long, c long, z long")
    found = with_max_over(df, "a", ["c"], "z")
    assert found.columns == ["a", "c", "z"]
    assert sorted(map(tuple, found.collect())) == [(1, 4, 2), (2, 4, 2)]
    assert sorted(map(tuple, with_max_over(df, "a", ["c"], "a").collect())) == [(2, 4, 0)] * 2


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, 4), (2, 4)], "`a.x` long, `b.y` long")
    found = with_max_over(df, "a.x", ["b.y"], "c.z")
    assert found.columns == ["a.x", "b.y", "c.z"]
    assert sorted(map(tuple, found.collect())) == [(1, 4, 2), (2, 4, 2)]


def test_needs_a_key(spark):
    with pytest.raises(ValueError):
        with_max_over(spark.range(1), "id", [], "c")


@pytest.mark.parametrize("keys", [["k"], ["k", "f"]])
def test_same_as_a_window(spark, keys):
    key = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, -1)
    df = spark.range(20_000).select(
        "id",
        key.otherwise(F.col("id") % 700).alias("k"),
        F.when(F.col("id") % 5 == 0, math.nan).otherwise(-0.0).alias("f"),
        F.when(F.col("id") % 7 != 0, F.xxhash64("id")).alias("v"),
    )
    window = df.withColumn("m", F.max("v").over(Window.partitionBy(*keys)))
    assert same_rows(with_max_over(df, "v", keys, "m"), window)


def test_small_maxima_are_broadcast_and_scans_pruned(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    found = with_max_over(
        orders.select("o_orderkey", "o_custkey", "o_totalprice"),
        "o_totalprice",
        ["o_custkey"],
        "m",
    )
    plan = final_plan(found)
    assert "BroadcastHashJoin" in plan and "Window" not in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_filter_on_the_key_reaches_both_scans(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    found = with_max_over(orders, "o_totalprice", ["o_custkey"], "m").where("o_custkey = 7")
    assert found.count() == orders.where("o_custkey = 7").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(o_custkey") >= 1
    assert "Window" not in plan


def test_hot_key_is_split(spark, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
        spark__sql__shuffle__partitions="16",
    )
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
    df = spark.range(0, 200_000, 1, 16).select(key.alias("k"), F.xxhash64("id").alias("v"))
    found = with_max_over(df, "v", ["k"], "m")
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    hot = df.where("k = -1").agg(F.max("v")).first()[0]
    assert found.where("k = -1").agg(F.min("m"), F.max("m"), F.count("*")).first() == (
        hot,
        hot,
        66_667,
    )
    assert found.count() == 200_000
