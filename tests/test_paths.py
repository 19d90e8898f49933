from __future__ import annotations

import random
from pathlib import PurePosixPath

import pytest
from conftest import final_plan
from pyspark.sql import functions as F

from muster.operators.paths import covering_paths, in_cover_order


def cover(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return [row.path for row in in_cover_order(covering_paths(df)).collect()]


@pytest.mark.parametrize(
    ("paths", "kept"),
    [
        (["/a", "/a/b", "/a/b/c", "/ab", "/x/y", "/x/yz", "/x/y/z/w"], ["/a", "/ab", "/x/y", "/x/yz"]),
        (["/", "/a"], ["/"]),
        (["/"], ["/"]),
        (["/a/b", "/a/b", None], ["/a/b"]),
        (["/a-/b", "/a/z", "/q"], ["/q", "/a/z", "/a-/b"]),
        ([], []),
    ],
)
def test_cases(spark, paths, kept):
    assert cover(spark, paths) == kept


def test_against_every_pair(spark):
    draw = random.Random(3)
    for _ in range(4):
        paths = {
            "/" + "/".join(draw.choice(["a", "b", "a-", "ab", "é"]) for _ in range(draw.randrange(1, 7)))
            for _ in range(draw.choice([3, 40, 300]))
        }
        known = {PurePosixPath(p) for p in paths}
        kept = [p for p in known if not any(above in known for above in p.parents)]
        kept.sort(key=lambda p: (len(p.parts), p))
        assert cover(spark, paths) == [str(p) for p in kept]


def test_depth_counts_the_root(spark):
    df = spark.createDataFrame([("/a/b",), ("/c",)], "path string")
    assert {tuple(r) for r in covering_paths(df).collect()} == {("/a/b", 3), ("/c", 2)}


def test_other_column_name(spark):
    df = spark.createDataFrame([("/a", 1), ("/a/b", 2)], "mount string, x int")
    assert [tuple(r) for r in covering_paths(df, "mount").collect()] == [("/a", 2)]


def tight(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
        spark__sql__shuffle__partitions="16",
    )


def test_hot_ancestor_is_split(spark, settings):
    tight(settings)
    number = F.col("id").cast("string")
    hot = F.concat(F.lit("/hot/d"), number, F.lit("/f"))
    other = F.concat(F.lit("/x"), number, F.lit("/y"))
    paths = spark.range(0, 120_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, hot).otherwise(other).alias("path")
    )
    found = covering_paths(paths.union(spark.sql("select '/hot'")))
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    assert found.count() == 80_001


def test_hot_folder_is_split(spark, settings):
    tight(settings)
    number = F.col("id").cast("string")
    hot = F.concat(F.lit("/hot/f"), number)
    other = F.concat(F.lit("/x"), number, F.lit("/y"))
    paths = spark.range(0, 120_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, hot).otherwise(other).alias("path")
    )
    found = covering_paths(paths.union(spark.sql("select '/x1'")))
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    assert found.count() == 120_000  # /x1 takes the place of /x1/y
