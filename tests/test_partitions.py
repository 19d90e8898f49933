from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from muster.operators.compare import same_rows
from muster.plans.partitions import shuffled_into
from muster.plans.run import execute
from muster.sources.locations import Location, scan


def by_key(spark):
    return spark.range(10_000).groupBy((F.col("id") % 500).alias("k")).agg(F.count("*").alias("n"))


def stored_partitions(spark, place, partitions):
    df = by_key(spark).withColumn("part", F.spark_partition_id())
    run = execute(df, results=place, partitions=partitions)
    stored = scan(spark, run.location)
    assert same_rows(stored.drop("part"), by_key(spark))
    return stored.select("part").distinct().count()


def test_a_run_has_the_partitions_asked_for(spark, tmp_path):
    place = Location.local(str(tmp_path))
    assert stored_partitions(spark, place, 13) == 13
    assert stored_partitions(spark, place, 1) == 1
    assert stored_partitions(spark, place, None) < 13


def test_no_shuffle_is_added(spark):
    with shuffled_into(spark, 13):
        inside = by_key(spark)._jdf.queryExecution().executedPlan().toString()
        scanned = spark.range(10)._jdf.queryExecution().executedPlan().toString()
    assert inside.count("Exchange") == 1 and "13" in inside.split("Exchange", 1)[1].split("\n", 1)[0]
    assert "Exchange" not in scanned


def test_settings_are_put_back(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(name, None) for name in names]
    with pytest.raises(RuntimeError), shuffled_into(spark, 5):
        assert spark.conf.get(names[0]) == "5"
        raise RuntimeError
    assert [spark.conf.get(name, None) for name in names] == before
    for count in (0, -1):
        with pytest.raises(ValueError), shuffled_into(spark, count):
            pass
    assert [spark.conf.get(name, None) for name in names] == before
