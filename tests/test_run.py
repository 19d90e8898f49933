from __future__ import annotations

import pytest

from muster.operators.compare import same_rows
from muster.plans import run as plans_run
from muster.plans.run import execute, with_partitions
from muster.plans.scratch import scratch_location
from muster.sources.locations import AccessPolicy, Location, scan


def test_stored_result_and_preview(spark, tmp_path):
    df = spark.range(100)
    run = execute(df, results=Location.local(str(tmp_path)), run_id="r1")
    assert run.location == Location.local(str(tmp_path)).child("r1")
    assert same_rows(scan(spark, run.location), df)
    rows = {row.id for row in run.head.collect()}
    assert len(rows) == 10 and rows <= set(range(100))


def test_preview_does_not_run_the_query_again(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    run = execute(spark.range(50).mapInArrow(seen, "id long"), results=Location.local(str(tmp_path)))
    assert len(run.head.collect()) == 10 and len(run.head.collect()) == 10
    assert rows.value == 50


def test_two_runs_agree(spark, tmp_path):
    place = Location.local(str(tmp_path))
    runs = [execute(spark.range(9).selectExpr("id", "id % 2 b"), results=place) for _ in range(2)]
    assert runs[0].location != runs[1].location
    assert same_rows(runs[0].head, runs[1].head)


def test_explicit_sink_has_no_preview(spark, tmp_path):
    place = Location.local(str(tmp_path)).child("out")
    run = execute(spark.range(5), to=place)
    assert run.head is None and scan(spark, place).count() == 5


def test_no_place_for_the_result(spark):
    with pytest.raises(ValueError):
        execute(spark.range(5))


def test_a_run_id_is_used_once_and_stays_below_the_root(spark, tmp_path):
    place = Location.local(str(tmp_path))
    execute(spark.range(5), results=place, run_id="r")
    with pytest.raises(Exception, match="(?i)already exists"):
        execute(spark.range(5), results=place, run_id="r")
    for name in ("../r", "a/b", "", ".", "..", "_r"):
        if name:
            with pytest.raises(ValueError):
                execute(spark.range(5), results=place, run_id=name)


def test_empty_result(spark, tmp_path):
    run = execute(spark.range(0), results=Location.local(str(tmp_path)))
    assert run.head.columns == ["id"] and run.head.isEmpty()


def test_policy(spark, tmp_path):
    place = Location.local(str(tmp_path))
    with pytest.raises(PermissionError):
        execute(spark.range(5), results=place, policy=AccessPolicy(allow_local_sinks=False))
    closed = AccessPolicy(allow_local_scans=False)
    run = execute(spark.range(5), results=place, policy=closed)
    assert run.head.count() == 5
    joined = spark.range(3).join(spark.read.parquet(run.location.uri), "id")
    with pytest.raises(PermissionError):
        execute(joined, results=place, policy=closed)


def test_partition_counts(spark):
    df = spark.range(0, 1000, 1, 3)
    assert with_partitions(df, None) is df
    assert with_partitions(df, 5).rdd.getNumPartitions() == 5
    assert with_partitions(df, 5, workers=3).rdd.getNumPartitions() == 15
    assert with_partitions(df, 5, workers=3, partitions=2).rdd.getNumPartitions() == 2
    assert same_rows(with_partitions(df, 5, workers=3), df)
    with pytest.raises(ValueError):
        with_partitions(df, 0)


def test_workers_of_a_cluster_that_names_no_number(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    df = spark.range(0, 1000, 1, 3)
    assert with_partitions(df, 4).rdd.getNumPartitions() == 4
    monkeypatch.setattr(plans_run, "_executors", lambda spark: 3)
    assert with_partitions(df, 4).rdd.getNumPartitions() == 12
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,1024]")
    assert with_partitions(df, 4).rdd.getNumPartitions() == 12
    assert same_rows(with_partitions(df, 4), df)
    unbounded = {"spark.dynamicAllocation.maxExecutors": str(2**31 - 1)}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, name, default=None: unbounded.get(name, default))
    assert plans_run._workers(spark) == 3


def test_partitions_are_even_whatever_the_rows(spark):
    df = spark.range(0, 9000, 1, 3).selectExpr("1 as k")
    sizes = with_partitions(df, 6).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) - min(sizes) <= 3


def test_scratch(spark):
    first, second = scratch_location(spark, "x"), scratch_location(spark, "x")
    assert first != second and first.is_local
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or root in first.uri
