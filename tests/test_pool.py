from __future__ import annotations

import pytest

from muster.operators.pool import live_names, next_worker_number, scaling_status

RECORDS = [
    ("c1", "worker-0", "ALIVE", 11),
    ("c1", "worker-1", "RESTARTING", None),
    ("c1", "worker-1", "ALIVE", 21),
    ("c1", "worker-7", "DEAD", 12),
    ("c1", "workerX", "ALIVE", 13),
    ("c1", "scheduler", "ALIVE", 14),
    ("c1", None, "ALIVE", 15),
    ("c2", "worker-4", "ALIVE", 16),
    ("c4", "worker-9", "ALIVE", 17),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "cluster_id string, name string, state string, pid long")


@pytest.fixture(scope="module")
def pools(spark):
    rows = [("c1", 1, 0, 8), ("c2", 1, 0, None), ("c3", 2, 1, 3)]
    return spark.createDataFrame(rows, "cluster_id string, desired long, min long, max long")


def test_live_names(records):
    assert sorted(map(tuple, live_names(records).collect())) == [
        ("c1", "worker-0"),
        ("c1", "worker-1"),
        ("c1", "workerX"),
        ("c2", "worker-4"),
        ("c4", "worker-9"),
    ]
    assert [tuple(r) for r in live_names(records, "sched").collect()] == [("c1", "scheduler")]


def test_next_number(pools, records):
    found = {tuple(r) for r in next_worker_number(pools, records).collect()}
    assert found == {("c1", 2), ("c2", 5), ("c3", 0)}


def test_lower_gaps_are_not_filled_and_odd_names_have_no_number(spark, pools):
    rows = [(n, "c1", "ALIVE") for n in ("worker-1", "worker-007", "worker-9x", "worker--3")]
    records = spark.createDataFrame(rows, "name string, cluster_id string, state string")
    assert next_worker_number(pools.where("cluster_id = 'c1'"), records).first().next_number == 8


def test_status(pools, records):
    assert {tuple(r) for r in scaling_status(pools, records).collect()} == {
        ("c1", 3, 1, 0, 8),
        ("c2", 1, 1, 0, None),
        ("c3", 0, 2, 1, 3),
    }


def test_names_are_counted_without_collecting(pools, records):
    plan = scaling_status(pools, records)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "partial_count" in plan
