from __future__ import annotations

import datetime
import random

import pytest

from muster.operators.timeline import live_changes, live_counts_at

LOG = "cluster_id string, name string, state string, ts timestamp, place long"
START = datetime.datetime(2026, 1, 1)


def at(minute):
    return None if minute is None else START + datetime.timedelta(minutes=minute)


def counted(records, cluster, minute):
    """The live workers of a pool at a time, by its whole log."""
    last = {}
    for c, name, state, when, place in sorted(records, key=lambda r: (r[3] is None, r[3] or 0, r[4])):
        if c == cluster and name is not None and name.startswith("worker") and when is not None and when <= minute:
            last[name] = state != "DEAD"
    return sum(last.values())


def frames(spark, records, asked):
    log = spark.createDataFrame([(c, n, s, at(t), p) for c, n, s, t, p in records], LOG)
    requests = spark.createDataFrame([(i, c, at(t)) for i, c, t in asked], "id long, cluster_id string, ts timestamp")
    return requests, log


def found(spark, records, asked):
    rows = live_counts_at(*frames(spark, records, asked)).collect()
    return sorted((r.id, r.available if r.ts is not None else "none") for r in rows)


def test_worker_that_died_is_gone_from_then_on(spark):
    records = [("a", "worker-0", "ALIVE", 0, 0), ("a", "worker-0", "DEAD", 5, 1), ("a", "worker-0", None, 9, 2)]
    asked = [(i, "a", t) for i, t in enumerate([-1, 0, 4, 5, 8, 9, 99])]
    assert found(spark, records, asked) == list(enumerate([0, 1, 1, 0, 0, 1, 1]))


def test_odd_rows(spark):
    records = [
        ("a", None, "ALIVE", 0, 0), ("a", "scheduler", "ALIVE", 0, 1), ("a", "workerX", "ALIVE", 0, 2),
        ("a", "worker-1", "ALIVE", None, 3), (None, "worker-1", "ALIVE", 0, 4), ("a", "workerX", "ALIVE", 1, 5),
    ]
    asked = [(0, "a", 2), (0, "a", 2), (1, None, 2), (2, "b", 2), (3, "a", None)]
    assert found(spark, records, asked) == [(0, 1), (0, 1), (1, 1), (2, 0), (3, "none")]
    assert found(spark, [], asked[:1]) == [(0, 0)]
    assert found(spark, records, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_generated_logs(spark, seed):
    draw = random.Random(seed)
    records = [
        # a third of the rows in one pool, and most of these about one worker
        (
            "busy" if i % 3 == 0 else f"c{draw.randrange(9)}",
            f"worker-{0 if draw.random() < 0.6 else draw.randrange(7)}",
            draw.choice(["ALIVE", "RESTARTING", "DEAD", "DEAD", None]),
            draw.randrange(60),
            i,
        )
        for i in range(1500)
    ]
    asked = [(i, draw.choice(["busy", "c1", "c2", "none"]), draw.randrange(-2, 70)) for i in range(200)]
    assert found(spark, records, asked) == [(i, counted(records, c, t)) for i, c, t in asked]


def test_frequent_pool_is_spread(spark, settings):
    settings(spark__sql__shuffle__partitions="16")
    draw = random.Random(3)
    records = [("busy", f"worker-{i % 40}", draw.choice(["ALIVE", "DEAD"]), i % 500, i) for i in range(4000)]
    requests, log = frames(spark, records, [(i, "busy", 7) for i in range(3000)])
    rows = live_counts_at(requests, log)
    assert rows.where("available is null").isEmpty()
    assert {r.available for r in rows.select("available").distinct().collect()} == {counted(records, "busy", 7)}
    assert live_changes(log).count() < 4000
