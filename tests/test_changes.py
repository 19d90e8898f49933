from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_scaling import CASES, expected, w

from muster.functions.scaling import added_names
from muster.operators.changes import plan_pool_changes
from muster.operators.timeline import in_ranges


def changes(spark, cases):
    requests, live, given = [], [], []
    for i, (names, amount, low, high, delete, keep, *_) in enumerate(cases):
        requests.append((i, amount, low, high))
        live += [(i, n) for n in names or ()]
        given += [(i, n, "delete") for n in delete or ()] + [(i, n, "keep") for n in keep or ()]
    return plan_pool_changes(
        spark.createDataFrame(requests, "request int, amount long, min long, max long"),
        spark.createDataFrame(live, "request int, name string"),
        spark.createDataFrame(given, "request int, name string, wish string"),
    )


def agree(spark, cases):
    found = changes(spark, cases)
    added, removed = {}, {}
    for row in added_names(found.plans, "request").collect():
        added.setdefault(row.request, set()).add(row.name)
    for row in found.removals.collect():
        removed.setdefault(row.request, []).append(row.name)
    plans = found.plans.collect()
    assert sorted(row.request for row in plans) == list(range(len(cases)))
    for row in plans:
        case = cases[row.request]
        desired, add, remove = expected(case[0] or [], *case[1:6])
        gone = removed.get(row.request, [])
        assert (row.desired, added.get(row.request, set()), set(gone)) == (desired, add, remove), case
        assert len(gone) == len(remove) == row.remove_count
        assert row.available == len(set(case[0] or ()))
        assert row.planned_size == row.available + len(add) - len(remove)
        assert row.problem is None


def test_cases(spark):
    agree(spark, [case for case in CASES if None not in (case[4] or ())])


def test_generated_cases(spark):
    draw = random.Random(11)
    names = [*w(*range(12)), "workerX", "worker-", "worker-1a", "worker-007", "worker-é"]

    def some(limit, extra=()):
        return [draw.choice([*names, *extra]) for _ in range(draw.randrange(limit))]

    agree(
        spark,
        [
            (
                some(9), draw.randrange(10), draw.randrange(4), draw.choice([None, *range(8)]),
                some(5, ["gone"]), some(5, ["gone"]),
            )
            for _ in range(800)
        ],
    )


def test_a_large_pool_is_spread(spark):
    live = spark.range(400_000).select(F.lit(1).alias("request"), F.concat(F.lit("worker-"), F.col("id").cast("string")).alias("name"))
    given = spark.createDataFrame([], "request int, name string, wish string")
    requests = spark.createDataFrame([(1, 150_000, 0, None), (2, 3, 0, None)], "request int, amount long, min long, max long")
    found = plan_pool_changes(requests, live, given)
    wanted = sorted(f"worker-{i}" for i in range(400_000))[:250_000]
    gone = found.removals
    assert gone.count() == gone.distinct().count() == 250_000
    assert gone.agg(F.max("name")).first()[0] == wanted[-1]
    rows = {r.request: (r.add_first, r.add_count, r.remove_count, r.planned_size) for r in found.plans.collect()}
    assert rows == {1: (None, 0, 250_000, 150_000), 2: (0, 3, 0, 3)}
    sizes = [r["count"] for r in in_ranges(live, "request", "name").groupBy("__range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 200_000


def test_a_number_too_large_stops_its_request_only(spark):
    top, beyond, longest = 2**63 - 1, 2**63, 10**60
    cases = [
        (w(top), 2, 0, None, None, None),
        (w(beyond), 2, 0, None, None, None),
        (w(longest), 2, 0, None, None, None),
        (w(top - 1), 2, 0, None, None, None),
        (w(top - 1), 3, 0, None, None, None),
        (w(beyond, 1), 1, 0, None, None, None),
        (["worker-" + "0" * 60 + "7"], 2, 0, None, None, None),
    ]
    found = changes(spark, cases)
    rows = {r.request: (r.problem, r.add_first, r.add_count, r.remove_count) for r in found.plans.collect()}
    large = ("number_too_large", None, 0, 0)
    assert rows == {
        0: large, 1: large, 2: large, 3: (None, top, 1, 0), 4: large, 5: (None, None, 0, 1), 6: (None, 8, 1, 0),
    }
    assert [tuple(r) for r in found.removals.collect()] == [(5, "worker-1")]


def test_hard_rows(spark):
    requests = spark.createDataFrame(
        [(1, 1, 0, None, "a"), (1, 1, 0, None, "b"), (None, 2, 0, None, "c"), (3, None, 0, None, "d"), (4, 0, 0, None, "e")],
        "request int, amount long, min long, max long, name string",
    )
    live = spark.createDataFrame(
        [(1, "worker-0"), (1, "worker-0"), (1, None), (1, "worker-1"), (None, "worker-5"), (3, "worker-2"), (9, "worker-3")],
        "request int, name string",
    )
    given = spark.createDataFrame(
        [(1, "worker-0", None), (1, None, "delete"), (1, "worker-9", "keep"), (3, "worker-2", "delete"), (1, "worker-1", "x")],
        "request int, name string, wish string",
    )
    found = plan_pool_changes(requests, live, given)
    plans = {r.name: (r.desired, r.available, r.add_first, r.add_count, r.remove_count) for r in found.plans.collect()}
    assert plans == {
        "a": (1, 2, None, 0, 1), "b": (1, 2, None, 0, 1), "c": (2, 0, 0, 2, 0), "d": (None, 1, None, 0, 0),
        "e": (0, 0, None, 0, 0),
    }
    assert [tuple(r) for r in found.removals.collect()] == [(1, "worker-0")] * 2
    empty = plan_pool_changes(requests.limit(0), live.limit(0), given.limit(0))
    assert empty.plans.isEmpty() and empty.removals.isEmpty()
    with pytest.raises(ValueError):
        plan_pool_changes(requests.withColumnRenamed("name", "problem"), live, given)
