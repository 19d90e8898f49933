from __future__ import annotations

import random
import re

import pytest

from muster.functions.scaling import added_names, clamp_requests, plan_changes

SCHEMA = (
    "id int, live array<string>, amount long, min long, max long, "
    "workers_to_delete array<string>, workers_to_keep array<string>"
)


def w(*numbers):
    return [f"worker-{n}" for n in numbers]


# live, amount, min, max, delete, keep -> desired, added, removed
CASES = [
    (w(0), 2, 0, None, None, None, 2, w(1), []),
    (w(0, 1), 1, 0, None, w(0), None, 1, [], w(0)),
    (w(0, 1), 1, 0, None, None, w(0), 1, [], w(1)),
    (w(0, 1), 0, 0, None, None, None, 0, [], w(0, 1)),
    (w(1), 2, 0, None, None, None, 2, w(2), []),
    (w(0, 1), 2, 0, None, w(0), None, 2, [], []),
    (w(0, 1, 2), 2, 0, None, ["nope"], None, 2, [], w(0)),
    (w(0, 1, 2), 2, 0, None, w(0, 1), None, 2, [], w(0, 1)),
    (w(0, 1, 2), 2, 0, None, w(2), w(0), 2, [], w(1, 2)),
    ([], 9, 0, 8, None, None, 8, w(*range(8)), []),
    (w(0), 0, 2, 1, None, None, 1, [], []),
    (["worker-a"], 2, 0, None, None, None, 2, w(0), []),
    (None, 1, 0, None, None, None, 1, w(0), []),
    (w(0, 1, 2), 1, 0, None, w(0), w(0), 1, [], w(0, 1, 2)),
    (w(0, 1, 2), 1, 0, None, None, w(0, 1), 1, [], w(2)),
    (w(3, 10), 0, 0, None, None, w(3), 0, [], w(10, 3)),
    (w(0, 1), 1, 0, None, [], [], 1, [], w(0)),
    (w(0, 1), 1, 0, None, [None], [None], 1, [], w(0)),
]


def planned(spark, cases):
    rows = [(i, *case[:6]) for i, case in enumerate(cases)]
    return plan_changes(spark.createDataFrame(rows, SCHEMA))


def test_cases(spark):
    plans = planned(spark, CASES)
    added = {}
    for row in added_names(plans, "id").collect():
        added.setdefault(row.id, []).append(row.name)
    for row in plans.collect():
        live, *_, desired, add, remove = CASES[row.id]
        assert row.desired == desired, row
        assert sorted(added.get(row.id, [])) == sorted(add), row
        assert row.add_count == len(add), row
        assert row.remove == sorted(remove), row
        assert row.available == len(live or []), row
        assert row.planned_size == len(live or []) + len(add) - len(remove), row


def expected(live, amount, low, high, delete, keep):
    """The five rules, in plain words of Python."""
    desired = max(low, amount)
    if high is not None:
        desired = min(high, desired)
    pool = set(live)
    delete, keep = set(delete or ()) & pool, set(keep or ()) & pool
    missing = desired - len(pool)
    if missing > 0:
        numbers = [int(m[1]) for m in (re.fullmatch("worker-([0-9]+)", n) for n in pool) if m]
        first = max(numbers, default=-1) + 1
        return desired, {f"worker-{first + i}" for i in range(missing)}, set()
    if missing == 0:
        return desired, set(), set()
    if desired == 0:
        return desired, set(), pool
    if not delete and not keep:
        return desired, set(), set(sorted(pool)[:-missing])
    return desired, set(), delete | (pool - delete - keep if keep else set())


def test_generated_cases(spark):
    draw = random.Random(7)
    names = [*w(*range(12)), "workerX", "worker-", "worker-1a", "worker-007"]

    def some(limit, extra=()):
        return draw.sample([*names, *extra], draw.randrange(limit))

    cases = [
        (
            some(9),
            draw.randrange(10),
            draw.randrange(4),
            draw.choice([None, *range(8)]),
            draw.choice([None, some(5, ["gone"])]),
            draw.choice([None, some(5, ["gone"])]),
        )
        for _ in range(1500)
    ]
    plans = planned(spark, cases)
    added = {}
    for row in added_names(plans, "id").collect():
        added.setdefault(row.id, set()).add(row.name)
    for row in plans.collect():
        desired, add, remove = expected(*cases[row.id])
        found = (row.desired, added.get(row.id, set()), set(row.remove))
        assert found == (desired, add, remove), cases[row.id]
        assert len(row.remove) == len(remove)


def test_columns_are_not_overwritten(spark):
    df = spark.createDataFrame([(1, 0, 2, 3)], "amount long, min long, max long, desired long")
    with pytest.raises(ValueError):
        clamp_requests(df)
    with pytest.raises(ValueError):
        plan_changes(df)


def test_number_beyond_64_bits(spark):
    top = w(2**63 - 1)
    with pytest.raises(Exception, match="no successor in 64 bits"):
        planned(spark, [(top, 2, 0, None, None, None)]).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        planned(spark, [(["worker-9223372036854775808"], 2, 0, None, None, None)]).collect()


def test_no_amount_changes_nothing(spark):
    row = planned(spark, [(w(0, 1), None, 0, None, ["worker-0"], None)]).first()
    assert (row.desired, row.add_first, row.add_count, row.remove) == (None, None, 0, [])
    assert row.planned_size == 2


def test_live_names_are_a_set(spark):
    row = planned(spark, [(["worker-0", "worker-0", None], 1, 0, None, None, None)]).first()
    assert (row.available, row.remove, row.planned_size) == (1, [], 1)


def test_request_for_very_many(spark):
    plans = planned(spark, [(w(4), 200_001, 0, None, None, None)])
    names = added_names(plans, "id")
    assert names.count() == names.distinct().count() == 200_000
    assert names.where("name in ('worker-5', 'worker-200004')").count() == 2


def test_no_python_and_no_shuffle(spark):
    plan = planned(spark, CASES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(
    ("amount", "low", "high", "desired", "changed"),
    [
        (3, 0, None, 3, False),
        (3, 5, None, 5, True),
        (9, 0, 8, 8, True),
        (0, 2, 1, 1, True),
        (1, 2, 1, 1, False),
    ],
)
def test_clamp(spark, amount, low, high, desired, changed):
    df = spark.createDataFrame([(amount, low, high)], "amount long, min long, max long")
    row = clamp_requests(df).first()
    assert (row.desired, row.changed) == (desired, changed)
