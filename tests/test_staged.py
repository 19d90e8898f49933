from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from muster.plans.staged import run_staged
from muster.sources.locations import AccessPolicy, Location

ROOT = Path(__file__).resolve().parent.parent


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now


@pytest.fixture
def place(tmp_path):
    return Location.local(str(tmp_path))


def stages(calls, fail_in=None, clock=None, seconds=0.0):
    def stage(name, make):
        def run(spark, previous):
            calls.append(name)
            if name == fail_in:
                raise RuntimeError("stage failed")
            if clock is not None:
                clock.now += seconds
            return make(spark, previous)

        return name, run

    return [
        stage("numbers", lambda spark, _: spark.range(100)),
        stage("squares", lambda spark, df: df.select((F.col("id") * F.col("id")).alias("x"))),
        stage("total", lambda spark, df: df.agg(F.sum("x").alias("total"))),
    ]


def test_runs_through(spark, place):
    calls = []
    run = run_staged(spark, stages(calls), run_id="r", checkpoints=place, period_seconds=0)
    assert run.result.first().total == 328350
    assert calls == list(run.computed) == list(run.checkpointed) == ["numbers", "squares", "total"]
    assert run.resumed_from is None


def test_resumes_after_a_failure(spark, place):
    calls = []
    with pytest.raises(RuntimeError):
        run_staged(
            spark, stages(calls, "squares"), run_id="r", checkpoints=place, period_seconds=0
        )
    again = []
    run = run_staged(spark, stages(again), run_id="r", checkpoints=place, period_seconds=0)
    assert again == ["squares", "total"] and run.resumed_from == "numbers"
    assert run.result.first().total == 328350


def test_a_finished_run_only_reads(spark, place):
    for _ in range(2):
        calls = []
        run = run_staged(spark, stages(calls), run_id="r", checkpoints=place, period_seconds=0)
    assert calls == [] and run.computed == () and run.resumed_from == "total"
    assert run.result.first().total == 328350


def test_nothing_is_written_before_the_period(spark, place):
    calls = []
    run = run_staged(spark, stages(calls), run_id="r", checkpoints=place, period_seconds=3600)
    assert run.checkpointed == () and run.result.first().total == 328350
    assert run.held.is_cached
    run.release()
    assert run.result.first().total == 328350
    again = []
    run_staged(spark, stages(again), run_id="r", checkpoints=place, period_seconds=3600)
    assert again == ["numbers", "squares", "total"]


def test_period_is_counted_from_the_last_write(spark, place):
    clock = Clock()
    run = run_staged(
        spark,
        stages([], clock=clock, seconds=6),
        run_id="r",
        checkpoints=place,
        period_seconds=10,
        clock=clock,
    )
    assert run.checkpointed == ("squares",)
    again = []
    resumed = run_staged(spark, stages(again), run_id="r", checkpoints=place, period_seconds=10)
    assert again == ["total"] and resumed.resumed_from == "squares"
    assert resumed.result.first().total == run.result.first().total == 328350


def test_a_period_that_ends_while_a_stage_runs(spark, place):
    times = iter([0, 1, 20, 20, 21, 21, 21, 21])
    calls = []
    run = run_staged(
        spark,
        stages(calls)[:2],
        run_id="r",
        checkpoints=place,
        period_seconds=10,
        clock=lambda: next(times),
    )
    assert run.checkpointed == ("numbers",)
    assert run.result.count() == 100


def test_run_ids_are_apart(spark, place):
    for name in ("a", "b"):
        calls = []
        run_staged(spark, stages(calls), run_id=name, checkpoints=place, period_seconds=0)
        assert len(calls) == 3


def test_other_stages_under_a_run_id(spark, place):
    run_staged(spark, stages([]), run_id="r", checkpoints=place, period_seconds=0)
    with pytest.raises(ValueError, match="other stages"):
        run_staged(spark, stages([])[:2], run_id="r", checkpoints=place, period_seconds=0)


def test_arguments(spark, place):
    with pytest.raises(ValueError):
        run_staged(spark, [], run_id="r", checkpoints=place, period_seconds=0)
    with pytest.raises(ValueError):
        run_staged(spark, stages([]) * 2, run_id="r", checkpoints=place, period_seconds=0)
    with pytest.raises(ValueError):
        run_staged(spark, stages([]), run_id="../r", checkpoints=place, period_seconds=0)
    with pytest.raises(ValueError):
        run_staged(spark, stages([]), run_id="r", checkpoints=place, period_seconds=-1)
    with pytest.raises(PermissionError):
        run_staged(
            spark,
            stages([]),
            run_id="r",
            checkpoints=place,
            period_seconds=0,
            policy=AccessPolicy(allow_local_sinks=False),
        )


DYING = """
import os, sys
from pyspark.sql import SparkSession
from muster.plans.staged import run_staged
from muster.sources.locations import Location

def die(spark, previous):
    os._exit(9)

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
stages = [("numbers", lambda spark, _: spark.range(100)), ("squares", die), ("total", die)]
run_staged(spark, stages, run_id="r", checkpoints=Location.local(sys.argv[1]), period_seconds=0)
"""


def test_a_new_process_resumes_a_killed_one(spark, place, tmp_path):
    died = subprocess.run(
        [sys.executable, "-c", DYING, str(tmp_path)],
        env={**os.environ, "PYTHONPATH": str(ROOT)},
        capture_output=True,
        timeout=120,
    )
    assert died.returncode == 9
    calls = []
    run = run_staged(spark, stages(calls), run_id="r", checkpoints=place, period_seconds=0)
    assert calls == ["squares", "total"] and run.result.first().total == 328350
