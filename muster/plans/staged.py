"""Pipelines that resume from durable checkpoints of their stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from muster.plans.run import check_name
from muster.sources.locations import OPEN_POLICY, AccessPolicy, Location, scan, sink

Stage = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]


@dataclass(frozen=True)
class StagedRun:
    """The last stage's frame, and which stages this run computed and checkpointed.

    Where the result builds on a stage in executor storage, `release` frees that.
    """

    result: DataFrame
    computed: tuple[str, ...]
    checkpointed: tuple[str, ...]
    resumed_from: str | None
    held: DataFrame | None = None

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()


def run_staged(
    spark: SparkSession,
    stages: Sequence[Stage],
    *,
    run_id: str,
    checkpoints: Location,
    period_seconds: float,
    policy: AccessPolicy = OPEN_POLICY,
    clock: Callable[[], float] = time.monotonic,
) -> StagedRun:
    """Run a chain of stages; a later run with the same `run_id` continues where this one stopped.

    Each stage maps the previous stage's frame (None for the first) to its own. A completed stage
    is written to `checkpoints` once `period_seconds` have passed since the last write. Where that
    is already so when a stage begins, the write itself is what runs the stage. Otherwise the
    stage is run into executor storage, from where a lost executor's part is recomputed, and
    written from there if the period ran out meanwhile. The last stage is left for the caller's
    own action unless its checkpoint is due.

    A `run_id` belongs to one list of stage names and to one running process at a time. Completed
    stages are told by the `_SUCCESS` file Spark writes last, so that must not be switched off.
    """
    names = [check_name("stage name", name) for name, _ in stages]
    if not names or len(set(names)) != len(names):
        raise ValueError("stages need distinct names, and at least one")
    if period_seconds < 0:
        raise ValueError("the period cannot be negative")
    policy.check_sink(checkpoints)
    root = checkpoints.child(check_name("run_id", run_id))
    folders = [root.child(f"stage-{i:03d}-{name}") for i, name in enumerate(names)]
    _claim(spark, root.child("stages"), names)

    done = [i for i, folder in enumerate(folders) if _exists(spark, folder.child("_SUCCESS"))]
    first, frame = 0, None
    if done:
        first, frame = done[-1] + 1, scan(spark, folders[done[-1]])

    checkpointed: list[str] = []
    held: DataFrame | None = None
    last_write = clock()
    kept: DataFrame | None = None
    try:
        for i in range(first, len(names)):
            frame = stages[i][1](spark, frame)
            due = clock() - last_write >= period_seconds
            kept = None
            if not due and i < len(names) - 1:
                kept = frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
                frame.count()
                due = clock() - last_write >= period_seconds
            if due:
                sink(frame, folders[i], mode="overwrite", policy=policy)
                frame = scan(spark, folders[i], schema=frame.schema)
                checkpointed.append(names[i])
                last_write = clock()
            if held is not None and (kept is not None or due):
                held.unpersist()
                held = None
            if kept is not None and due:
                kept.unpersist()
            elif kept is not None:
                held = kept
    except BaseException:
        for stored in (held, kept):
            if stored is not None:
                stored.unpersist()
        raise

    return StagedRun(
        frame,
        tuple(names[first:]),
        tuple(checkpointed),
        names[done[-1]] if done else None,
        held,
    )


def _claim(spark: SparkSession, folder: Location, names: list[str]) -> None:
    """Record the stage names of a run, or check them against the recorded ones."""
    if _exists(spark, folder.child("_SUCCESS")):
        recorded = scan(spark, folder, "json", "position int, stage string")
        if [row.stage for row in recorded.orderBy("position").collect()] != names:
            raise ValueError(f"this run_id was started with other stages: {folder.uri}")
        return
    rows = spark.createDataFrame(list(enumerate(names)), "position int, stage string")
    sink(rows.coalesce(1), folder, "json", mode="overwrite")


def _exists(spark: SparkSession, location: Location) -> bool:
    conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for name, value in location.options.items():
        conf.set(name, value)
    path = spark._jvm.org.apache.hadoop.fs.Path(location.uri)
    return path.getFileSystem(conf).exists(path)
