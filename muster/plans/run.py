"""Running a query: a stored result and a preview of it."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from muster.plans.partitions import shuffled_into
from muster.sources.locations import OPEN_POLICY, AccessPolicy, Location, scan, sink

PREVIEW_ROWS = 10

_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


@dataclass(frozen=True)
class RunResult:
    """Where a query's rows were stored, and a few of them in no promised order.

    `head` is None when the caller named the sink. `location` is never cleaned up by us.
    """

    location: Location
    head: DataFrame | None


def check_name(what: str, name: str) -> str:
    """Accept only names that are one path component."""
    if _RUN_ID.fullmatch(name) is None:
        raise ValueError(f"{what} must be letters, digits, '.', '_' or '-', got {name!r}")
    return name


def execute(
    df: DataFrame,
    *,
    to: Location | None = None,
    results: Location | None = None,
    run_id: str | None = None,
    preview_rows: int = PREVIEW_ROWS,
    partitions: int | None = None,
    policy: AccessPolicy = OPEN_POLICY,
) -> RunResult:
    """Run a query once and store its rows.

    With `to` the rows go there. Otherwise they go to a folder of this run below `results`, and
    the result carries a preview read back from it, so previewing never reruns the query. With
    `partitions` the query's shuffles have so many in this run; see `shuffled_into`.
    """
    policy.check_frame(df)
    if to is not None:
        with shuffled_into(df.sparkSession, partitions):
            sink(df, to, policy=policy)
        return RunResult(to, None)
    if results is None:
        raise ValueError("the query names no sink and there is no location for unnamed results")
    location = results.child(check_name("run_id", run_id or uuid.uuid4().hex))
    with shuffled_into(df.sparkSession, partitions):
        sink(df, location, policy=policy)
    # The preview reads what this run just wrote: the scan policy is about users' inputs.
    stored = scan(df.sparkSession, location, schema=df.schema)
    return RunResult(location, stored.limit(preview_rows))


def with_partitions(
    df: DataFrame,
    per_worker: int | None,
    *,
    workers: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Spread a frame over `per_worker` partitions for each worker.

    A query's own `partitions` wins. With neither, the frame is left alone and adaptive execution
    sizes its partitions. Rows are dealt out evenly rather than hashed, so no key can fill a
    partition.
    """
    if partitions is None and per_worker is None:
        return df
    count = partitions
    if count is None:
        count = per_worker * (workers or _workers(df.sparkSession))
    if count < 1:
        raise ValueError(f"the partition count must be positive, got {count}")
    return df.repartition(count)


def _workers(spark: SparkSession) -> int:
    """The executors the session asks for or, where it states none, those it has now."""
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return 1
    for setting in ("spark.executor.instances", "spark.dynamicAllocation.maxExecutors"):
        value = spark.conf.get(setting, None)
        # as many as there can be is no number of workers
        if value is not None and value.isdigit() and 0 < int(value) < 2**31 - 1:
            return int(value)
    if not _executors(spark):
        spark.sparkContext.parallelize([0], 1).count()  # waits for a first one
    return max(1, _executors(spark))


def _executors(spark: SparkSession) -> int:
    return spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # one is the driver
