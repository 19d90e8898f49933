"""Audits of worker pools over actor records.

Records have `cluster_id`, `name` and `state`; pools have one row for each `cluster_id` with
`desired`, `min` and `max`. Names stay rows throughout, so a pool of any size is only counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.scaling import WORKER_PREFIX, next_number, worker_number


# Fixed value: the state of an actor that is gone.
_DEAD = "DEAD"


def _live(records: DataFrame, prefix: str) -> DataFrame:
    alive = ~F.col("state").eqNullSafe(_DEAD)
    return records.where(alive & F.col("name").startswith(prefix)).select("cluster_id", "name")


def live_names(records: DataFrame, prefix: str = WORKER_PREFIX) -> DataFrame:
    """The distinct names with the prefix that are not dead, one row each."""
    return _live(records, prefix).distinct()


def next_worker_number(pools: DataFrame, records: DataFrame) -> DataFrame:
    """For each pool the number after its highest live one, 0 if it has none."""
    highest = (
        _live(records, WORKER_PREFIX)
        .groupBy("cluster_id")
        .agg(F.max(worker_number(F.col("name"))).alias("__highest"))
    )
    return pools.join(highest, "cluster_id", "left").select(
        "cluster_id", next_number(F.col("__highest")).alias("next_number")
    )


def scaling_status(pools: DataFrame, records: DataFrame) -> DataFrame:
    """For each pool its number of live workers beside its desired number and bounds."""
    counts = live_names(records).groupBy("cluster_id").agg(F.count("*").alias("__available"))
    return pools.join(counts, "cluster_id", "left").select(
        "cluster_id",
        F.coalesce(F.col("__available"), F.lit(0).cast("bigint")).alias("available"),
        "desired",
        "min",
        "max",
    )
