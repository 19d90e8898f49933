"""Pools as they were at a moment, from a log of their workers' states.

Both steps work on rows in order of a key and of time. The rows are cut into ranges of that order,
so a key of any size is spread over many tasks, and what a range must know of those before it is
carried over as one small row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.scaling import WORKER_PREFIX
from muster.plans.scratch import scratch_location
from muster.sources.locations import scan, sink

_DEAD = "DEAD"  # fixed value: the state of an actor that is gone


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows with `__range`, the number of their range in this order; stored once, so that the
    numbers stay what they are."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
    place = scratch_location(spark, "ranges")
    sink(numbered, place)
    return scan(spark, place, schema=numbered.schema)


def live_changes(records: DataFrame, prefix: str = WORKER_PREFIX) -> DataFrame:
    """cluster_id, ts, place, change: when a pool's number of live workers changes, and by how much.

    `records` is a log with cluster_id, name, state, ts and place, which orders records of one
    time. A worker is live from a record with a state other than DEAD (null too) until one that is DEAD.
    Other names than those with the prefix, and records without a time, are not read. Records
    that repeat a state change nothing.
    """
    states = records.where(F.col("name").startswith(prefix) & F.col("ts").isNotNull()).select(
        "cluster_id", "name", "ts", "place", (~F.col("state").eqNullSafe(_DEAD)).cast("int").alias("live")
    )
    rows = in_ranges(states, "cluster_id", "name", "ts", "place")
    worker = ["cluster_id", "name"]
    inside = Window.partitionBy("__range", *worker).orderBy("ts", "place")
    # a range's last state of a worker is what the next range with that worker begins from
    last = rows.groupBy("__range", *worker).agg(F.max_by("live", F.struct("ts", "place")).alias("last"))
    carried = last.select(
        "__range", *worker, F.lag("last").over(Window.partitionBy(*worker).orderBy("__range")).alias("carried")
    )
    before = carried.where("carried = 1").withColumnsRenamed(
        {"__range": "r", "cluster_id": "c", "name": "n"}
    )
    same = (F.col("__range") == F.col("r")) & F.col("cluster_id").eqNullSafe(F.col("c")) & (F.col("name") == F.col("n"))
    was = F.coalesce(F.lag("live").over(inside), F.col("carried"), F.lit(0))
    return (
        rows.join(before, same, "left")
        .select("cluster_id", "ts", "place", (F.col("live") - was).alias("change"))
        .where("change <> 0")
    )


def live_counts_at(requests: DataFrame, records: DataFrame, prefix: str = WORKER_PREFIX) -> DataFrame:
    """Add `available`, the number of workers live in the request's pool at the request's time.

    `requests` has cluster_id and ts besides its own columns; see `live_changes` for `records`.
    A record of the request's very time counts. A pool without records has 0 workers, a request
    without a time null. Requests and changes are put in one order and summed up along it: no
    request is compared with the records one by one. Repeated requests all stay. Requests have no map
    columns.
    """
    own = F.struct(*[F.col(f"`{name}`") for name in requests.columns])
    asked = requests.select("cluster_id", "ts", F.lit(1).alias("turn"), F.lit(0).alias("change"), own.alias("request"))
    kind = asked.schema["request"].dataType
    changes = live_changes(records, prefix).select(
        "cluster_id", "ts", F.lit(0).alias("turn"), "change", F.lit(None).cast(kind).alias("request")
    )
    # very many requests of one pool and time are spread, too
    spread = asked.unionByName(changes).withColumn("spread", F.xxhash64("request"))
    rows = in_ranges(spread, "cluster_id", "ts", "turn", "spread")
    so_far = Window.partitionBy("__range", "cluster_id").orderBy("ts", "turn")
    totals = rows.groupBy("__range", "cluster_id").agg(F.sum("change").alias("total"))
    earlier = Window.partitionBy("cluster_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("__range").alias("r"), F.col("cluster_id").alias("c"), F.sum("total").over(earlier).alias("carried")
    ).where("carried <> 0")
    same = (F.col("__range") == F.col("r")) & F.col("cluster_id").eqNullSafe(F.col("c"))
    # rows equal in time and turn are peers in the window's frame and so have one sum
    found = rows.withColumn("inside", F.sum("change").over(so_far)).where("turn = 1").join(carried, same, "left")
    available = F.when(F.col("ts").isNotNull(), F.col("inside") + F.coalesce("carried", F.lit(0)))
    return found.select("request.*", available.cast("bigint").alias("available"))
