"""Change plans for pools of any size: names stay rows, in ranges of their sorted order.

`muster.functions.scaling.plan_changes` holds a pool as one array of one row and needs no shuffle;
it is for pools that fit there. Here a pool is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.columns import refuse_columns
from muster.functions.scaling import NUMBERED_WORKER, clamped
from muster.operators.timeline import in_ranges

_LARGEST = 2**63 - 1


@dataclass(frozen=True)
class PoolChanges:
    """`plans` has one row for each request, `removals` one for each name to remove."""

    plans: DataFrame
    removals: DataFrame


def plan_pool_changes(
    requests: DataFrame,
    live: DataFrame,
    given: DataFrame,
    *,
    key: str = "request",
    amount: str = "amount",
    low: str = "min",
    high: str = "max",
) -> PoolChanges:
    """What each request changes in its pool, by the rules of `plan_changes`.

    `live` has the names of the pools as rows (`key`, name), each pool being that of one request;
    `given` has the names that requests name as rows (`key`, name, wish), the wish being `delete` or
    `keep`. Repeated rows count once; null names and keys, other wishes, names that are not in the
    pool and pools without a request are left out. A request without a pool has an empty one.

    Plans are the requests with `desired`, `available`, `add_first`, `add_count`, `remove_count`,
    `planned_size` and `problem`. The last is null, or `number_too_large` where the pool would grow
    past numbers of 64 bits: such a request changes nothing, and others are not touched by it.
    Removals are rows of `key` and name. Requests that share a key have a plan each, and the names
    of that key appear once for each of them.
    """
    refuse_columns(
        requests, "desired", "available", "add_first", "add_count", "remove_count", "planned_size", "problem"
    )
    rows = in_ranges(_marked(live, given, key), "request", "name")
    # all digits that a decimal holds; a longer number is larger than any other
    digits = F.ltrim(F.regexp_extract("name", NUMBERED_WORKER, 1), F.lit("0"))
    numbered = F.col("name").rlike(NUMBERED_WORKER)
    number = F.when(numbered & (F.length(digits) > 19), F.lit("1" + "0" * 19).cast("decimal(20,0)")).when(
        numbered, F.coalesce(digits.try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    )
    by_range = rows.groupBy("__range", "request").agg(
        F.count("*").alias("names"),
        F.count_if("delete").alias("deletes"),
        F.count_if("keep").alias("keeps"),
        F.count_if(F.col("delete") | F.col("keep")).alias("either"),
        F.max(number).alias("highest"),
    )
    totals = by_range.groupBy("request").agg(
        F.sum("names").alias("__names"),
        F.sum("deletes").alias("__deletes"),
        F.sum("keeps").alias("__keeps"),
        F.sum("either").alias("__either"),
        F.max("highest").alias("__highest"),
    )
    plans = _plans(requests, totals, key, amount, low, high)

    # what a range has to know: its request's rule, and how many names come before its first
    before = Window.partitionBy("request").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select(
        F.col("__range").alias("r"), "request", F.coalesce(F.sum("names").over(before), F.lit(0)).alias("start")
    )
    rules = plans.where("remove_count > 0").select(
        F.col(f"`{key}`").alias("request"), "__rule", F.col("remove_count").alias("first")
    )
    told = starts.join(rules, "request").withColumnRenamed("request", "q")
    in_order = Window.partitionBy("__range", "request").orderBy("name")
    # a request that repeats its key repeats its names here, hence the dense rank
    removed = (
        rows.join(told, (F.col("__range") == F.col("r")) & (F.col("request") == F.col("q")))
        .withColumn("place", F.col("start") + F.dense_rank().over(in_order))
        .where(
            F.when(F.col("__rule") == "all", F.lit(True))
            .when(F.col("__rule") == "first", F.col("place") <= F.col("first"))
            .when(F.col("__rule") == "others", F.col("delete") | ~F.col("keep"))
            .otherwise(F.col("delete"))
        )
        .select(F.col("request").alias(key), "name")
    )
    return PoolChanges(plans.drop("__rule"), removed)


def _marked(live: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """request, name, delete, keep: each name of a pool once, with what was wished for it."""
    own = F.col(f"`{key}`").alias("request")
    sides = live.select(own, "name", F.lit(None).cast("string").alias("wish"), F.lit(True).alias("live")).unionByName(
        given.select(own, "name", "wish", F.lit(False).alias("live"))
    )
    return (
        sides.where("request is not null and name is not null")
        .groupBy("request", "name")
        .agg(
            F.bool_or("live").alias("live"),
            F.coalesce(F.bool_or(F.col("wish") == "delete"), F.lit(False)).alias("delete"),
            F.coalesce(F.bool_or(F.col("wish") == "keep"), F.lit(False)).alias("keep"),
        )
        .where("live")
        .drop("live")
    )


def _plans(requests: DataFrame, totals: DataFrame, key: str, amount: str, low: str, high: str) -> DataFrame:
    own = [F.col(f"`{name}`") for name in requests.columns]
    none = F.lit(0).cast("bigint")
    asked = requests.withColumn("desired", clamped(F.col(amount), F.col(low), F.col(high)))
    joined = asked.join(
        totals.withColumnRenamed("request", "__request"), F.col(f"`{key}`") == F.col("__request"), "left"
    ).withColumns({name: F.coalesce(name, none) for name in ("__names", "__deletes", "__keeps", "__either")})
    surplus = F.col("__names") - F.col("desired")
    first = F.coalesce(F.col("__highest") + 1, F.lit(0).cast("decimal(21,0)"))
    fits = first + F.greatest(-surplus, none) - 1 <= F.lit(_LARGEST)
    grows = F.coalesce(surplus < 0, F.lit(False))
    rule = (
        F.when(F.col("desired").isNull() | (surplus <= 0), "none")
        .when(F.col("desired") == 0, "all")
        .when(F.col("__either") == 0, "first")
        .when(F.col("__keeps") > 0, "others")
        .otherwise("named")
    )
    removed = (
        F.when(F.col("__rule") == "all", F.col("__names"))
        .when(F.col("__rule") == "first", surplus)
        # all but the names to keep, and of these the ones to delete as well
        .when(F.col("__rule") == "others", F.col("__names") - F.col("__either") + F.col("__deletes"))
        .when(F.col("__rule") == "named", F.col("__deletes"))
        .otherwise(none)
    )
    return (
        joined.withColumn("__rule", rule)
        .select(
            *own,
            "desired",
            F.col("__names").alias("available"),
            F.when(grows & fits, first.try_cast("bigint")).alias("add_first"),
            F.when(grows & fits, -surplus).otherwise(none).alias("add_count"),
            removed.alias("remove_count"),
            F.when(grows & ~fits, "number_too_large").alias("problem"),
            "__rule",
        )
        .withColumn("planned_size", F.col("available") + F.col("add_count") - F.col("remove_count"))
    )
