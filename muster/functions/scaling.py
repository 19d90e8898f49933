"""Worker numbers, bounds and change plans as column expressions: no shuffle, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.columns import refuse_columns

# The prefix of worker names, and the form of those with a number.
WORKER_PREFIX = "worker"
NUMBERED_WORKER = "^worker-([0-9]+)$"

# Names generated by one row of `added_names` before it is split further.
_NAMES_PER_CHUNK = 65_536


def worker_number(name: Column) -> Column:
    """The number at the end of a numbered worker's name, null for any other name."""
    return F.regexp_extract(name, NUMBERED_WORKER, 1).try_cast("bigint")


def next_number(highest: Column) -> Column:
    """The number after the highest, 0 where there is none, null where it would exceed 64 bits."""
    return F.try_add(F.coalesce(highest, F.lit(-1).cast("bigint")), F.lit(1).cast("bigint"))


def worker_name(number: Column) -> Column:
    return F.concat(F.lit(f"{WORKER_PREFIX}-"), number.cast("string"))


def clamped(amount: Column, low: Column, high: Column) -> Column:
    """An amount within its bounds. A null bound is none; a maximum below low wins. A null amount
    stays null."""
    return F.when(amount.isNotNull(), F.least(high, F.greatest(low, amount)))


def clamp_requests(
    requests: DataFrame, amount: str = "amount", low: str = "min", high: str = "max"
) -> DataFrame:
    """Add `desired`, the amount within its bounds, and whether that `changed` it."""
    refuse_columns(requests, "desired", "changed")
    desired = clamped(F.col(amount), F.col(low), F.col(high))
    return requests.withColumns({"desired": desired, "changed": desired != F.col(amount)})


def _names(column: str) -> Column:
    """A set of names: null names and repetitions go."""
    given = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(given))


def _fitting_number(name: Column) -> Column:
    """As `worker_number`, but a number beyond 64 bits fails the job."""
    message = F.concat(F.lit("a worker number is beyond 64 bits: "), name)
    number = worker_number(name)
    return F.when(number.isNull() & name.rlike(NUMBERED_WORKER), F.raise_error(message).cast("bigint")).otherwise(number)


def plan_changes(
    requests: DataFrame,
    *,
    live: str = "live",
    amount: str = "amount",
    low: str = "min",
    high: str = "max",
    delete: str = "workers_to_delete",
    keep: str = "workers_to_keep",
) -> DataFrame:
    """Add what a request changes in the pool it was made for.

    `live` holds the pool's names at the moment of the request; null is an empty pool. Adds
    `desired` (the amount within its bounds), `available`, the numbers of the workers to add as
    `add_first` and `add_count`, the names to `remove`, and `planned_size`.

    A pool below the desired size grows by new numbers after its highest. A pool of the desired
    size stays. A larger one loses everything where nothing is desired; else the named workers:
    those to delete and, where some are to be kept, all the others. Names not in the pool count
    as not given. With no names given the surplus goes, first names first. Named removals are
    not brought to the desired size, so `planned_size` can differ from it. A request without an
    amount changes nothing. A pool that would grow past numbers of 64 bits fails the job.
    """
    refuse_columns(
        requests, "desired", "available", "add_first", "add_count", "remove", "planned_size"
    )
    staged = requests.withColumns(
        {
            "desired": clamped(F.col(amount), F.col(low), F.col(high)),
            "__live": _names(live),
        }
    ).withColumns(
        {
            "available": F.size("__live").cast("bigint"),
            "__delete": F.array_intersect(_names(delete), F.col("__live")),
            "__keep": F.array_intersect(_names(keep), F.col("__live")),
            "__highest": F.array_max(F.transform("__live", _fitting_number)),
        }
    )
    no_number = F.raise_error(F.lit("the pool's highest worker number has no successor in 64 bits"))
    surplus = F.col("available") - F.col("desired")
    no_names = F.array().cast("array<string>")
    named = F.array_union(
        F.col("__delete"),
        F.when(
            F.size("__keep") > 0,
            F.array_except(F.array_except(F.col("__live"), F.col("__delete")), F.col("__keep")),
        ).otherwise(no_names),
    )
    remove = (
        F.when(F.col("desired").isNull() | (surplus <= 0), no_names)
        .when(F.col("desired") == 0, F.col("__live"))
        .when(
            (F.size("__delete") == 0) & (F.size("__keep") == 0),
            F.slice(F.sort_array("__live"), F.lit(1), F.greatest(surplus, F.lit(0)).cast("int")),
        )
        .otherwise(named)
    )
    return (
        staged.withColumns(
            {
                "add_first": F.when(surplus < 0, F.coalesce(next_number(F.col("__highest")), no_number)),
                "add_count": F.greatest(-surplus, F.lit(0)),
                "remove": F.sort_array(remove),
            }
        )
        .withColumn(
            "planned_size", F.col("available") + F.col("add_count") - F.size("remove")
        )
        .drop("__live", "__delete", "__keep", "__highest")
    )


def added_names(planned: DataFrame, *keys: str) -> DataFrame:
    """The names a plan adds, one row each, beside the plan's key columns.

    The range is unfolded in two steps, so a request for any number of workers never becomes one
    array, and its chunks are dealt to all tasks before they become names.
    """
    tasks = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = F.ceil(F.col("add_count") / F.lit(_NAMES_PER_CHUNK))
    first = F.col("add_first") + F.col("__chunk") * F.lit(_NAMES_PER_CHUNK)
    last = F.least(
        first + F.lit(_NAMES_PER_CHUNK - 1), F.col("add_first") + F.col("add_count") - F.lit(1)
    )
    return (
        planned.where(F.col("add_count") > 0)
        .select(
            *keys,
            "add_first",
            "add_count",
            F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - F.lit(1))).alias("__chunk"),
        )
        .repartition(tasks, *keys, "__chunk")
        .select(*keys, F.explode(F.sequence(first, last)).alias("__number"))
        .select(*keys, worker_name(F.col("__number")).alias("name"))
    )
