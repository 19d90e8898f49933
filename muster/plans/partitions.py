"""The number of partitions of one run, without a shuffle of its own."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")


@contextmanager
def shuffled_into(spark: SparkSession, count: int | None) -> Iterator[None]:
    """Queries planned inside have `count` partitions behind each shuffle that they have anyway.

    Nothing is added to a plan: a query without a shuffle keeps the partitions of its input, and a
    `repartition` with a number keeps its own. Adaptive execution may still split skewed partitions
    but does not join small ones. Settings are the session's, so other threads that plan queries in
    the same session meanwhile get them too; they are put back in the end, also after an error.
    With None nothing changes.
    """
    if count is None:
        yield
        return
    if count < 1:
        raise ValueError(f"the partition count must be positive, got {count}")
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in zip(_SETTINGS, (str(count), "false"), strict=True):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
