"""Whole-partition window aggregates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_max_over(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Add the maximum of `value` among all rows with the same `keys`, nulls being one key.

    Same rows as `F.max(value).over(Window.partitionBy(*keys))`. A window would bring every row
    of a key into one task; here the maxima are aggregated before the shuffle and joined back.
    Spark broadcasts them where their size is below its threshold. Beyond it, adaptive execution
    splits the partition of a key that holds much of the rows; it can because null-safe equality
    shuffles the maxima once more, apart from their aggregation. `df` must give the same rows
    each time it is read.
    """
    if not keys:
        raise ValueError("a window needs at least one key")
    own = {column: df[f"`{column}`"] for column in df.columns}
    peaks = df.groupBy(*(own[key].alias(f"__key{i}") for i, key in enumerate(keys))).agg(
        F.max(own[value]).alias("__max")
    )
    same = reduce(
        and_, (own[key].eqNullSafe(peaks[f"__key{i}"]) for i, key in enumerate(keys))
    )
    columns = [peaks["__max"].alias(c) if c == name else own[c] for c in df.columns]
    if name not in df.columns:
        columns.append(peaks["__max"].alias(name))
    return df.join(peaks, same, "left").select(*columns)
