"""Naming columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_columns(df: DataFrame) -> list[Column]:
    """A frame's columns by exact name, names with dots included."""
    return [F.col(f"`{name}`") for name in df.columns]


def refuse_columns(df: DataFrame, *names: str) -> None:
    """Raise where a column to be added is already there."""
    taken = set(names) & set(df.columns)
    if taken:
        raise ValueError(f"columns would be overwritten: {sorted(taken)}")
