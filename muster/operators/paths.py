"""Reducing sets of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_depth(path: Column) -> Column:
    """The number of parts of an absolute path, the root being one."""
    return F.when(path == "/", F.lit(1)).otherwise(F.size(F.split(path, "/")))


def _first_parts(path: Column, count: Column) -> Column:
    """The text before the count-th slash, naming the root where that is empty."""
    text = F.call_function("substring_index", path, F.lit("/"), count)
    return F.when(text == "", F.lit("/")).otherwise(text)


def _parent(path: Column) -> Column:
    above = _first_parts(path, F.size(F.split(path, "/")) - 1)
    return F.when(path != "/", above)


def _self_and_ancestors(path: Column) -> Column:
    depths = F.sequence(F.lit(1), F.size(F.split(path, "/")))
    return F.array_distinct(F.transform(depths, lambda depth: _first_parts(path, depth)))


def covering_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """The distinct paths that have no ancestor among them, with their `depth`.

    Paths are absolute and normalised: no empty, `.` or `..` part and no closing slash. Ancestry
    goes by whole parts, so `/ab` is not below `/a`. Whether a path is covered depends on its
    folder alone, so ancestors are unfolded for the distinct folders, not for every path.
    """
    path = F.col("path")
    known = paths.select(F.col(column).alias("path")).where(path.isNotNull()).distinct()
    folders = known.select(_parent(path).alias("folder")).distinct()
    above = folders.select("folder", F.explode(_self_and_ancestors(F.col("folder"))).alias("part"))
    # Null-safe equality gives both sides a shuffle of their own. Reusing the one of distinct()
    # would keep adaptive execution from splitting the partition of a part most folders share.
    covered = above.join(known, F.col("part").eqNullSafe(path), "left_semi").select("folder")
    return (
        known.withColumn("folder", _parent(path))
        .join(covered, "folder", "left_anti")
        .select("path", path_depth(path).alias("depth"))
    )


def in_cover_order(cover: DataFrame) -> DataFrame:
    """Sort a cover by depth, then part by part."""
    return cover.orderBy("depth", F.split("path", "/"))
