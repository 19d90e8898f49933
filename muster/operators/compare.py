"""Comparison of frames as bags of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

from muster.functions.columns import own_columns, refuse_columns


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that the two frames hold in different numbers, with both numbers.

    Nulls are equal to each other, and so are NaNs. Copies are counted before the one shuffle.
    """
    _refuse_unlike(left, right)
    sides = left.withColumns(
        {"left_count": F.lit(1).cast("bigint"), "right_count": F.lit(0).cast("bigint")}
    ).unionByName(
        right.withColumns(
            {"left_count": F.lit(0).cast("bigint"), "right_count": F.lit(1).cast("bigint")}
        )
    )
    counts = sides.groupBy(*own_columns(left)).agg(
        F.sum("left_count").alias("left_count"), F.sum("right_count").alias("right_count")
    )
    return counts.where(F.col("left_count") != F.col("right_count"))


def bag_digests(df: DataFrame, buckets: int = 1024) -> DataFrame:
    """bucket, rows and two sums of row hashes: what a bag of rows is, in no order, by hash bucket.

    Rows are in the bucket of their first hash. Sums don't depend on order and count copies, and
    they are made before the shuffle, so at most one row for each bucket and task is shuffled. Equal
    bags have equal digests. Different ones have different digests but for a chance of about 2^-64 for
    a bucket. Columns that Spark doesn't hash or compare as values are refused: see `_hashable`.
    """
    for field in df.schema.fields:
        if not _hashable(field.dataType):
            raise ValueError(f"no digest of column {field.name}: {field.dataType.simpleString()}")
    first, second = _row_hashes(df)
    return (
        df.select(F.pmod(first, F.lit(buckets)).alias("bucket"), first.alias("first"), second.alias("second"))
        .groupBy("bucket")
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.col("first").cast("decimal(20,0)")).alias("first"),
            F.sum(F.col("second").cast("decimal(20,0)")).alias("second"),
        )
    )


def differing_buckets(left: DataFrame, right: DataFrame, buckets: int = 1024) -> list[int]:
    """The hash buckets whose digests differ: none where the frames hold the same rows.

    Two sums of at most `buckets` rows come to the driver.
    """
    _refuse_unlike(left, right)
    mine = bag_digests(left, buckets)
    theirs = bag_digests(right, buckets)
    digest = F.struct("rows", "first", "second")
    both = (
        mine.select("bucket", digest.alias("digest"))
        .unionByName(theirs.select("bucket", digest.alias("digest")))
        .groupBy("bucket")
        .agg(F.count("*").alias("sides"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        .where((F.col("sides") < 2) | (F.col("low") != F.col("high")))
    )
    return sorted(r["bucket"] for r in both.select("bucket").collect())


def bag_difference_by_digest(left: DataFrame, right: DataFrame, buckets: int = 1024) -> DataFrame:
    """`bag_difference`, with only the rows of differing buckets shuffled.

    Both frames are read once for their digests, when this is called, and once more for the rows of
    differing buckets, so they have to give the same rows both times. Frames that hold the same
    rows are not read again. Where most buckets differ, `bag_difference` is cheaper.
    """
    _refuse_unlike(left, right)
    differing = differing_buckets(left, right, buckets)

    def of_buckets(df: DataFrame) -> DataFrame:
        return df.where(F.pmod(_row_hashes(df)[0], F.lit(buckets)).isin(differing) if differing else F.lit(False))

    return bag_difference(of_buckets(left), of_buckets(right))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two frames have the same columns, types and rows, in any order."""
    return _shape(left) == _shape(right) and bag_difference(left, right).isEmpty()


def _hashable(kind: DataType) -> bool:
    """Whether equal values have equal hashes: not maps, and not texts of a collation."""
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StringType):
        return kind.simpleString() == "string"
    return not isinstance(kind, MapType) and kind.simpleString() != "variant"


def _told(column: Column, kind: DataType) -> Column:
    """A value with what its hash alone would not tell: whether it is null, how long an array is.

    Zeros and NaNs are one each, as grouping sees them.
    """
    if isinstance(kind, ArrayType):
        return F.struct(
            column.isNull(), F.size(column), F.transform(column, lambda each: _told(each, kind.elementType))
        )
    if isinstance(kind, StructType):
        return F.struct(column.isNull(), *(_told(column.getField(f.name), f.dataType) for f in kind.fields))
    if isinstance(kind, FloatType | DoubleType):
        nan = F.lit(float("nan")).cast(kind)
        column = F.when(F.isnan(column), nan).when(column == 0, F.lit(0).cast(kind)).otherwise(column)
    return F.struct(column.isNull(), column)


def _row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row: of its columns, and of its columns in reverse with another start."""
    told = [_told(c, f.dataType) for c, f in zip(own_columns(df), df.schema.fields, strict=True)]
    return F.xxhash64(*told), F.xxhash64(F.lit(0x5BD1E995), *reversed(told))


def _refuse_unlike(left: DataFrame, right: DataFrame) -> None:
    names = left.columns
    if _shape(left) != _shape(right):
        raise ValueError(f"the frames differ in columns: {_shape(left)} and {_shape(right)}")
    if len(set(names)) != len(names):
        raise ValueError("column names must be distinct")
    refuse_columns(left, "left_count", "right_count")


def _shape(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes
