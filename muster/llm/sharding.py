"""Contiguous shards of near equal bytes, by prefix sums. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.frames import durable


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text and 8 for its framing; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard_by_bytes(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """One row for each row: key, size, text_crc32, law ('bytes'), shard from 0, slot in the shard,
    grown_shard (null: another number of shards cuts anew).

    Rows are ordered by the text's crc32, key and size, so copies of a text stand together. A row
    goes to the shard in whose equal share of all bytes it begins, so a shard's bytes differ from
    the share by less than the largest row on either side. Rows equal in all three are
    interchangeable. A null text has size 8 and a null crc32, and comes first, as null keys do.
    An empty table gives no rows. Other columns of `df` are not read.

    Rows are range partitioned once, without their texts. The partitions' totals, one row each,
    become offsets, and only a running sum within each partition is left to do.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    column = F.col(f"`{text}`")
    rows = df.select(
        F.col(f"`{key}`").alias("key"),
        text_bytes(column).alias("size"),
        F.crc32(column).alias("text_crc32"),
    )
    order = ["text_crc32", "key", "size"]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, so that the totals and the rows are of the same cut
    dealt = durable(
        rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = (
        dealt.groupBy("part")
        .agg(F.sum("size").alias("bytes"))
        .select(
            F.col("part").alias("offset_part"),
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        dealt.withColumns({"until": F.sum("size").over(running), "nth": F.row_number().over(running)})
        .join(offsets, F.col("part") == F.col("offset_part"))
        .withColumn("begin", F.col("offset") + F.col("until") - F.col("size"))
        .withColumn("shard", F.expr(f"cast(cast(begin as decimal(38,0)) * {shards} div total as int)"))
    )
    placed = durable(placed.select("key", "size", "text_crc32", "shard", "part", "nth"))
    # the rows of a shard in each partition are one run: where they start gives the slot
    runs = placed.groupBy("shard", "part").agg(F.min("nth").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("shard").alias("run_shard"),
        F.col("part").alias("run_part"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    return placed.join(
        starts, (F.col("shard") == F.col("run_shard")) & (F.col("part") == F.col("run_part"))
    ).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
