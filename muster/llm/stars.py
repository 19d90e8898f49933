"""Groups as stars: every member with one member of its group, never all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.frames import durable_step, tidied

_NAMES = ["key", "node", "size", "hub", "hub_size"]


def star_rows(df: DataFrame, rank: Column | None = None) -> DataFrame:
    """The rows of groups of two or more nodes, each with a hub: key, node, size, hub, hub_size.

    `df` has key, size and node, all longs and not null. A group is sorted by `rank`, an expression
    over these (if not given, by size), then node, and its first row is the hub. A node counts
    once in a group. Groups of one node go.

    Rows are shuffled once by key and sorted; a task then reads them in order and holds one batch
    and the current hub, so a group of any size passes.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.select("key", "size", "node")
        .repartition(partitions, "key")
        .sortWithinPartitions("key", "size" if rank is None else rank, "node")
        .select("key", "size", "node")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the key of the row before the one held back
        back = [np.empty(0, np.int64)] * 3  # the last row read, whose next row isn't known yet
        group = hub = hub_size = None
        for batch in batches:
            keys, sizes, nodes = (np.append(b, c.to_numpy()) for b, c in zip(back, batch.columns, strict=True))
            if len(keys) > 1:
                once = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
                keys, sizes, nodes = keys[once], sizes[once], nodes[once]
            if len(keys) == 0:
                continue
            same = keys[1:] == keys[:-1]
            with_last = np.append(before is not None and before == keys[0], same)
            chosen = np.flatnonzero(with_last[:-1] | same)
            out = []
            for key, size, node in zip(
                keys[chosen].tolist(), sizes[chosen].tolist(), nodes[chosen].tolist(), strict=True
            ):
                if key != group:
                    group, hub, hub_size = key, node, size
                out.append((key, node, size, hub, hub_size))
            if out:
                yield _batch(out)
            before = int(keys[-2]) if len(keys) > 1 else before
            back = [keys[-1:], sizes[-1:], nodes[-1:]]
        if len(back[0]) and before == back[0][0]:
            key, size, node = (int(c[0]) for c in back)
            yield _batch([(key, node, size, hub, hub_size)])

    return ordered.mapInArrow(tidied(link), "key long, node long, size long, hub long, hub_size long")


def _batch(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_NAMES)


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Nodes of links (one, other: longs) with their component, the least node reachable.

    Each round takes the least label among a node's neighbours and then that label's own label,
    so even a chain needs about as many rounds as its length has binary digits. Rounds are kept
    as checkpoints. Nodes without links are not in the result.
    """
    both = durable_step(
        links.select(F.col("one").alias("a"), F.col("other").alias("b"))
        .unionByName(links.select(F.col("other").alias("a"), F.col("one").alias("b")))
        .distinct()
    )
    labels = durable_step(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = (
            both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("seen")), "b")
            .groupBy("a")
            .agg(F.min("seen").alias("seen"))
        )
        lower = labels.join(near, "a").select(
            "a", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        far = labels.select(F.col("a").alias("label"), F.col("label").alias("beyond"))
        moved = durable_step(lower.join(far, "label").select("a", "old", F.col("beyond").alias("label")))
        labels = moved.select("a", "label")
        if not moved.where("old <> label").limit(1).count():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components not found in {most_rounds} rounds")
