"""Document fingerprints from content-defined chunks.

A gear hash over the last 16 bytes decides where a text may be cut, so an edit moves only the cuts
near it. Chunking is normalised: below the usual size only rarer cut points count, above it more
frequent ones, which keeps sizes close together. A fingerprint is the set of chunk digests with
their lengths; containment is the share of length found in another set.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Each byte's gear: 32 bits of its digest.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; bits are how many leading bits of the hash must be zero for a cut."""

    least: int = 8
    usual: int = 24
    most: int = 128
    rare_bits: int = 5
    frequent_bits: int = 3


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte, the sum of the gears of the last 16 bytes, each doubled for every byte since,
    modulo 2^32: the hash over 2, 4, 8 and 16 bytes from that over half as many."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8):
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h = longer
    return h


def cut_points(data: bytes, chunking: Chunking) -> list[int]:
    """Where chunks end."""
    n = len(data)
    if n == 0:
        return []
    h = gear_hashes(data)
    frequent = np.flatnonzero(h < np.uint32(1 << (32 - chunking.frequent_bits)))
    is_rare = (h[frequent] < np.uint32(1 << (32 - chunking.rare_bits))).tolist()
    places = (frequent + 1).tolist()
    ends, start, at = [], 0, 0
    count = len(places)
    while n - start > chunking.least:
        low, turn, high = start + chunking.least, start + chunking.usual, start + chunking.most
        at = bisect.bisect_left(places, low, at)
        while at < count and places[at] < turn and not is_rare[at]:
            at += 1
        start = places[at] if at < count and places[at] <= high else high
        if start >= n:
            break
        ends.append(start)
    ends.append(n)
    return ends


def chunk_set(text: str, chunking: Chunking) -> np.ndarray:
    """The different chunks of a text in order: 48 bits of digest, then 16 of length."""
    data = text.encode("utf-8", "surrogatepass")
    digest = xxhash.xxh3_64_intdigest
    found, start = set(), 0
    for end in cut_points(data, chunking):
        found.add(digest(data[start:end]) >> 16 << 16 | (end - start))
        start = end
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def printed(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype(">u8").tobytes()).decode()


def containment(one: np.ndarray, other: np.ndarray) -> float:
    """The share of the first set's length whose chunks are in the second; of two empty sets 1."""
    if len(one) == 0:
        return float(len(other) == 0)
    lengths = (one & np.uint64(0xFFFF)).astype(np.int64)
    if len(other) == 0:
        return 0.0
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    return float(lengths[other[at] == one].sum() / lengths.sum())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_successors(df: DataFrame, key: str, text: str, *, blocks_per_partition: int = 8) -> DataFrame:
    """Rows in blocks: block, lent, key, hash, text, partitioned by block and sorted within.

    In order of key and then the text's hash, each block is a run of rows, and after them, with
    `lent` true, the first row of the next block; after the last block, the first row of all. So
    every row is followed by its successor. Null keys come first, null texts are empty. A row
    that many blocks could begin with, being there many times, is lent as often.

    Blocks begin at places drawn from the table by hash. The driver gets 16 places for each block,
    and the number of blocks follows the number of shuffle partitions, not the rows. Each text is
    shuffled once.
    """
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = 16 * blocks_per_partition * partitions
    every = max(1, df.count() // wanted)
    place = F.struct("key", "hash")
    drawn = rows.where(F.pmod(F.xxhash64("key", "hash", F.lit(9)), F.lit(every)) == 0)
    places = sorted({_order(*r) for r in drawn.select("key", "hash").limit(4 * wanted).collect()})
    lowest = rows.agg(F.min(place).alias("lowest")).first()["lowest"]
    starts = [] if lowest is None else [_order(*lowest), *places[16::16]]

    @F.arrow_udf("block int, begins boolean")
    def locate(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        found = []
        for k, h in zip(keys.to_pylist(), hashes.to_pylist(), strict=True):
            here = _order(k, h)
            block = bisect.bisect_right(starts, here) - 1
            found.append({"block": block, "begins": starts[block] == here})
        return pa.array(found, pa.struct([("block", pa.int32()), ("begins", pa.bool_())]))

    held = F.struct(F.col("at.block").alias("block"), F.lit(False).alias("lent"))
    lent = F.struct(
        F.pmod(F.col("at.block") - 1, F.lit(max(1, len(starts)))).alias("block"), F.lit(True).alias("lent")
    )
    return (
        rows.withColumn("at", locate("key", "hash"))
        .select(
            F.explode(F.when(F.col("at.begins"), F.array(held, lent)).otherwise(F.array(held))).alias("to"),
            "key",
            "hash",
            "text",
        )
        .select("to.block", "to.lent", "key", "hash", "text")
        .repartition(partitions, "block")
        .sortWithinPartitions("block", "lent", "key", "hash")
    )


def _order(key: object, digest: int) -> tuple:
    """Sorts places as Spark does, null keys first."""
    return (key is not None, 0 if key is None else key, digest)


def fingerprint_documents(
    df: DataFrame, key: str, text: str, chunking: Chunking = Chunking()
) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how much of the fingerprint's
    length is contained in the edited text's (near_edited) and in the next row's (near_next).

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next row is the one after it by key (then by the text's hash), after the last the first;
    a table of one row is followed by itself. Rows without text have the empty fingerprint. Other
    columns are not read.

    A task reads its rows one after another and holds two texts at a time.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=target)

        for batch in batches:
            blocks, lents, keys, texts = batch.columns
            for block, lent, row_key, value in zip(
                blocks.to_pylist(), lents.to_pylist(), keys.to_pylist(), texts, strict=True
            ):
                if lent and (waiting is None or waiting[0] != block):
                    continue  # lent more than once
                here = value.as_py()
                chunks = chunk_set(here, chunking)
                if waiting is not None:
                    _, known_key, known, own = waiting
                    changed = edited(known, here)
                    other = chunk_set(changed, chunking)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    near, following = containment(own, other), containment(own, chunks)
                    out.append((known_key, len(known), digest, printed(own), printed(other), near, following))
                    if len(out) >= 500:
                        yield flush()
                waiting = None if lent else (block, row_key, here, chunks)
        if out:
            yield flush()

    rows = with_successors(df, key, text).select("block", "lent", "key", "text")
    found = rows.mapInArrow(compare, schema)
    return found.withColumnRenamed("key", key)
