"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are of UTF-8 bytes, one token each, and one end mark for every piece. A document longer
than the longest sequence is cut into pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from muster.llm.frames import tidied


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths and what a sequence costs: a fixed part, a part for each token
    and a part for each pair of tokens."""

    permitted: tuple[int, ...] = (2048, 4096, 8192, 16384)
    fixed: float = 128.0
    pairs: float = 1 / 65536

    def __post_init__(self) -> None:
        if not self.permitted or min(self.permitted) < 8 or list(self.permitted) != sorted(set(self.permitted)):
            raise ValueError("permitted lengths must be increasing and at least 8")

    def cost(self, length: int) -> float:
        return self.fixed + length + self.pairs * length * length

    def least(self, length: int) -> int:
        """The shortest permitted length that holds so many tokens."""
        return self.permitted[bisect.bisect_left(self.permitted, length)]

    def to_open(self, length: int, after: int) -> int:
        """The length of least net cost for a new bin.

        What room a bin leaves is worth the best rate any length has, as far as the tokens still
        to come (`after`) can fill it.
        """
        rate = min(self.cost(c) / c for c in self.permitted)
        fitting = [c for c in self.permitted if c >= length]
        return min(fitting, key=lambda c: (self.cost(c) - rate * min(c, length + after), c))


def best_fit(sizes: list[int], lengths: Lengths, floor: int | None = None) -> tuple[list[list[int]], float]:
    """Bins, as lists of item numbers, and their cost after downsizing.

    Items go longest first (equal ones in order) to the bin they leave least room in, of equal
    ones the one opened first. Where none has room, a bin is opened: of least net cost, or with
    `floor` of the shortest length at least so long.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    after = sum(sizes)
    bins: list[list[int]] = []
    used: list[int] = []
    room: list[tuple[int, int]] = []  # of open bins: room left, number; sorted
    for item in order:
        size = sizes[item]
        after -= size
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            number = len(bins)
            bins.append([])
            used.append(0)
            left = lengths.to_open(size, after) if floor is None else lengths.least(max(size, floor))
        bins[number].append(item)
        used[number] += size
        if left > size:
            bisect.insort(room, (left - size, number))
    return bins, sum(lengths.cost(lengths.least(n)) for n in used)


def pack_items(sizes: list[int], lengths: Lengths) -> list[list[int]]:
    """The cheapest of the packings that open bins by net cost, or at each permitted length."""
    tried = (best_fit(sizes, lengths, floor) for floor in (None, *lengths.permitted))
    return min(tried, key=lambda x: x[1])[0]


def cut(data: bytes, longest: int) -> list[tuple[int, int]]:
    """Start and end of pieces of at most so many bytes that split no character."""
    pieces, start = [], 0
    while len(data) - start > longest:
        end = start + longest
        while data[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append((start, end))
        start = end
    return [*pieces, (start, len(data))]


def pack_documents(
    df: DataFrame,
    key: str,
    text: str,
    lengths: Lengths = Lengths(),
    *,
    block_items: int = 16384,
    block_bytes: int = 24 << 20,
    with_texts: bool = True,
) -> DataFrame:
    """Sequences: sequence_id, capacity, used, keys, starts, n_bytes and texts of their pieces.

    Every row of `df` is in the result, a null or empty text as a piece of no bytes, rows with
    null or equal keys each by itself; an empty table gives no sequences. `starts` and `n_bytes`
    say in bytes which part of a row's text a piece is. `used` counts bytes and end marks;
    `capacity` is the shortest permitted length that holds them. Without `with_texts`, texts are
    null. Other columns are not read.

    Rows are packed without a shuffle, in blocks: a block closes at `block_items` pieces or
    `block_bytes` bytes and is packed as a whole, so a task holds one block. Rows and bytes are
    counted first, and partitions are put together until there are no more of them than full blocks,
    so that many small files pack as few large ones. Only the few bins a block leaves part empty are
    lost against packing everything at once.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"sequence_id string, capacity int, used int, keys array<{kind}>, starts array<long>, "
        "n_bytes array<long>, texts array<string>"
    )
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    longest = lengths.permitted[-1] - 1
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    full = max(1, total["rows"] // block_items, (total["bytes"] or 0) // block_bytes)
    rows = rows.coalesce(full).select(F.spark_partition_id().alias("part"), "key", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple] = []
        held = blocks = 0
        part = None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, blocks
            bins = pack_items([len(p[2]) + 1 for p in pieces], lengths)
            for first in range(0, len(bins), 500):
                found = []
                for number, members in enumerate(bins[first : first + 500], first):
                    own = [pieces[i] for i in members]
                    used = sum(len(p[2]) + 1 for p in own)
                    found.append(
                        {
                            "sequence_id": f"{part}-{blocks}-{number}",
                            "capacity": lengths.least(used),
                            "used": used,
                            "keys": [p[0] for p in own],
                            "starts": [p[1] for p in own],
                            "n_bytes": [len(p[2]) for p in own],
                            "texts": [p[2].decode("utf-8", "surrogatepass") for p in own] if with_texts else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(found, schema=target)
            pieces.clear()
            held, blocks = 0, blocks + 1

        for batch in batches:
            parts, keys, texts = batch.columns
            if batch.num_rows:
                part = parts[0].as_py()
            for row_key, value in zip(keys, texts, strict=True):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                for start, end in cut(data, longest):
                    pieces.append((row_key.as_py(), start, data[start:end]))
                    held += end - start
                    if len(pieces) >= block_items or held >= block_bytes:
                        yield from close()
        if pieces:
            yield from close()

    return rows.mapInArrow(tidied(pack), schema)
