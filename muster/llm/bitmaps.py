"""Sets of hashes as bitmaps of fixed size: what is in the set is found, and some that is not.

They bound memory where a set grows with the data. A bitmap is a numpy array of bytes; a 64-bit hash
stands at its highest bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = 32_768  # bits in one of Spark's bitmaps


def empty(bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits, at least one part of Spark's."""
    if not 15 <= bits <= 31:
        raise ValueError(f"a bitmap has 2^15 to 2^31 bits, got {bits}")
    return np.zeros(1 << (bits - 3), np.uint8)


def held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) is in the set, or shares its bit with one that is."""
    places = hashes >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def with_hashes(bitmap: np.ndarray, df: DataFrame, hashed: Column) -> np.ndarray:
    """The bitmap with the hashes (longs) of a column.

    Parts of 4 KB come to the driver one by one, at most as many as the bitmap has.
    """
    place = F.shiftrightunsigned(hashed, 64 - (len(bitmap).bit_length() + 2)) + 1
    parts = (
        df.select(place.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    )
    marked = bitmap.copy()
    for row in parts.toLocalIterator():
        start = (row["part"] - 1) * (_PART // 8)
        marked[start : start + _PART // 8] |= np.frombuffer(row["bitmap"], np.uint8)
    return marked
