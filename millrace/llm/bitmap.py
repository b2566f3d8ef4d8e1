"""A bitmap of fixed size over 64-bit hashes: a filter that never loses a value and may let others through.

It is used to keep rows at home that an exact join or count would drop anyway. Its size is ``BITS`` whatever the
input's; where the hashes outnumber the bits it lets nearly everything through, which costs time and no results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
_SHIFT = 64 - (BITS.bit_length() - 1)
_SLICE = 1 << 19


def gather(hashes: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of hashes, ``BITS / 8`` bytes; the driver gets slices of 64 KiB, which tasks have packed."""

    def pack(t: pa.Table) -> pa.Table:
        bit = t.column("bit").to_numpy()
        own = np.zeros(_SLICE, np.uint8)
        own[bit % _SLICE] = 1
        return pa.table({"slice": pa.array([int(bit[0]) // _SLICE], pa.int64()), "data": pa.array([np.packbits(own).tobytes()], pa.binary())})

    bits = hashes.select(F.shiftrightunsigned(column, _SHIFT).alias("bit")).distinct()
    out = np.zeros(BITS // 8, np.uint8)
    for row in bits.groupBy(F.floor(F.col("bit") / _SLICE)).applyInArrow(pack, "slice long, data binary").collect():
        out[row.slice * _SLICE // 8 : (row.slice + 1) * _SLICE // 8] = np.frombuffer(row.data, np.uint8)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be in the bitmap."""
    bit = (hashes >> np.uint64(_SHIFT)).astype(np.int64)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def wide(*columns: Column | str) -> tuple[Column, Column]:
    """Two 64-bit hashes of the columns, by which rows may be told apart at any size of input."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5851F42D4C957F2D), *columns)
