"""A Bloom filter over 64-bit hashes that Spark builds in slices, for use in numpy.

It never loses a value. Its size follows the count of values up to ``MOST`` bits; beyond that it lets more through,
so it may only spare work that an exact join does afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 20, 1 << 30  # bits: 128 KiB to 128 MiB
PER_VALUE = 16
#: One odd factor a probe.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
PROBES = len(_FACTORS)
_SLICE = 1 << 19


class Bloom:
    """``bits`` is a power of two; each hash sets or asks ``PROBES`` places that its own bits name."""

    def __init__(self, data: np.ndarray):
        self.data, self.log = data, (8 * len(data)).bit_length() - 1

    def __contains__(self, value: int) -> bool:
        return bool(self.holds(np.array([value], np.uint64))[0])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be among the values; later probes ask only for those that are left."""
        out = np.zeros(len(hashes), bool)
        at = np.arange(len(hashes))
        for probe in range(PROBES):
            bit = place(hashes[at], probe, self.log)
            at = at[(self.data[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
        out[at] = True
        return out


def place(hashes: np.ndarray, probe: int, log: int) -> np.ndarray:
    """The bit that a probe of each hash names: the top bits of its product with the probe's factor."""
    return (hashes * np.uint64(_FACTORS[probe]) >> np.uint64(64 - log)).astype(np.int64)


def build(hashes: DataFrame, column: str, n: int) -> Bloom:
    """The filter of about ``n`` hashes. Tasks find the bits and pack slices of 64 KiB, of which alone the driver gets any."""
    bits = LEAST
    while bits < MOST and bits < PER_VALUE * n:
        bits *= 2
    log = bits.bit_length() - 1

    def probes(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([place(h, p, log) for p in range(PROBES)])))], names=["bit"])

    def pack(t: pa.Table) -> pa.Table:
        bit = t.column("bit").to_numpy()
        own = np.zeros(_SLICE, np.uint8)
        own[bit % _SLICE] = 1
        return pa.table({"slice": pa.array([int(bit[0]) // _SLICE], pa.int64()), "data": pa.array([np.packbits(own).tobytes()], pa.binary())})

    found = hashes.where(F.col(column).isNotNull()).select(column).mapInArrow(probes, "bit long").distinct()
    data = np.zeros(bits // 8, np.uint8)
    for row in found.groupBy(F.floor(F.col("bit") / _SLICE)).applyInArrow(pack, "slice long, data binary").toLocalIterator():
        data[row.slice * _SLICE // 8 : (row.slice + 1) * _SLICE // 8] = np.frombuffer(row.data, np.uint8)
    return Bloom(data)
