"""A Bloom bitmap of 64-bit values, built by Spark and small enough to broadcast.

It has ``each`` bits or more a value, from 2**``LEAST`` up to 2**``MOST``, which are 16 MB.  A bitmap of more values
fills up and lets others through; whoever uses it joins exactly afterwards, so results never depend on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 20, 27


def build(values: DataFrame, column: str, each: int = 64) -> np.ndarray:
    """Bitmap of the non-null longs in ``column``: at most ``2**bits / 64`` rows reach the driver."""
    bits = min(max((each * values.count()).bit_length(), LEAST), MOST)
    low = (1 << bits) - 1
    probes = F.array(F.col(column).bitwiseAND(F.lit(low)), F.shiftrightunsigned(column, 64 - bits))
    words = (
        values.where(F.col(column).isNotNull())
        .select(F.explode(probes).alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
        .toArrow()
    )
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out


def has(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the uint64 values may be in the bitmap (never misses one that is)."""
    bits = len(bitmap).bit_length() - 1 + 6
    one = np.uint64(1)

    def test(at: np.ndarray) -> np.ndarray:
        return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & one != 0

    found = test(values & np.uint64((1 << bits) - 1))
    hit = np.flatnonzero(found)
    found[hit] = test(values[hit] >> np.uint64(64 - bits))
    return found
