"""Set membership of 64-bit keys with a bounded number of bits: what is in the set always passes, other keys rarely."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = (16, 29)  # least and most bits of a filter as powers of two (64 MiB); a full one only lets more through


@dataclass
class Filter:
    """Set bits at the low bits of 64-bit keys; no bits let everything through."""

    ones: np.ndarray | None = None
    bits: int = 0

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.ones is None:
            return np.ones(len(keys), bool)
        slot = keys & np.uint64((1 << self.bits) - 1)
        return (self.ones[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0

    @staticmethod
    def of(keys: DataFrame, n: int) -> Filter:
        """From the column ``key`` of n rows; words of 64 bits are put together by Spark, so at most 2**bits / 64 rows arrive."""
        bits = int(np.clip(np.ceil(np.log2(16 * max(n, 1))), *BITS))
        slot = F.col("key").bitwiseAND((1 << bits) - 1)
        got = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("ones")).toArrow()
        out = np.zeros((1 << bits) >> 6, np.uint64)
        out[got.column("at").to_numpy()] = got.column("ones").to_numpy().view(np.uint64)
        return Filter(out, bits)
