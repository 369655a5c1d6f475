"""A fixed-size filter of 64-bit keys, for dropping rows inside a task before a shuffle join.

The filter is a Bloom filter with two probes.  Its size follows from the number of keys but never exceeds
``max_bits``, so what is broadcast is bounded whatever the data; a fuller filter only lets more rows
through to the exact join that always follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KeyFilter:
    """Tells keys that are certainly absent from the rest.  Pickles as one array."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits  # uint64 words, a power of two of them

    def __contains__(self, key: int) -> bool:
        return bool(self.maybe(np.array([key], np.int64))[0])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set."""
        keys = keys.astype(np.int64, copy=False).view(np.uint64)
        mask = np.uint64(len(self.bits) * 64 - 1)
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            bit = (keys >> np.uint64(shift)) & mask
            out &= (self.bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def key_filter(keys: DataFrame, column: str, count: int, max_bits: int = 1 << 26) -> KeyFilter:
    """The filter of all keys in a BIGINT column of well-mixed hashes; ``count`` is how many there are.

    Bits are or-ed together by a Spark aggregate, whose result has at most max_bits / 64 rows.
    """
    size = 1 << 16
    while size < min(max_bits, 12 * count):
        size *= 2
    probes = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(size - 1)) for s in (0, 32))))
    words = (
        keys.select(probes.alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return KeyFilter(bits)
