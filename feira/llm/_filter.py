"""A bit filter of fixed size over 64-bit hashes, built in Spark.

It keeps all rows whose hash is in a set and a few others, and can be
broadcast whatever the size of the set; an exact join follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24


def positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64((1 << FILTER_BITS) - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """The filter of the column ``hash``, as 2^FILTER_BITS / 64 words: two bits
    per hash, merged in Spark; at most that many words reach the driver."""
    mask = (1 << FILTER_BITS) - 1
    bit = F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask)))
    words = (hashes.select("hash").distinct().select(bit.alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = positions(h)
    return bits[one] & bits[two]
