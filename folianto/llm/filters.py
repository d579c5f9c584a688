"""A filter of wanted hashes that goes along with a scan: what isn't wanted is left where it was read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and at most. A fuller filter lets more pass that isn't wanted: it costs time, never a result.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28


def hash_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits set by the first bits of about ``n`` hashes (the one column of ``hashes``), put together by the executors."""
    bits = 1 << min(MOST_FILTER_BITS.bit_length() - 1, max(16, (FILTER_BITS * max(1, n)).bit_length()))
    h = hashes.select(F.shiftrightunsigned(hashes.columns[0], 65 - bits.bit_length()).alias("h"))
    words = h.groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes (unsigned) that may be wanted."""
    at = h >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return np.flatnonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
