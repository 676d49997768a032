"""A Bloom filter of bounded size over 64-bit hashes: which records of a scan may be among the concerned ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the most words of 64 bits (32 MB): with more hashes the filter lets more records pass, none is lost.
BITS, MOST_WORDS = 16, 1 << 22


def sieve(hashes: DataFrame) -> np.ndarray:
    """The filter of a one-column table of bigints: built by counting, at most MOST_WORDS words reach the driver."""
    hashes = hashes.toDF("h")
    words, n = 1 << 8, hashes.count()
    while words < MOST_WORDS and words * 64 < n * BITS:
        words *= 2

    def place(k: int):
        bit = F.shiftrightunsigned("h", 40 + 8 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.struct(F.shiftrightunsigned("h", 8 * k).bitwiseAND(F.lit(words - 1)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit"))

    marked = hashes.select(F.explode(F.array(place(0), place(1))).alias("p")).groupBy("p.word").agg(F.bit_or("p.bit").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[marked.column(0).to_numpy()] = marked.column(1).to_numpy()
    return out


def may_hold(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64 ``hashes`` may be in the filter; never false for one that is."""
    h, last = hashes.view(np.uint64), np.uint64(len(filter_words) - 1)
    passed = np.ones(len(h), bool)
    for k in (0, 1):
        bit = (h >> np.uint64(40 + 8 * k)) & np.uint64(63)
        passed &= (filter_words.view(np.uint64)[((h >> np.uint64(8 * k)) & last).astype(np.int64)] >> bit) & np.uint64(1) == 1
    return passed
