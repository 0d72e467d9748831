"""A filter of fixed size for keys that occur more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (8 MB), whatever the input; two are set for each key. A fuller filter lets more through and loses nothing: exact counts follow.
BITS = 26


def positions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key (uint64)."""
    return tuple(((keys * np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (uint64) may be in the filter."""
    one, two = positions(keys)
    return ((bits[one >> 6] >> (one & 63).astype(np.uint64)) & (bits[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def repeated(keys: DataFrame) -> np.ndarray:
    """Filter of the keys (h, n: key as long and how often a task saw it) that occur twice or more. Spark makes its words; only those reach the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate(positions(batch.column(0).to_numpy().view(np.uint64))))
            word, start = np.unique(bit >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), start) if len(bit) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    several = keys.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    words = several.mapInArrow(place, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bits
