"""A filter of hashes, of one size whatever it holds, to send to all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workers import tidy

#: So many bits (2 MB). More hashes than they can tell apart let more rows through than need to, and never fewer.
FILTER_BITS = 24


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits that are set for each 64-bit hash in the column. They come by words of 32, in at most 2 ** FILTER_BITS / 32 rows."""
    slot = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned(`{column}`, {64 - FILTER_BITS}) & 31))")
    found = hashes.groupBy(F.shiftright(slot, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    at = (hashes.astype(np.uint64, copy=False) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0


def passing(sent):
    """Of rows with id_key, those that may be in the filter that was sent."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(passes(sent.value, batch.column("id_key").to_numpy().view(np.uint64))), pa.int64()))

    return run
