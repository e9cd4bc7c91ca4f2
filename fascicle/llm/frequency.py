"""How often hashed items occur over a whole corpus, in a table of fixed size.

Counters are shared by the items that fall on them, so a count is an upper bound. What
is common is told against the usual counter, so at any size of input it is what makes
more than some ``2 / TABLE`` (four millionths) of all occurrences: whatever is rarer may
meet in one task, and that is a share of the input that a task can hold. The tables of
all tasks are summed on the executors, part by part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 19
TABLE, PARTS = 1 << BITS, 16


def counter(hashes: np.ndarray) -> np.ndarray:
    """The counter of each 64-bit hash."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def packed(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(part, counts) of one task's table, to be summed by :func:`levels`."""
    return pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.split(total, PARTS)], pa.binary())


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(blob), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def levels(counts: DataFrame) -> np.ndarray:
    """For each counter its count as a power of two over twice the usual one, from rows (part, counts)."""
    rows = counts.select("part", "counts").repartition(PARTS, "part").mapInArrow(_sum, "part int, counts binary").collect()
    table = np.zeros(TABLE, np.int64)
    for part, blob in rows:
        table[part * (TABLE // PARTS) : (part + 1) * (TABLE // PARTS)] = np.frombuffer(blob, "<i8")
    usual = max(4.0, 2 * float(np.median(table)))
    return np.clip(np.log2(np.maximum(table, 1) / usual), 0, 31).astype(np.uint8)
