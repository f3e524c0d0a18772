"""Fixed-size numpy arrays (counting sketches, bitmaps) folded over all rows of a DataFrame.

The array's size is a constant, so what the driver receives and broadcasts does not grow with the data. Partitions fold
locally; the partial arrays are merged in two levels of at most FAN arrays a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEGMENTS = 16
FAN = 256


def segments(acc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partition's array as rows (seg, salt, part)."""
    width, salt = len(acc) // SEGMENTS, TaskContext.get().partitionId() // FAN
    parts = [acc[i * width : (i + 1) * width].tobytes() for i in range(SEGMENTS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([salt] * SEGMENTS, pa.int32()), pa.array(parts, pa.binary())], names=["seg", "salt", "part"])


def merged(parts: DataFrame, size: int, dtype: str, ufunc: np.ufunc) -> np.ndarray:
    """The array of which `parts` holds the partitions' rows."""
    width = size // SEGMENTS

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(width, dtype=dtype)
        for part in group["part"]:
            acc = ufunc(acc, np.frombuffer(part, dtype=dtype))
        return pd.DataFrame({"seg": [group["seg"].iloc[0]], "salt": [0], "part": [acc.tobytes()]})

    schema = "seg int, salt int, part binary"
    out = np.zeros(size, dtype=dtype)
    # At most one row per segment and FAN partitions: the second level brings it down to one per segment.
    for row in parts.groupBy("seg", "salt").applyInPandas(merge, schema).groupBy("seg").applyInPandas(merge, schema).collect():
        out[row.seg * width : (row.seg + 1) * width] = np.frombuffer(row.part, dtype=dtype)
    return out


def fold(df: DataFrame, size: int, dtype: str, update: Callable[[np.ndarray, pa.RecordBatch], None], ufunc: np.ufunc) -> np.ndarray:
    """Fold batches of `df` into an array of `size` with `update`; partial arrays are merged by `ufunc` (add, bitwise_or)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, seen = np.zeros(size, dtype=dtype), False
        for batch in batches:
            seen = True
            update(acc, batch)
        if seen:
            yield from segments(acc)

    return merged(df.mapInArrow(partial, "seg int, salt int, part binary"), size, dtype, ufunc)
