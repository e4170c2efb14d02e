"""Vectors as whole numbers: which rows count, and packed forms that travel between Spark and tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole components lie within this; larger ones become it, so that sums of 64 squared differences stay a long.
MOST = 1 << 27
SCALE = 256.0


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, infinite or not a number."""
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def packed(column: pa.ListArray) -> pa.Array:
    """floor(256 * x) of each component as four bytes, a vector as one binary."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets, np.int64)
    values = np.asarray(column.values, np.float64)[ends[0] : ends[-1]]
    whole = np.clip(np.floor(SCALE * values), -MOST, MOST).astype("<i4")
    offsets = ((ends - ends[0]) * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.tobytes())])


def matrix(blobs: list[bytes]) -> np.ndarray:
    """Packed vectors as the rows of a matrix; a shorter one is filled up with zeros."""
    sizes = {len(b) for b in blobs}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), -1).astype(np.int64)
    out = np.zeros((len(blobs), max(sizes, default=0) // 4), np.int64)
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // 4] = np.frombuffer(b, "<i4")
    return out
