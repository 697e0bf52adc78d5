"""Reading vector columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def finite_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and float64 values of the vectors that are not null or empty and
    hold neither null nor non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    end = np.cumsum(length)
    rows, out = [], []
    for i in np.flatnonzero(length):
        v = values[end[i] - length[i]:end[i]]
        if np.isfinite(v).all():
            rows.append(i)
            out.append(v)
    return np.array(rows, np.int64), out


def stacked(blobs: list[bytes], dtype=np.float64) -> np.ndarray:
    """Vectors kept as bytes, as a matrix; shorter ones are filled with zeros."""
    size = np.array([len(b) for b in blobs])
    if len(size) and (size == size[0]).all():
        return np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1)
    out = np.zeros((len(blobs), int(size.max(initial=0)) // np.dtype(dtype).itemsize), dtype)
    for row, b in zip(out, blobs):
        v = np.frombuffer(b, dtype)
        row[:len(v)] = v
    return out
