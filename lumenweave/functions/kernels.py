"""Arrow batches to NumPy blocks and back, without Python objects for single numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spectra_block(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers as rows; NaN for NULL entries and for rows that are NULL or of another length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    out = np.full((n, width), np.nan)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    full = lengths == width
    if full.all():
        kept = column
    elif full.any():
        kept = column.filter(pa.array(full))
    else:
        return out
    out[full] = kept.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return out


def block_of_spectra(block: np.ndarray, present: np.ndarray | None = None) -> pa.ListArray:
    """Rows as arrays of numbers, NaN as NULL; rows that are not ``present`` are NULL."""
    n, width = block.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    values = pa.array(np.ascontiguousarray(block).ravel(), from_pandas=True)
    if present is None or present.all():
        return pa.ListArray.from_arrays(offsets, values)
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~present))
