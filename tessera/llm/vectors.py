"""Embedding columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, float64 matrix) per dimension; null ids, null or empty vectors, and vectors that
    hold null or non-finite components are left out."""
    size = np.asarray(vectors.value_lengths().fill_null(0))
    ok = np.asarray(ids.is_valid()) & (size > 0)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.asarray(flat.is_null()) | ~np.isfinite(values)
    ok[row[bad]] = False
    names = np.asarray(ids.fill_null(0))
    start = np.cumsum(size) - size
    out = []
    for d in np.unique(size[ok]):
        on = np.flatnonzero(ok & (size == d))
        out.append((names[on], values[start[on][:, None] + np.arange(d)]))
    return out
