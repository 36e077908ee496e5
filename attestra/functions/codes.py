"""Whole numbers for the values of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes_of(column: pa.ChunkedArray | pa.Array, ordered: bool = False) -> np.ndarray:
    """Equal whole numbers for equal values, null among them; with ordered, in the order of the values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = pc.dictionary_encode(whole, null_encoding="encode")
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    indices = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not ordered:
        return indices
    rank = np.empty(len(found.dictionary), np.int64)
    rank[pc.array_sort_indices(found.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[indices]
