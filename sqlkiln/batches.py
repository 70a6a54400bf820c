"""Runs of rows of Arrow batches.  A batch holds up to 10,000 rows of any
length, so what is made of it at once is bounded by bytes, not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def piece_bounds(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows that weigh at most ``most`` besides one
    row; every row is in one run."""
    if len(weights):
        run = np.cumsum(weights, dtype=np.int64) // most
        ends = [*(np.flatnonzero(np.diff(run)) + 1).tolist(), len(weights)]
        yield from zip([0, *ends], ends)


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of texts, lengths of lists; 0 for null."""
    of = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return pc.fill_null(of(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def in_pieces(make: Callable[[pa.Array], pa.Array], column: pa.Array, most: int, least: int = 0) -> Iterator[pa.Array]:
    """``make`` over runs of rows; a row weighs its size, ``least`` at least.
    An empty column is made as it is."""
    if not len(column):
        yield make(column)
    for a, b in piece_bounds(np.maximum(sizes(column), least), most):
        yield make(column.slice(a, b - a))
