"""Arrow batches in pieces, so that what a task's Python holds follows the size of a piece, not the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a piece, about.
PIECE_BYTES = 1_000_000


def pieces(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about PIECE_BYTES of text in a column each; one slice at least, of one row at least."""
    if batch.num_rows < 2:
        yield batch
        return
    total = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + PIECE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def by_pieces(work: Callable[..., pa.Array], texts: pa.Array, *more: pa.Array) -> pa.Array:
    """``work`` over the pieces of a column of texts (and the columns beside it), its results run together."""
    whole = pa.RecordBatch.from_arrays([texts, *more], names=[str(i) for i in range(len(more) + 1)])
    return pa.concat_arrays([work(*part.columns) for part in pieces(whole)])
