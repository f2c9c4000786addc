"""Arrow batches in pieces of bounded bytes, for tasks that make Python objects of a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one piece; a longer row is a piece by itself.
PIECE = 1 << 18


def pieces(batches: Iterable[pa.RecordBatch], *columns: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order; a piece holds no more than ``most`` bytes of the text or array ``columns``, or one row.

    Spark's batches hold ten thousand rows, whatever these weigh.
    """
    for batch in batches:
        ends = 0
        for c in columns:
            ends = ends + _ends(batch.column(c))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(ends.searchsorted(before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def _ends(column: pa.Array):
    """Bytes up to the end of each row, 8 for an array's element besides its text."""
    import numpy as np

    size = np.asarray(pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0), np.int64)
    if not pa.types.is_list(column.type):
        return np.cumsum(size)
    ends = np.cumsum(size)
    flat = column.flatten()
    inner = _ends(flat) if pa.types.is_string(flat.type) or pa.types.is_list(flat.type) else np.zeros(len(flat), np.int64)
    return 8 * ends + np.concatenate([[0], inner])[ends]
