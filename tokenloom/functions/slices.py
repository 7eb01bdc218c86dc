"""Slices of Arrow batches by the length of their lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: List elements of a slice, about.
ELEMENTS = 1 << 18


def list_slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` list elements each, so that working memory per element follows the
    slice, not Spark's batch. A single row may be longer: it is never cut."""
    most = most or ELEMENTS
    ends, start = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
