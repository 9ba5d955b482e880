"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], column: str | list[str], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose ``column``, or columns together, hold about ``limit`` bytes, one row at least."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        import pyarrow.compute as pc

        sizes = [pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype("int64") for c in ([column] if isinstance(column, str) else column)]
        ends = np.cumsum(sum(sizes))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to
