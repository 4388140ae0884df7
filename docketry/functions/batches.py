"""Arrow batches in pieces, so that a worker holds the Python objects of few rows at a time, however many rows Spark sends at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a piece; bytes that it ends at, once it has a row.
ROWS, BYTES = 256, 1 << 22


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Every row of the batches, in order, in pieces of at most ROWS rows and about BYTES in the column (texts or bytes)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        start, held = 0, 0
        for k, size in enumerate(sizes):
            if k > start and (k - start >= ROWS or held + size > BYTES):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        yield batch.slice(start)
