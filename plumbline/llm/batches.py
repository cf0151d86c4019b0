"""Arrow batches in small slices, so that a Python worker holds few rows as Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Every row of the batches in order, at most ``rows`` at once; an empty batch stays one empty slice."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)
