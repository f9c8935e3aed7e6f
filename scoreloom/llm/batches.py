"""Arrow batches cut to a bounded number of text bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LIMIT = 2 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes in ``column`` (one longer row makes a slice of its own); no row is lost."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]
