"""Walking Arrow batches of texts in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def pieces(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts) with about ``most`` bytes of text at a time, one row at least; null texts are ''."""
    col = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    at = 0
    while at < len(lengths):
        end, total = at, 0
        while end < len(lengths) and (end == at or total + lengths[end] <= most):
            total += lengths[end]
            end += 1
        part = batch.slice(at, end - at)
        yield part, [t if t is not None else "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
        at = end
