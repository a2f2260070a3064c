"""Arrow helpers for functions that run over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from batches sorted by ``by``, cut only between two groups."""
    kept: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch[c] for c in by]
        if n + len(batch) >= rows and kept:
            key = list(zip(*[c.to_pylist() for c in cols], strict=True))
            at = next((i for i in range(len(key)) if key[i] != (key[i - 1] if i else last)), None)
            if at is not None:
                yield pa.Table.from_batches([*kept, batch.slice(0, at)]).combine_chunks()
                kept, n, batch = [], 0, batch.slice(at)
        last = tuple(batch[c][-1].as_py() for c in by)
        kept.append(batch)
        n += len(batch)
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table[name]
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binaries(data: bytes | memoryview | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array from joined data and the length of each value."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
