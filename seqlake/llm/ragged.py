"""Ragged numpy arrays: many short sequences one after the other in a flat array."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def spread(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions at[0], at[0]+1, .. (length[0] of them), then those from at[1] on, and so on."""
    ends = np.cumsum(length)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(at - (ends - length), length)


def offsets_of(length: np.ndarray) -> np.ndarray:
    """Where each sequence begins, with the end of the last one."""
    out = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=out[1:])
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls: its UTF-8 values, copied only if Arrow must."""
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Rows regrouped into tables of about ``limit`` bytes of ``column`` (a longer row is a table of its own)."""
    held, size = [], 0
    for batch in batches:
        lengths = np.diff(text_buffer(batch.column(column))[1])
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(lengths[at:]), limit - size, side="right")
            if room:
                held.append(batch.slice(at, room))
                size += int(lengths[at:at + room].sum())
                at += int(room)
            elif held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            else:
                yield pa.Table.from_batches([batch.slice(at, 1)])
                at += 1
    if held:
        yield pa.Table.from_batches(held)
