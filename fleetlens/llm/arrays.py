"""Array helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20


def giving_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run``, after which the worker returns to the system what it has freed. Spark keeps an idle
    worker for a minute, beside the tasks of the next steps; both allocators would keep its pages."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc
        if trim:
            trim(0)
    return whole


def offsets(cells: pa.Array) -> np.ndarray:
    """Where the cells of a string or binary array begin and end in its bytes."""
    wide = cells.type in (pa.large_string(), pa.large_binary())
    every = np.frombuffer(cells.buffers()[1], np.int64 if wide else np.int32)
    return every[cells.offset:cells.offset + len(cells) + 1]


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        text = batch.column(column)
        ends = offsets(text)
        at = 0
        while at < len(text):
            to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
            to = max(at + 1, min(to, len(text)))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and the ends: row i is data[ends[i]:ends[i+1]]."""
    ends = offsets(text)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[ends[0]:ends[-1]], (ends - ends[0]).astype(np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows values[ends[i]:ends[i+1]] as binary cells, little-endian."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1,
        [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def distinct_slices(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """``data`` cut at ``starts`` (and its end): the number of each slice's content, the contents."""
    ends = np.append(starts, len(data)).astype(np.int32)
    cut = pa.Array.from_buffers(pa.binary(), len(starts),
                                [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cut.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
