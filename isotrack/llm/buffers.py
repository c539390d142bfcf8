"""Concatenated UTF-8 buffers of Arrow string columns, and slices of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4_000_000  # bytes that are worked on at once; arrays over one slice take some fifty times as much


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 places where they begin and end; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def runs(ends: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges (first, last) of items, whose ends are ascending places, that cover at most ``limit`` places, or are a single item."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, last
        first = last


def gathered(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of the stretches that begin at ``first`` and have ``count`` items, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))
