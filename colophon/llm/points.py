"""Arrow text as code-point arrays: one decode per batch, rows by offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, start of each string with the end appended). NULL counts as ''."""
    arr = pa.concat_arrays([arr.cast(pa.large_string())])
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64, n + 1 + arr.offset)[arr.offset :]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[lo:hi]
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cp, lead[offsets - lo]


def pieces(batches, column: str, limit: int = 2_000_000):
    """Sub-batches of whole rows with at most ``limit`` bytes of text (one row if it is longer), so that work arrays stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0)).astype(np.int64)
        part = np.cumsum(size) // limit
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [b.num_rows]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield b.slice(lo, hi - lo)
