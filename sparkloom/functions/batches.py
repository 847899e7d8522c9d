"""Images of an Arrow batch: pixels as views of the batch's own buffer, in pieces of bounded size, and results as one buffer.

A worker that makes an object of each image, list or number holds many times the batch; these hold the batch, its result
and one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pixels, or counted pairs of levels, that are worked on at once.
CELLS = 1 << 16


class Lists:
    """The lists of an Arrow array of numbers, without copies where it has no missing numbers."""

    def __init__(self, array: pa.Array):
        self.flat = array.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
        ends = array.offsets.to_numpy(zero_copy_only=False)
        self.starts, self.sizes = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
        self.valid = array.is_valid().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.starts)

    def __iter__(self) -> Iterator[np.ndarray | None]:
        for start, size, valid in zip(self.starts.tolist(), self.sizes.tolist(), self.valid.tolist(), strict=True):
            yield self.flat[start : start + size] if valid else None

    def grids(self, rows: np.ndarray, h: int, w: int) -> np.ndarray:
        """(image, column, row) of some rows: pixels stand column by column."""
        if (self.sizes[rows] != h * w).any():
            raise ValueError("an image has more or fewer pixels than its sides tell")
        return self.flat[self.starts[rows][:, None] + np.arange(h * w)].reshape(len(rows), w, h)


def pieces(pixels: Lists, *keys: pa.Array, cells: int = CELLS) -> Iterator[tuple[tuple, np.ndarray]]:
    """(keys, rows): the rows of a batch with equal keys, in pieces of about ``cells`` pixels; rows without an image or a key are left out."""
    held, codes, tables = pixels.valid & (pixels.sizes > 0), np.zeros(len(pixels), np.int64), []
    parts = []
    for key in keys:
        coded = key.dictionary_encode()
        tables.append(coded.dictionary.to_pylist())
        part = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        held &= ~np.isin(part, [-1, *(i for i, x in enumerate(tables[-1]) if x is None or x != x)])
        parts.append(part)
        codes = np.unique(codes * (len(tables[-1]) + 1) + part + 1, return_inverse=True)[1].reshape(-1)
    order = np.flatnonzero(held)
    order = order[np.argsort(codes[order], kind="stable")]
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(rows):
            step = max(1, cells // int(pixels.sizes[rows[0]]))
            for lo in range(0, len(rows), step):
                yield tuple(t[p[rows[0]]] for t, p in zip(tables, parts, strict=True)), rows[lo : lo + step]


def like(pixels: Lists, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Lists as long as the images', from (rows, their values); NULL for the other rows and for NaN."""
    made, sizes = np.zeros(len(pixels), bool), np.where(pixels.valid, pixels.sizes, 0)
    ends = np.r_[0, np.cumsum(sizes)]
    flat = np.zeros(ends[-1])
    for rows, values in found:
        made[rows] = True
        flat[ends[rows][:, None] + np.arange(sizes[rows[0]])] = values.reshape(len(rows), -1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, from_pandas=True), mask=pa.array(~made))


def rows_of(n: int, width: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Lists of ``width`` numbers, from (rows, their values); NULL for the other rows and for NaN."""
    made, flat = np.zeros(n, bool), np.zeros((n, width))
    for rows, values in found:
        made[rows], flat[rows] = True, values
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(flat.reshape(-1), from_pandas=True), mask=pa.array(~made))
