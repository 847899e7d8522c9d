"""Image operators in Python over a full Arrow batch: memory of a few times the batch, and the same rows in small batches and in large ones."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.util import PythonEvalType

from sparkloom.functions import binarize, images, windows

ROWS, SIDE = 10_000, 8
MB = 1 << 20


def batch(n=ROWS):
    pixels = np.random.default_rng(5).random(n * SIDE * SIDE)
    side = pa.array(np.full(n, SIDE, np.int32))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SIDE * SIDE, pa.int32()), pa.array(pixels)), side, side


def run(udf, *args):
    """(result, peak MB) of a UDF of Arrow arrays or of pandas series."""
    if udf.evalType != PythonEvalType.SQL_SCALAR_ARROW_UDF:
        args = [a.to_pandas() for a in args]
    tracemalloc.start()
    made = udf.func(*args)
    peak = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    return made, peak


def extra(n, *values):
    return [pa.array([v] * n) for v in values]


CASES = [("derivatives", windows._filtered, (0.0, "ando5m_image2D")), ("smoothing", windows._filtered, (0.0, "gaussian25_image2D")), ("morphology", windows._shaped, (3.0, "opening_2D")), ("binary", binarize._local, (5,)), ("cooccurrences", windows._glcm_measured, (1.0, 16.0))]


@pytest.mark.parametrize("name, udf, args", CASES, ids=[c[0] for c in CASES])
def test_peak(name, udf, args):
    made, peak = run(udf, *batch(), *extra(ROWS, *args))
    # The batch's pixels are 4.9 MB.
    assert len(made) == ROWS and peak < 22, peak


@pytest.mark.parametrize("name, udf, args", CASES, ids=[c[0] for c in CASES])
def test_pieces(name, udf, args):
    """Images in pieces and alone, of several shapes, missing and empty ones between them."""
    rng = np.random.default_rng(7)
    shapes = [(4, 6), (6, 4), (5, 5)] * 700
    rows = [None if k % 50 == 3 else [] if k % 50 == 7 else rng.random(h * w).tolist() for k, (h, w) in enumerate(shapes)]
    h, w = (pa.array([s[i] for s in shapes], pa.int32()) for i in (0, 1))
    pixels = pa.array(rows, pa.list_(pa.float64()))
    together = udf.func(pixels, h, w, *extra(len(rows), *args)).to_pylist()
    for k in (0, 1, 2, 3, 7, 1000, 1001, 1500, 2099):
        alone = udf.func(pixels.slice(k, 1), h.slice(k, 1), w.slice(k, 1), *extra(1, *args)).to_pylist()[0]
        assert (alone is None) == (together[k] is None) == (not rows[k])
        if alone:
            np.testing.assert_allclose([list(x.values()) if isinstance(x, dict) else x for x in together[k]], [list(x.values()) if isinstance(x, dict) else x for x in alone], atol=1e-12)


def test_weights_by_distance():
    """Moffat's blur and the difference of Gaussians against the sums of the single columns."""
    p = np.random.default_rng(9).random((3, 7, 6))
    for width in images.MOFFAT:
        d = np.add.outer((np.arange(width) - width // 2) ** 2, (np.arange(width) - width // 2) ** 2)
        weight = (1 + d / 4.0) ** -1.5
        grid = np.pad(p, ((0, 0), (width // 2,) * 2, (width // 2,) * 2), mode="edge")
        near = np.lib.stride_tricks.sliding_window_view(grid, (width, width), axis=(1, 2))
        np.testing.assert_allclose(windows.moffat(p, 2.0, 1.5, width // 2), np.einsum("bijkl,kl->bij", near, weight) / weight.sum(), atol=1e-12)


@pytest.mark.parametrize("half", [2, 12])
def test_wide_blurs(half):
    """Small images beneath a wide kernel: what is added around them, 16 times their pixels, isn't held for all of a piece."""
    grids, kernel = np.random.default_rng(11).random((1024, SIDE, SIDE)), windows._square(half, lambda d: 1 / (1 + d))
    tracemalloc.start()
    made = windows.correlate(grids, kernel, 0)
    peak = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    alone = np.concatenate([windows.correlate(grids[k : k + 1], kernel, 0) for k in (0, 500, 1023)])
    # The images are 0.5 MB.
    assert peak < 2 and (made[[0, 500, 1023]] == alone).all(), peak


@pytest.mark.parametrize("half", [2, 6])
def test_wide_diamonds(half):
    """As test_wide_blurs, for diamonds; against the least of all pixels so near."""
    grids = np.random.default_rng(13).random((1024, SIDE, SIDE))
    tracemalloc.start()
    made = windows.erode(grids, half)
    peak = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    at = np.indices((SIDE, SIDE)).reshape(2, -1)
    near = np.abs(at[:, :, None] - at[:, None]).sum(axis=0) <= half
    for k in (0, 500, 1023):
        assert (made[k].ravel() == np.where(near, grids[k].ravel(), np.inf).min(axis=1)).all()
    assert peak < 1.8, peak
