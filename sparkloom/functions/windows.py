"""Windows over pixels for programs: the window operators of ``images`` in numpy passes over Arrow batches.

A program writes these operators by the ones here (``lower``), which take all images of one shape and parameter in a
batch at once, piece by piece: derivatives, blurs and morphology by shifted sums and extremes, Gaussian blurs as two
passes along lines; the co-occurrences of an image are counted once for all ten properties and five summaries, a region is cut once for all its
numbers. As single columns, outside programs, the operators stay expressions, which nest in lambdas. Both give the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..registry import REGISTRY, op
from . import images
from .batches import CELLS, Lists, like, pieces, rows_of


def _places(n: int, reach: int, mode: float) -> np.ndarray:
    """Where the places from -reach to n - 1 + reach lead: to the edge, around, or mirrored."""
    at = np.arange(-reach, n + reach)
    if mode == 0:
        return np.clip(at, 0, n - 1)
    return at % n if mode < 0 else np.minimum(at % (2 * n), 2 * n - 1 - at % (2 * n))


def correlate(grids: np.ndarray, kernel: list[tuple[int, int, float]], mode: float) -> np.ndarray:
    """Sum over (row offset, column offset, weight) of the shifted images; about CELLS pixels at once, what is added around the images counted in."""
    _, w, h = grids.shape
    down, across = max(abs(r) for r, _, _ in kernel), max(abs(c) for _, c, _ in kernel)
    columns, rows = _places(w, across, mode)[:, None], _places(h, down, mode)
    total = np.zeros_like(grids)
    step = max(1, CELLS // (columns.size * rows.size))
    for lo in range(0, len(grids), step):
        wide, some = grids[lo : lo + step, columns, rows], total[lo : lo + step]
        for r, c, v in kernel:
            some += v * wide[:, across + c : across + c + w, down + r : down + r + h]
    return total


def normalized(grids: np.ndarray) -> np.ndarray:
    """Each image from its least to its greatest value as 0 to 1; what isn't finite counts as 0, a constant image gives 0."""
    clean = np.where(np.isfinite(grids), grids, 0.0)
    lo, hi = clean.min(axis=(1, 2), keepdims=True), clean.max(axis=(1, 2), keepdims=True)
    return np.divide(clean - lo, hi - lo, out=np.zeros_like(clean), where=hi > lo)


def _line(sigma: float, half: int, down: bool) -> list[tuple[int, int, float]]:
    return [(k - half, 0, v) if down else (0, k - half, v) for k, v in enumerate(images._gauss(sigma, half))]


def _filters() -> dict[str, Callable[[np.ndarray, float], np.ndarray]]:
    found: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {}
    for name, rows in images.DERIVATIVES.items():
        x, y = images._grid(rows), images._grid(images._transposed(rows))
        found[f"{name}x_image2D"] = lambda g, m, x=x: correlate(g, x, m)
        found[f"{name}y_image2D"] = lambda g, m, y=y: correlate(g, y, m)
        found[f"{name}m_image2D"] = lambda g, m, x=x, y=y: np.hypot(correlate(g, x, m), correlate(g, y, m))
    for width, sigma in ((5, 1), (9, 2), (13, 3), (17, 4), (25, 6)):
        found[f"gaussian{width}_image2D"] = lambda g, m, s=sigma, n=width // 2: correlate(correlate(g, _line(s, n, False), m), _line(s, n, True), m)
    found["laplacian3_image2D"] = lambda g, m: correlate(g, images._grid([[0, 1, 0], [1, -4, 1], [0, 1, 0]]), m)
    return found


FILTERS = _filters()


@F.arrow_udf(ArrayType(DoubleType()))
def _filtered(pixels: pa.Array, h: pa.Array, w: pa.Array, mode: pa.Array, name: pa.Array) -> pa.Array:
    held = Lists(pixels)
    return like(held, ((rows, normalized(FILTERS[which](held.grids(rows, height, width), border))) for (height, width, border, which), rows in pieces(held, h, w, pc.sign(mode), name)))


def _square(half: int, weight: Callable[[float], float]) -> list[tuple[int, int, float]]:
    """Weights by the squared distance, which add up to 1."""
    near = [(r, c, weight(r * r + c * c)) for c in range(-half, half + 1) for r in range(-half, half + 1)]
    total = sum(v for _, _, v in near)
    return [(r, c, v / total) for r, c, v in near]


def dog(grids: np.ndarray, s1: float, s2: float) -> np.ndarray:
    wide = lambda s: correlate(grids, _square(4, lambda d: math.exp(-d / (2 * s * s))), 0)
    return wide(s1) - wide(s2)


def moffat(grids: np.ndarray, alpha: float, beta: float, half: int) -> np.ndarray:
    return correlate(grids, _square(half, lambda d: (1 + d / (alpha * alpha)) ** -beta), 0)


@F.arrow_udf(ArrayType(DoubleType()))
def _weighed(pixels: pa.Array, h: pa.Array, w: pa.Array, a: pa.Array, b: pa.Array, width: pa.Array) -> pa.Array:
    """Moffat's blur in a square of a width; the difference of Gaussians if that is 0."""
    held = Lists(pixels)
    made = lambda g, x, y, n: moffat(g, x, y, n // 2) if n else dog(g, x, y)
    return like(held, ((rows, normalized(made(held.grids(rows, height, width), x, y, n))) for (height, width, x, y, n), rows in pieces(held, h, w, a, b, width)))


def _diamond(grids: np.ndarray, half: int, pick: np.ufunc, beyond: float) -> np.ndarray:
    """Least or greatest of the diamond around each pixel; about CELLS pixels at once, what is added around the images counted in."""
    _, w, h = grids.shape
    best = grids.copy()
    step = max(1, CELLS // ((w + 2 * half) * (h + 2 * half)))
    for lo in range(0, len(grids), step):
        wide, some = np.pad(grids[lo : lo + step], ((0, 0), (half, half), (half, half)), constant_values=beyond), best[lo : lo + step]
        for c in range(-half, half + 1):
            for r in range(abs(c) - half, half - abs(c) + 1):
                pick(some, wide[:, half + c : half + c + w, half + r : half + r + h], out=some)
    return best


def erode(grids: np.ndarray, half: int) -> np.ndarray:
    return _diamond(grids, half, np.minimum, np.inf)


def dilate(grids: np.ndarray, half: int) -> np.ndarray:
    return _diamond(grids, half, np.maximum, -np.inf)


MORPHOLOGY = {
    "erosion_2D": erode,
    "dilation_2D": dilate,
    "opening_2D": lambda g, n: dilate(erode(g, n), n),
    "closing_2D": lambda g, n: erode(dilate(g, n), n),
    "tophat_2D": lambda g, n: g - dilate(erode(g, n), n),
    "bothat_2D": lambda g, n: erode(dilate(g, n), n) - g,
    "morpholaplace_2D": lambda g, n: normalized((dilate(g, n) - g) - (g - erode(g, n))),
}


@F.arrow_udf(ArrayType(DoubleType()))
def _shaped(pixels: pa.Array, h: pa.Array, w: pa.Array, side: pa.Array, name: pa.Array) -> pa.Array:
    held = Lists(pixels)
    return like(held, ((rows, MORPHOLOGY[which](held.grids(rows, height, width), int(k) // 2)) for (height, width, k, which), rows in pieces(held, h, w, side, name)))


# ---- co-occurrence

GLCM_NAMES = tuple(f"glcm_{p}_{s}" for p in images.GLCM for s in images.SUMMARIES)


def _cooccurrences(levels: np.ndarray, n: int, distance: int, step: tuple[int, int]) -> tuple[np.ndarray, int]:
    """(shares of the pairs of levels, pairs) in one direction, both orders, for images of levels (image, column, row)."""
    count, w, h = levels.shape
    dr, dc = distance * step[0], distance * step[1]
    if abs(dr) >= h or abs(dc) >= w:
        return np.zeros((count, n, n)), 0
    at = levels[:, max(0, -dc) : w - max(0, dc), max(0, -dr) : h - max(0, dr)].reshape(count, -1)
    to = levels[:, max(0, dc) : w + min(0, dc), max(0, dr) : h + min(0, dr)].reshape(count, -1)
    code = (np.arange(count)[:, None] * n + at) * n + to
    found = np.bincount(code.ravel(), minlength=count * n * n).reshape(count, n, n).astype(float)
    return (found + found.transpose(0, 2, 1)) / (2 * at.shape[1]), 2 * at.shape[1]


def glcm(levels: np.ndarray, n: int, distance: int) -> np.ndarray:
    """(image, direction, property); NaN where a property isn't defined."""
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    over = lambda p, f: (p * f).sum(axis=(1, 2))
    out = []
    for step in images.DIRECTIONS:
        p, pairs = _cooccurrences(levels, n, distance, step)
        mean = over(p, i)
        var = over(p, i * i) - mean * mean
        # The variance as sums of squares away from the mean, as small ones would vanish in the difference.
        var = (p.sum(axis=2) * (np.arange(n)[None, :] - mean[:, None]) ** 2).sum(axis=1) if pairs else var
        both = np.einsum("bij,bi,bj->b", p, np.arange(n)[None, :] - mean[:, None], np.arange(n)[None, :] - mean[:, None])
        ratio = np.divide(both, var, out=np.full(len(p), np.nan), where=var > 0)
        square = over(p, p)
        entropy = -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=(1, 2))
        columns = [mean, var, ratio, over(p, (i - j) ** 2), over(p, 1 / (1 + (i - j) ** 2)), square, entropy, p.max(axis=(1, 2)), np.sqrt(square), over(p, np.abs(i - j))]
        if not pairs:
            columns = [x if k in (5, 6, 8) else np.full(len(p), np.nan) for k, x in enumerate(columns)]
        out.append(np.column_stack(columns))
    return np.stack(out, axis=1)


def _summaries(v: np.ndarray) -> np.ndarray:
    """(image, property, summary) over the directions; least and greatest leave out what isn't defined, the others need all."""
    some = np.isfinite(v).any(axis=1)
    least = np.where(some, np.where(np.isfinite(v), v, np.inf).min(axis=1), np.nan)
    most = np.where(some, np.where(np.isfinite(v), v, -np.inf).max(axis=1), np.nan)
    return np.stack([v.mean(axis=1), v.sum(axis=1), v.std(axis=1, ddof=1), least, most], axis=2)


@F.arrow_udf(ArrayType(DoubleType()))
def _glcm_measured(pixels: pa.Array, h: pa.Array, w: pa.Array, distance: pa.Array, levels: pa.Array) -> pa.Array:
    held = Lists(pixels)
    colours = np.array([0 if p is None else len(np.unique(p)) for p in held])
    # At least five levels, or as many as there are colours.
    n = np.maximum(np.minimum(5, colours), np.minimum(255, levels.to_numpy(zero_copy_only=False).astype(float)))

    def found():
        for (height, width, d, count), rows in pieces(held, h, w, distance, pa.array(n)):
            count = int(count)
            step = max(1, CELLS // (count * count))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                grids = held.grids(some, height, width)
                low, high = grids.min(axis=(1, 2), keepdims=True), grids.max(axis=(1, 2), keepdims=True)
                share = np.divide(grids - low, high - low, out=np.zeros_like(grids), where=high > low)
                yield some, _summaries(glcm(np.minimum(count - 1, np.floor(share * count)).astype(np.int64), count, int(d))).reshape(len(some), -1)

    return rows_of(len(held), len(GLCM_NAMES), found())


# ---- regions

REGION_NAMES = tuple(f"region_{k}{s}" for s in ("", "_5p", "_10p", "_20p") for k in (*images.REGIONS, "contrast"))


def region(grid: np.ndarray, r: int, c: int, half: int) -> list[float]:
    """The numbers of the square around a pixel, in the order of REGIONS, and its contrast to the ring around it."""
    cut = lambda n: grid[max(0, c - n) : c + n + 1, max(0, r - n) : r + n + 1].ravel()
    v, wide = cut(half), cut(half + max(1, half))
    lo, hi, mean, total = v.min(), v.max(), v.mean(), v.sum()
    bins = np.minimum(7, np.floor((v - lo) / (hi - lo) * 8)).astype(int) if hi > lo else np.zeros(len(v), int)
    p = np.bincount(bins) / len(v)
    p = p[p > 0]
    ring = (wide.sum() - total) / (len(wide) - len(v)) if len(wide) > len(v) else mean
    return [mean, v.std(ddof=1) if len(v) > 1 else np.nan, lo, hi, total, float(np.median(v)), hi - lo, (v * v).mean(), -(p * np.log2(p)).sum(), mean - ring]


@F.arrow_udf(ArrayType(DoubleType()))
def _regions_measured(pixels: pa.Array, h: pa.Array, w: pa.Array, column: pa.Array, row: pa.Array, halves: pa.Array) -> pa.Array:
    held = Lists(pixels)

    def found():
        for k, (p, height, width, c, r, n) in enumerate(zip(held, *(x.to_pylist() for x in (h, w, column, row)), Lists(halves), strict=True)):
            if p is not None and len(p) and n is not None and None not in (c, r) and c == c and r == r:
                grid, known = p.reshape(width, height), {}
                for half in n:
                    known.setdefault(half, region(grid, int(r), int(c), int(half)))
                yield [k], [np.concatenate([known[half] for half in n])]

    return rows_of(len(held), len(REGION_NAMES), found())


# ---- the operators


@op("image number string", "image", family="image_windows")
def window_filter(a, mode, name):
    """One of FILTERS, scaled to 0..1."""
    return images.with_pixels(a, _filtered.asNondeterministic()(a["pixels"], a["h"], a["w"], mode.cast("double"), name))


@op("image number string", "image", family="image_windows")
def window_morphology(a, k, name):
    """One of MORPHOLOGY, with a diamond of width k."""
    return images.with_pixels(a, _shaped.asNondeterministic()(a["pixels"], a["h"], a["w"], images._odd(k).cast("double"), name))


@op("image number number", "image", family="image_windows")
def window_dog(a, s1, s2):
    """dog_image2D."""
    s1, s2 = images.dog_widths(s1, s2)
    return images.with_pixels(a, _weighed.asNondeterministic()(a["pixels"], a["h"], a["w"], s1, s2, F.lit(0)))


@op("image number number int", "image", family="image_windows")
def window_moffat(a, alpha, beta, width):
    """A blur of MOFFAT."""
    alpha, beta = images.moffat_shape(alpha, beta)
    return images.with_pixels(a, _weighed.asNondeterministic()(a["pixels"], a["h"], a["w"], alpha, beta, width.cast("int")))


@op("image number number", "list<float>", family="image_windows")
def glcm_measures(a, distance, levels):
    """All of GLCM_NAMES."""
    held = [F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(x.cast("double"), 0))) for x, lo, hi in ((distance, 1.0, 10.0), (levels, 0.0, 255.0))]
    return _glcm_measured.asNondeterministic()(a["pixels"], a["h"], a["w"], *held)


@op("image number number", "list<float>", family="image_windows")
def region_measures(a, cx, cy):
    """All of REGION_NAMES."""
    halves = F.array(*[images._half(a, s) for s in (None, 0.05, 0.10, 0.20)])
    return _regions_measured.asNondeterministic()(a["pixels"], a["h"], a["w"], images._centre(a["w"], cx), images._centre(a["h"], cy), halves)


@op("list<float> int float", "float", family="image_part")
def measure_at(measured, k, fallback):
    """A number by its place from 0; the fallback where it isn't defined, NULL without an image if that is NaN."""
    return F.when(measured.isNotNull() | ~F.isnan(fallback), F.coalesce(F.get(measured, k.cast("int")), fallback))


def _lower(name: str, make: Callable[[tuple], object]) -> None:
    """Programs write every overload of the operator by make(arguments, defaults filled in)."""
    from ..plans.program import Constant

    def filled(spec):
        given = {"number": "float"}
        return lambda args: make((*args[: len(spec.params)], *[Constant(d, given.get(p, p)) for d, p in zip(spec.defaults[len(spec.defaults) - (len(spec.params) - len(args)) :] if len(args) < len(spec.params) else (), spec.params[len(args) :], strict=False)]))

    REGISTRY.ops[name] = [replace(s, lower=filled(s)) for s in REGISTRY.ops[name]]


def register() -> None:
    """Called once all of the plans can be imported."""
    from ..plans.program import Call, Constant

    for n in FILTERS:
        _lower(n, lambda args, n=n: Call("window_filter", (*args, Constant(n, "string")), "image"))
    for n in MORPHOLOGY:
        _lower(n, lambda args, n=n: Call("window_morphology", (*args, Constant(n, "string")), "image"))
    _lower("dog_image2D", lambda args: Call("window_dog", tuple(args), "image"))
    for width in images.MOFFAT:
        _lower(f"moffat{width}_image2D", lambda args, width=width: Call("window_moffat", (*args, Constant(width, "int")), "image"))
    for k, n in enumerate(GLCM_NAMES):
        _lower(n, lambda args, k=k: Call("measure_at", (Call("glcm_measures", tuple(args), "list<float>"), Constant(k, "int"), Constant(-1.0, "float")), "float"))
    for k, n in enumerate(REGION_NAMES):
        _lower(n, lambda args, k=k: Call("measure_at", (Call("region_measures", tuple(args), "list<float>"), Constant(k, "int"), Constant(float("nan"), "float")), "float"))
