"""Binary images by histogram thresholds and local windows, and segments by region growing and flooding.

The work inside one image (a histogram's search, sums over windows, a flood) is a numpy helper on Arrow batches; what it
finds is applied to the pixels as columns. In a
program each step is a column of its own, so that later operators may use these images inside lambdas. NaN pixels count as 0. A NULL image, or one without pixels, gives NULL.
Histogram methods part the bins in a lower and an upper class; a pixel is 1 from the lower edge of the upper class on.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..registry import op
from .batches import Lists, like, pieces
from .images import image

TINY = 1e-12


def _pixels(values) -> np.ndarray:
    return np.nan_to_num(np.asarray(values, float), nan=0.0, posinf=1.0, neginf=0.0)


def _empty(values) -> bool:
    return values is None or len(values) == 0


def _made(a: Column, kind: str, pixels: Column) -> Column:
    return F.when(F.size(a["pixels"]) > 0, image(a["h"], a["w"], kind, pixels))


def _above(a: Column, t: Column) -> Column:
    # The threshold goes in as an array: Spark allows no Python UDF inside a lambda.
    return _made(a, "binary", F.zip_with(a["pixels"], F.array_repeat(t, F.size(a["pixels"])), lambda x, y: F.coalesce((F.nanvl(x, F.lit(0.0)) >= y).cast("double"), F.lit(0.0))))


# ---- thresholds of a histogram: counts of the bins -> first bin of the upper class


def _classes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights and means of both classes for a cut after each bin but the last."""
    i = np.arange(len(n))
    w0, s0 = np.cumsum(n)[:-1], np.cumsum(n * i)[:-1]
    w1, s1 = n.sum() - w0, (n * i).sum() - s0
    return w0, w1, s0 / np.maximum(w0, TINY), s1 / np.maximum(w1, TINY)


def otsu(n: np.ndarray) -> int:
    """Largest variance between the classes."""
    w0, w1, m0, m1 = _classes(n)
    return int(np.argmax(w0 * w1 * (m0 - m1) ** 2)) + 1


def minimum_error(n: np.ndarray) -> int:
    """Kittler and Illingworth: least error of two normal distributions."""
    w0, w1, m0, m1 = _classes(n)
    squares = n * np.arange(len(n)) ** 2.0
    q0 = np.cumsum(squares)[:-1]
    v0 = q0 / np.maximum(w0, TINY) - m0**2
    v1 = (squares.sum() - q0) / np.maximum(w1, TINY) - m1**2
    p0, p1 = w0 / n.sum(), w1 / n.sum()
    ok = (v0 > 1e-9) & (v1 > 1e-9)
    if not ok.any():
        return otsu(n)
    cost = np.full(len(v0), np.inf)
    cost[ok] = 1 + p0[ok] * np.log(v0[ok]) + p1[ok] * np.log(v1[ok]) - 2 * (p0[ok] * np.log(p0[ok]) + p1[ok] * np.log(p1[ok]))
    return int(np.argmin(cost)) + 1


def entropy(n: np.ndarray) -> int:
    """Kapur: largest sum of the classes' entropies."""
    p = n / n.sum()
    w = np.cumsum(p)[:-1]
    e = np.cumsum(-p * np.log(np.maximum(p, TINY)))
    ok = (w > TINY) & (w < 1 - TINY)
    held = np.where(ok, w, 0.5)
    total = np.log(held) + e[:-1] / held + np.log(1 - held) + (e[-1] - e[:-1]) / (1 - held)
    return int(np.argmax(np.where(ok, total, -np.inf))) + 1


def yen(n: np.ndarray) -> int:
    """Largest correlation criterion."""
    p = n / n.sum()
    w, q = np.cumsum(p)[:-1], np.cumsum(p**2)
    a, b = q[:-1] * (q[-1] - q[:-1]), w * (1 - w)
    ok = (a > TINY**2) & (b > TINY)
    gain = -np.log(np.where(ok, a, 1.0)) + 2 * np.log(np.where(ok, b, 1.0))
    return int(np.argmax(np.where(ok, gain, -np.inf))) + 1


def moments(n: np.ndarray) -> int:
    """Tsai: the share of the lower class that keeps the first three moments."""
    i, p = np.linspace(0, 1, len(n)), n / n.sum()
    m1, m2, m3 = ((p * i**k).sum() for k in (1, 2, 3))
    spread = m2 - m1 * m1
    if spread < TINY:
        return otsu(n)
    c0, c1 = (m1 * m3 - m2 * m2) / spread, (m1 * m2 - m3) / spread
    root = np.sqrt(max(c1 * c1 - 4 * c0, 0.0))
    z0, z1 = (-c1 - root) / 2, (-c1 + root) / 2
    if z1 - z0 < TINY:
        return otsu(n)
    share = (z1 - m1) / (z1 - z0)
    return int(np.argmin(np.abs(np.cumsum(p)[:-1] - share))) + 1


def rosin(n: np.ndarray) -> int:
    """Farthest from the line between the peak and the far end of the histogram."""
    peak, used = int(np.argmax(n)), np.flatnonzero(n)
    end = int(used[-1]) if used[-1] - peak >= peak - used[0] else int(used[0])
    if end == peak:
        return otsu(n)
    at = np.arange(min(peak, end), max(peak, end) + 1)
    far = np.abs((n[end] - n[peak]) * (at - peak) - (end - peak) * (n[at] - n[peak]))
    return int(np.clip(at[np.argmax(far)], 1, len(n) - 1))


def balanced(n: np.ndarray) -> int:
    """Take bins off the heavier side until the scale's arms meet."""
    low, high = 0, len(n) - 1
    sums = np.r_[0, np.cumsum(n)]
    while low < high:
        middle = (low + high + 1) // 2
        if sums[middle] - sums[low] > sums[high + 1] - sums[middle]:
            low += 1
        else:
            high -= 1
    return int(np.clip(low, 1, len(n) - 1))


def _two_modes(n: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The histogram, smoothed over three bins until it has at most two modes, and these."""
    smooth = n.astype(float)
    for _ in range(10_000):
        edged = np.r_[-1.0, smooth, -1.0]
        rising = np.flatnonzero((edged[1:-1] > edged[:-2]) & (edged[1:-1] >= edged[2:]))
        if len(rising) <= 2:
            break
        padded = np.r_[smooth[0], smooth, smooth[-1]]
        smooth = (padded[:-2] + padded[1:-1] + padded[2:]) / 3
    return smooth, rising.tolist()


def intermodes(n: np.ndarray) -> int:
    """Half way between the two modes."""
    _, modes = _two_modes(n)
    return (modes[0] + modes[1] + 1) // 2 if len(modes) == 2 else otsu(n)


def minimum_intermodes(n: np.ndarray) -> int:
    """The lowest bin between the two modes."""
    smooth, modes = _two_modes(n)
    return modes[0] + 1 + int(np.argmin(smooth[modes[0] + 1 : modes[1] + 1])) if len(modes) == 2 else otsu(n)


def _histogram_op(name: str, cut: Callable[[np.ndarray], int]) -> None:
    def threshold(values, bins: float) -> float | None:
        if _empty(values) or bins is None or np.isnan(bins):
            return None
        p = _pixels(values)
        if p.min() == p.max():
            return float(p[0])
        n, edges = np.histogram(p, int(bins))
        return float(edges[cut(n)])

    @F.arrow_udf(DoubleType())
    def thresholds(pixels: pa.Array, bins: pa.Array) -> pa.Array:
        return pa.array([threshold(p, b) for p, b in zip(Lists(pixels), bins.to_pylist(), strict=True)], pa.float64(), from_pandas=True)

    @op("image number", "image", name=name, defaults=(256,))
    def build(a, bins):
        held = F.greatest(F.lit(30.0), F.least(F.lit(500.0), F.bround(F.nanvl(bins.cast("double"), F.lit(256.0)), 0)))
        return _above(a, thresholds.asNondeterministic()(a["pixels"], held))

    build.__doc__ = cut.__doc__


HISTOGRAM = {"binarize_otsu2D": otsu, "binarize_minimumintermodes2D": minimum_intermodes, "binarize_intermodes2D": intermodes, "binarize_minimumerror2D": minimum_error, "binarize_moments2D": moments, "binarize_unimodalrosin2D": rosin, "binarize_entropy2D": entropy, "binarize_balanced2D": balanced, "binarize_yen2D": yen}
for _name, _cut in HISTOGRAM.items():
    _histogram_op(_name, _cut)


def _halves(values) -> float | None:
    """Half way between the roots of the polynomial of degree two that the pixels fit best: each pixel goes to the nearer root."""
    if _empty(values):
        return None
    p = _pixels(values)
    terms = np.column_stack([p * p, p, np.ones(len(p))])
    best = np.linalg.eigh(terms.T @ terms)[1][:, 0]
    return float(-best[1] / (2 * best[0])) if abs(best[0]) > TINY else float(p.mean())


@F.arrow_udf(DoubleType())
def _polysegment(pixels: pa.Array) -> pa.Array:
    return pa.array([_halves(p) for p in Lists(pixels)], pa.float64(), from_pandas=True)


@op("image", "image")
def binarize_polysegment2D(a):
    return _above(a, _polysegment.asNondeterministic()(a["pixels"]))


@op("image image", "image", name="binarize_manual2D")
def by_mean(a, b):
    """From the mean of the second image on."""
    return _above(a, F.try_divide(F.aggregate(b["pixels"], F.lit(0.0), lambda s, x: s + x), F.size(b["pixels"])))


@op("image float", "image", name="binarize_manual2D", defaults=(0.5,))
def by_share(a, t):
    """From t (0 to 1) on."""
    return _above(a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


@op("image number", "image", name="binarize_manual2D")
def by_level(a, t):
    """From t 255ths on."""
    return _above(a, t.cast("double") / 255)


# ---- local windows


def _window_means(p: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the pixels and of their squares in the window around each pixel of (image, column, row), from running sums."""
    rows, cols = np.arange(p.shape[1]), np.arange(p.shape[2])
    r0, r1 = np.maximum(rows - reach, 0)[:, None], np.minimum(rows + reach + 1, len(rows))[:, None]
    c0, c1 = np.maximum(cols - reach, 0)[None], np.minimum(cols + reach + 1, len(cols))[None]
    means = []
    for q in (p, p * p):
        sums = np.pad(q.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        means.append((sums[:, r1, c1] - sums[:, r0, c1] - sums[:, r1, c0] + sums[:, r0, c0]) / ((r1 - r0) * (c1 - c0)))
    return means[0], means[1]


_MEANS = ArrayType(StructType([StructField("mean", DoubleType()), StructField("square", DoubleType())]))


@F.arrow_udf(_MEANS)
def _local(pixels: pa.Array, h: pa.Array, w: pa.Array, reach: pa.Array) -> pa.Array:
    held = Lists(pixels)
    squares = np.zeros(int(held.sizes[held.valid].sum()))
    ends = np.cumsum(np.where(held.valid, held.sizes, 0))

    def found():
        for (height, width, n), rows in pieces(held, h, w, reach):
            mean, square = _window_means(_pixels(held.grids(rows, height, width)), n)
            squares[(ends[rows] - held.sizes[rows])[:, None] + np.arange(height * width)] = square.reshape(len(rows), -1)
            yield rows, mean

    means = like(held, found())
    return pa.ListArray.from_arrays(means.offsets, pa.StructArray.from_arrays([means.values, pa.array(squares)], ["mean", "square"]), mask=means.is_null())


def _by_window(a: Column, reach: Column, threshold: Callable[[Column, Column], Column]) -> Column:
    """1 above the threshold that a window's mean and deviation give."""
    near = _local.asNondeterministic()(a["pixels"], a["h"], a["w"], reach.cast("int"))
    return _made(a, "binary", F.zip_with(a["pixels"], near, lambda x, m: (F.nanvl(x, F.lit(0.0)) > threshold(m["mean"], F.sqrt(F.greatest(m["square"] - m["mean"] * m["mean"], F.lit(0.0))))).cast("double")))


def _size(a: Column, size: Column, default: Column) -> Column:
    """5 to the shorter side."""
    held = F.greatest(F.lit(5.0), F.least(F.least(a["h"], a["w"]).cast("double"), F.bround(size.cast("double"), 0)))
    return F.when(F.isnan(size.cast("double")), default.cast("double")).otherwise(held)


@op("image number number", "image", defaults=(float("nan"), 15))
def binarize_adaptive2D(a, size, percent):
    """Bradley and Roth: above the window's mean less a percentage; by default an eighth of the longer side and 15."""
    share = (100 - F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(percent.cast("double"), 0)))) / 100
    return _by_window(a, F.floor(_size(a, size, F.bround(F.greatest(a["h"], a["w"]) / 8, 0)) / 2), lambda m, s: m * share)


@op("image number number", "image", defaults=(float("nan"), 0.2))
def binarize_niblack2D(a, size, bias):
    """Above mean + bias * deviation; the window reaches ``size`` (7) pixels each way."""
    b = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), bias.cast("double")))
    return _by_window(a, _size(a, size, F.lit(7)), lambda m, s: m + b * s)


@op("image number number", "image", defaults=(float("nan"), 0.2))
def binarize_sauvola2D(a, size, bias):
    """Above mean * (1 + bias * (deviation / 0.5 - 1)); the window reaches ``size`` (7) pixels each way."""
    b = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), bias.cast("double")))
    return _by_window(a, _size(a, size, F.lit(7)), lambda m, s: m * (1 + b * (s / 0.5 - 1)))


# ---- segments


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def grow(values, h: int, w: int, th: float) -> list[float] | None:
    """Fast scanning: a pixel joins the segments above it and left of it whose mean is nearer than th; labels from 1 by first pixel."""
    if _empty(values):
        return None
    p, h = _pixels(values).tolist(), int(h)
    parent, total, size = list(range(len(p))), list(p), [1] * len(p)
    for i, x in enumerate(p):
        for j in ([i - 1] if i % h else []) + ([i - h] if i >= h else []):
            mine, other = _root(parent, i), _root(parent, j)
            if mine != other and abs(total[other] / size[other] - x) < th:
                parent[mine] = other
                total[other] += total[mine]
                size[other] += size[mine]
    label: dict[int, float] = {}
    return [label.setdefault(_root(parent, i), len(label) + 1.0) for i in range(len(p))]


def flood(values, mask, h: int, w: int, th: float) -> list[float] | None:
    """Watershed of 1 - distance to the nearest set pixel, from the components below th; 0 outside the mask and where no flood comes."""
    if _empty(values) or _empty(mask) or len(mask) != len(values):
        return None
    h, w = int(h), int(w)
    on = _pixels(values).reshape(w, h) >= 0.5
    rows = np.arange(h)
    # Squared distance along each column, then over the columns.
    down = np.array([np.min((rows[:, None] - np.flatnonzero(line)[None]) ** 2, axis=1) if line.any() else np.full(h, np.inf) for line in on])
    square = np.array([np.min(down + ((np.arange(w) - c) ** 2)[:, None], axis=0) for c in range(w)])
    level = (1 - np.sqrt(square)).reshape(-1)
    inside, label, count = _pixels(mask) >= 0.5, np.zeros(h * w, int), 0

    def around(i: int, corners: bool):
        c, r = divmod(i, h)
        for dc in (-1, 0, 1):
            for dr in (-1, 0, 1):
                if (dc or dr) and (corners or not (dc and dr)) and 0 <= c + dc < w and 0 <= r + dr < h:
                    yield (c + dc) * h + r + dr

    for start in np.flatnonzero(level < th).tolist():
        if label[start]:
            continue
        count += 1
        label[start], todo = count, [start]
        while todo:
            for j in around(todo.pop(), False):
                if level[j] < th and not label[j]:
                    label[j] = count
                    todo.append(j)
    queue = [(level[i], n, i) for n, i in enumerate(np.flatnonzero(label).tolist())]
    heapq.heapify(queue)
    turn = len(queue)
    while queue:
        height, _, i = heapq.heappop(queue)
        for j in around(i, True):
            if not label[j] and inside[j]:
                label[j] = label[i]
                heapq.heappush(queue, (max(height, level[j]), turn, j))
                turn += 1
    return np.where(inside, label, 0).astype(float).tolist()


def _segments(pixels: Lists, labels: Iterator[list[float] | None]) -> pa.Array:
    return like(pixels, (([k], np.array(v)) for k, v in enumerate(labels) if v is not None))


@F.arrow_udf(ArrayType(DoubleType()))
def _grown(pixels: pa.Array, h: pa.Array, w: pa.Array, th: pa.Array) -> pa.Array:
    held = Lists(pixels)
    return _segments(held, map(grow, held, *(x.to_pylist() for x in (h, w, th))))


@F.arrow_udf(ArrayType(DoubleType()))
def _flooded(pixels: pa.Array, mask: pa.Array, h: pa.Array, w: pa.Array, th: pa.Array) -> pa.Array:
    held = Lists(pixels)
    return _segments(held, map(flood, held, Lists(mask), *(x.to_pylist() for x in (h, w, th))))


@op("image number", "image", defaults=(0.1,))
def fastscanning_image2D(a, th):
    """Regions whose pixels differ by less than th (0.1 if NaN, at most 1) from their mean."""
    held = F.greatest(F.lit(2.0**-52), F.least(F.lit(1.0), F.nanvl(th.cast("double"), F.lit(0.1))))
    return _made(a, "segment", _grown.asNondeterministic()(a["pixels"], a["h"], a["w"], held))


def _depth(th: Column) -> Column:
    return F.greatest(F.lit(-1000.0), F.least(F.lit(0.0), th.cast("double")))


@op("image image number", "image", name="watershed_image2D")
def watershed_inside(a, mask, th):
    """Basins around the pixels farthest from set ones, inside the mask."""
    return _made(a, "segment", _flooded.asNondeterministic()(a["pixels"], mask["pixels"], a["h"], a["w"], _depth(th)))


@op("image number", "image", name="watershed_image2D", defaults=(-15,))
def watershed(a, th):
    """Basins around the pixels farthest from set ones."""
    return _made(a, "segment", _flooded.asNondeterministic()(a["pixels"], F.transform(a["pixels"], lambda x: F.lit(1.0)), a["h"], a["w"], _depth(th)))
