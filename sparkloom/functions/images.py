"""Operators on images: structs (h, w, kind, pixels) with column-major pixels, as higher-order functions on the array.

Kinds: "intensity" (0 to 1), "binary" (0 or 1), "segment" (labels). Positions inside are 0-based; i = row + column * h.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..registry import op

INF = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def image(h: Column, w: Column, kind: Column | str, pixels: Column) -> Column:
    return F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), pixels.alias("pixels"))


def with_pixels(img: Column, pixels: Column, kind: str | None = None) -> Column:
    """img with other pixels, cast to its kind: binary from 0.5 on, labels rounded to even."""
    k = img["kind"] if kind is None else F.lit(kind)

    def cast(p: Column) -> Column:
        return F.when(k == "intensity", p).otherwise(F.transform(p, lambda x: F.when(k == "binary", (x >= 0.5).cast("double")).otherwise(F.bround(x, 0))))

    return image(img["h"], img["w"], k, let(pixels, cast))


def clamp01(x: Column) -> Column:
    """0 to 1; NaN and missing give 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def synthetic(h: int, w: int, kind: str = "intensity") -> Column:
    """A gradient, a checkerboard or labels by thirds."""
    at = F.sequence(F.lit(0), F.lit(h * w - 1))
    value = {"intensity": lambda r, c: (r + c + 2) / float(h + w), "binary": lambda r, c: ((r + c) % 2).cast("double"), "segment": lambda r, c: ((r + c + 2) % 3).cast("double")}[kind]
    return image(F.lit(h), F.lit(w), kind, F.transform(at, lambda i: value(i % h, F.floor(i / h))))


def _mean(v: Column) -> Column:
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))


def _std(v: Column) -> Column:
    """With n - 1; NaN for one value."""

    def of(v: Column) -> Column:
        squares = let(_mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        return F.when(F.size(v) > 1, F.sqrt(squares / (F.size(v) - 1))).when(F.size(v) == 1, F.lit(float("nan")))

    return let(v, of)


def _quantile(v: Column, q: float) -> Column:
    """Linear between neighbours."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
        return a + (b - a) * (at - lo)

    return let(F.array_sort(v), of)


def normalize(pixels: Column) -> Column:
    """Min-max to 0..1; NaN and infinities count as 0, a constant image gives 0."""
    clean = F.transform(pixels, lambda x: F.when(F.isnan(x) | (F.abs(x) == INF) | x.isNull(), F.lit(0.0)).otherwise(x))
    scaled = lambda v, lo, hi: F.transform(v, lambda x: clamp01(F.try_divide(x - lo, hi - lo)))
    return let(clean, lambda v: _range(v, lambda lo, hi: scaled(v, lo, hi)))


def _range(v: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of the least and the greatest value."""
    return let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda r: body(r["lo"], r["hi"]))


# ---- two images, pixel by pixel


def _two(name: str, f: Callable[[Column, Column], Column]) -> None:
    @op("image image", "image", name=name)
    def build(a, b):
        return F.when((a["h"] == b["h"]) & (a["w"] == b["w"]), with_pixels(a, F.zip_with(a["pixels"], b["pixels"], lambda x, y: clamp01(f(x, y)))))


for _name, _f in {"subtract_img2D": lambda x, y: x - y, "add_img2D": lambda x, y: x + y, "mult_img2D": lambda x, y: x * y, "max_img2D": F.greatest, "min_img2D": F.least}.items():
    _two(_name, _f)


def _one(name: str, params: str, f: Callable[..., Column], defaults: tuple = ()) -> None:
    @op(f"image {params}".strip(), "image", name=name, defaults=defaults)
    def build(a, *p):
        return with_pixels(a, F.transform(a["pixels"], lambda x: clamp01(f(x, *p))))


_one("bsubtract_image2D", "number", lambda x, p: x - p)
_one("badd_image2D", "number", lambda x, p: x + p)
_one("bmult_image2D", "number", lambda x, p: x * p)
_one("ones_2D", "", lambda x: F.lit(1.0))
_one("zeros_2D", "", lambda x: F.lit(0.0))
_one("experimental_invert_2D", "", lambda x: F.abs(1 - x))
_one("powerof_image2D", "number", lambda x, p: F.pow(x, p))
_one("loginv_image2D", "", lambda x: F.when(x <= 0, F.lit(1.0)).otherwise(-F.log(x)))


@op("image", "image")
def identity_image2D(a):
    return a


@op("image", "image", name="experimental_normalize_2D")
def normalize_2d(a):
    return with_pixels(a, normalize(a["pixels"]))


@op("image", "image", name="experimental_standardize_2D")
def standardize_2d(a):
    scale = F.struct(_mean(a["pixels"]).alias("m"), _std(a["pixels"]).alias("s"))
    return with_pixels(a, let(scale, lambda k: F.transform(a["pixels"], lambda x: clamp01(F.try_divide(x - k["m"], k["s"])))))


@op("image", "image", name="experimental_tointensity_image2D")
def to_intensity(a):
    """Labels over the largest one."""
    top = F.when(a["kind"] == "segment", F.array_max(a["pixels"])).otherwise(F.lit(1.0))
    return with_pixels(a, let(top, lambda t: F.transform(a["pixels"], lambda x: clamp01(F.try_divide(x, t)))), "intensity")


@op("image number", "image", name="experimental_tobinary_th_image2D_factory")
def to_binary_from(a, th):
    """Above th; labels other than the smallest."""
    marked = lambda low: F.transform(a["pixels"], lambda x: F.when(a["kind"] == "segment", x != low).otherwise(x > th).cast("double"))
    return with_pixels(a, let(F.array_min(a["pixels"]), marked), "binary")


@op("image", "image", name="experimental_tobinary_image2D")
def to_binary(a):
    return to_binary_from(a, F.lit(0.0))


@op("image", "image", name="experimental_tosegment_image2D")
def to_segment(a):
    return with_pixels(a, F.transform(a["pixels"], lambda x: F.floor(x).cast("double")), "segment")


@op("image", "image")
def exp_image2D(a):
    return with_pixels(a, normalize(F.transform(a["pixels"], lambda x: F.exp(x))))


@op("image", "image")
def log_image2D(a):
    """Of the 8-bit storage value; zeros count as 0 before scaling."""
    return with_pixels(a, normalize(F.transform(a["pixels"], lambda x: F.when(F.bround(x * 255, 0) <= 0, F.lit(0.0)).otherwise(F.log(F.bround(x * 255, 0))))))


# ---- masks


def _masked(name: str, test: Callable[[Column, Column], Column]) -> None:
    @op("image image number", "image", name=name, defaults=(0.5,))
    def build(a, m, by):
        return F.when((a["h"] == m["h"]) & (a["w"] == m["w"]), with_pixels(a, F.zip_with(a["pixels"], m["pixels"], lambda x, y: F.when(test(y, by), x).otherwise(0.0))))


for _name, _f in {"maskgt_image2D": lambda y, t: y > t, "masklt_image2D": lambda y, t: y < t, "maskeqt_image2D": lambda y, t: y == t}.items():
    _masked(_name, _f)


def _banded(name: str, columns: bool, keep_inside: bool, relative: bool) -> None:
    @op("image number number", "image", name=name)
    def build(a, start, end):
        size = a["w"] if columns else a["h"]
        lo, hi = (F.bround(start * size, 0), F.bround(end * size, 0)) if relative else (start, end)
        lo, hi = F.least(lo, hi), F.greatest(lo, hi)
        where = lambda i: (F.floor(i / a["h"]) if columns else i % a["h"]) + 1
        inside = lambda i: (where(i) >= lo) & (where(i) <= hi)
        return with_pixels(a, F.transform(a["pixels"], lambda x, i: F.when(inside(i) if keep_inside else ~inside(i), x).otherwise(0.0)))


for _rel in (False, True):
    for _cols, _axis in ((True, "v"), (False, "h")):
        for _keep, _word in ((True, "notmask"), (False, "mask")):
            _banded(f"experimental_{_word}fromto{_axis}{'_relative' if _rel else ''}_image2D", _cols, _keep, _rel)


@op("image number", "image", name="experimental_notmaskbycolor_image2D")
def mask_by_colour(a, colour):
    return with_pixels(a, F.transform(a["pixels"], lambda x: (F.abs(x - colour) < 1 / 255).cast("double")))


# ---- neighbourhoods


def _border(at: Column, n: Column, mode: Column) -> Column:
    """at inside 0..n-1: by repeating the edge (0), around (below 0) or by mirroring (above 0)."""
    twice = lambda t: F.least(t, 2 * n - 1 - t)
    return F.when(mode == 0, F.greatest(F.lit(0), F.least(n - 1, at))).when(mode < 0, F.pmod(at, n)).otherwise(twice(F.pmod(at, 2 * n)))


def _weights(kernel: list[tuple[int, int, float]]) -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('r', {r}, 'c', {c}, 'v', {float(v)!r}D)" for r, c, v in kernel) + ")")


def _led(n: Column, reach: int, mode: Column) -> Column:
    """Where the places from -reach to n - 1 + reach lead, in turn."""
    return F.transform(F.sequence(F.lit(-reach), n - 1 + reach), lambda x: _border(x, n, mode).cast("int"))


def _summed(g: Column, reach: int, h: Column) -> Column:
    """At each pixel of g.p the sum of its neighbours times the weights g.k; g.r and g.c say where rows and columns beyond the edges lead."""

    def at(i: Column) -> Column:
        r, c = i % h + reach, F.floor(i / h).cast("int") + reach
        return F.aggregate(g["k"], F.lit(0.0), lambda s, k: s + k["v"] * F.get(g["p"], F.get(g["r"], r + k["r"]) + F.get(g["c"], c + k["c"]) * h))

    return F.transform(g["p"], lambda x, i: at(i))


def correlate(a: Column, kernel: list[tuple[int, int, float]], mode: Column) -> Column:
    """Sum over (row offset, column offset, weight) of the neighbours at each pixel."""
    reach = max(max(abs(r), abs(c)) for r, c, _ in kernel)
    known = F.struct(a["pixels"].alias("p"), _weights(kernel).alias("k"), _led(a["h"], reach, mode).alias("r"), _led(a["w"], reach, mode).alias("c"))
    return let(known, lambda g: _summed(g, reach, a["h"]))


def _grid(rows: list[list[float]]) -> list[tuple[int, int, float]]:
    n, m = len(rows), len(rows[0])
    return [(i - (n - 1) // 2, j - (m - 1) // 2, v) for i, r in enumerate(rows) for j, v in enumerate(r) if v]


def _outer(a: list[float], b: list[float]) -> list[list[float]]:
    return [[x * y for y in b] for x in a]


# Derivative kernels, as smoothing times difference, and the published 4 x 4 and 5 x 5 ones.
DERIVATIVES = {
    "sobel": _outer([1 / 4, 2 / 4, 1 / 4], [-1 / 2, 0, 1 / 2]),
    "prewitt": _outer([1 / 3, 1 / 3, 1 / 3], [-1 / 2, 0, 1 / 2]),
    "scharr": _outer([3 / 16, 10 / 16, 3 / 16], [-1 / 2, 0, 1 / 2]),
    "bickley": _outer([1 / 6, 4 / 6, 1 / 6], [-1 / 2, 0, 1 / 2]),
    "ando3": [[-0.112737, 0, 0.112737], [-0.274526, 0, 0.274526], [-0.112737, 0, 0.112737]],
    "ando4": [[-0.025844, -0.022213, 0.022213, 0.025844], [-0.078956, -0.148679, 0.148679, 0.078956], [-0.078956, -0.148679, 0.148679, 0.078956], [-0.025844, -0.022213, 0.022213, 0.025844]],
    "ando5": [[-0.003776, -0.010199, 0, 0.010199, 0.003776], [-0.026786, -0.070844, 0, 0.070844, 0.026786], [-0.046548, -0.122572, 0, 0.122572, 0.046548], [-0.026786, -0.070844, 0, 0.070844, 0.026786], [-0.003776, -0.010199, 0, 0.010199, 0.003776]],
}


def _transposed(rows: list[list[float]]) -> list[list[float]]:
    return [list(r) for r in zip(*rows, strict=True)]


def _derivative(name: str, rows: list[list[float]]) -> None:
    x, y = _grid(rows), _grid(_transposed(rows))

    @op("image number", "image", name=f"{name}x_image2D", defaults=(0.0,))
    def along_x(a, b):
        return with_pixels(a, normalize(correlate(a, x, b)))

    @op("image number", "image", name=f"{name}y_image2D", defaults=(0.0,))
    def along_y(a, b):
        return with_pixels(a, normalize(correlate(a, y, b)))

    @op("image number", "image", name=f"{name}m_image2D", defaults=(0.0,))
    def magnitude(a, b):
        return with_pixels(a, normalize(F.zip_with(correlate(a, x, b), correlate(a, y, b), lambda p, q: F.sqrt(p * p + q * q))))


for _name, _rows in DERIVATIVES.items():
    _derivative(_name, _rows)


def _gauss(sigma: float, half: int) -> list[float]:
    v = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-half, half + 1)]
    return [x / sum(v) for x in v]


def _blurred(a: Column, line: list[float], mode: Column) -> Column:
    """A separable kernel: along rows, then along columns."""
    half = len(line) // 2
    first = image(a["h"], a["w"], a["kind"], correlate(a, [(0, k - half, v) for k, v in enumerate(line)], mode))
    return let(first, lambda g: correlate(g, [(k - half, 0, v) for k, v in enumerate(line)], mode))


def _gaussian(width: int, sigma: float) -> None:
    @op("image number", "image", name=f"gaussian{width}_image2D", defaults=(0.0,))
    def blur(a, b):
        return with_pixels(a, normalize(_blurred(a, _gauss(sigma, width // 2), b)))


for _width, _sigma in ((5, 1), (9, 2), (13, 3), (17, 4), (25, 6)):
    _gaussian(_width, _sigma)


@op("image number", "image", defaults=(0.0,))
def laplacian3_image2D(a, b):
    return with_pixels(a, normalize(correlate(a, _grid([[0, 1, 0], [1, -4, 1], [0, 1, 0]]), b)))


def _weighted(a: Column, half: int, weight: Callable[[Column], Column]) -> Column:
    """Like correlate, with weights from the squared distance that depend on the row's parameters; divided by their sum."""
    steps = F.transform(F.sequence(F.lit(0), F.lit((2 * half + 1) ** 2 - 1)), lambda j: F.pow(j % (2 * half + 1) - half, F.lit(2)) + F.pow(F.floor(j / (2 * half + 1)) - half, F.lit(2)))
    return _window_sums(a["h"], a["w"], a["pixels"], F.transform(steps, weight))


@F.pandas_udf(ArrayType(DoubleType()))
def _window_sums(heights: pd.Series, widths: pd.Series, images: pd.Series, weights: pd.Series) -> pd.Series:
    """Weighted means of the square around each pixel, edges repeated: hundreds of neighbours a pixel, so in numpy."""

    def one(h: int, w: int, pixels: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
        if pixels is None or weight is None:
            return None
        side = math.isqrt(len(weight))
        grid = np.pad(np.asarray(pixels, float).reshape(w, h), side // 2, mode="edge")  # rows are columns of the image
        near = np.lib.stride_tricks.sliding_window_view(grid, (side, side))
        return np.einsum("ijkl,kl->ij", near, np.asarray(weight, float).reshape(side, side)).reshape(-1) / np.sum(weight)

    return pd.Series([one(*row) for row in zip(heights, widths, images, weights, strict=True)], dtype=object)


def dog_widths(*widths: Column) -> list[Column]:
    return [F.greatest(F.lit(0.1), F.least(F.lit(10.0), s.cast("double"))) for s in widths]


def moffat_shape(*numbers: Column) -> list[Column]:
    return [F.greatest(F.lit(0.1), F.least(F.lit(100.0), x.cast("double"))) for x in numbers]


@op("image number number", "image", defaults=(0.5, 0.5))
def dog_image2D(a, s1, s2):
    """Difference of Gaussians of two widths, each held in 0.1..10."""
    s1, s2 = dog_widths(s1, s2)
    wide = lambda s: _weighted(a, 4, lambda d: F.exp(-d / (2 * s * s)))
    return with_pixels(a, normalize(F.zip_with(wide(s1), wide(s2), lambda x, y: x - y)))


def _moffat(width: int) -> None:
    @op("image number number", "image", name=f"moffat{width}_image2D", defaults=(1.0, 1.0))
    def blur(a, alpha, beta):
        alpha, beta = moffat_shape(alpha, beta)
        return with_pixels(a, normalize(_weighted(a, width // 2, lambda d: F.pow(1 + d / (alpha * alpha), -beta))))


#: Widths of Moffat's blurs.
MOFFAT = (5, 13, 25)
for _width in MOFFAT:
    _moffat(_width)


def _window(a: Column, i: Column, top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """Pixels from row r + top to r + bottom and column c + left to c + right around pixel i, inside the image."""
    h, w = a["h"], a["w"]
    r, c = i % h, F.floor(i / h).cast("int")
    ends = F.struct(F.greatest(r + top, F.lit(0)).cast("int").alias("r0"), F.least(r + bottom, h - 1).cast("int").alias("r1"), F.greatest(c + left, F.lit(0)).cast("int").alias("c0"), F.least(c + right, w - 1).cast("int").alias("c1"))
    return let(ends, lambda e: F.flatten(F.transform(F.sequence(e["c0"], e["c1"]), lambda k: F.slice(a["pixels"], k * h + e["r0"] + 1, e["r1"] - e["r0"] + 1))))


def _extreme(name: str, pick: Callable[[Column], Column]) -> None:
    @op("image number number", "image", name=name, defaults=(3.0, 3.0))
    def build(a, w1, w2):
        r, c = (F.floor(F.greatest(F.lit(2), F.least(F.lit(25), F.bround(x.cast("double"), 0))) / 2).cast("int") for x in (w1, w2))

        def mark(x, i):
            return let(_window(a, i, -r, r, -c, c), lambda near: ((x == pick(near)) & (F.size(F.filter(near, lambda y: y == x)) == 1)).cast("double"))

        return with_pixels(a, F.transform(a["pixels"], mark), "binary")


_extreme("findlocalminima_image2D", F.array_min)
_extreme("findlocalmaxima_image2D", F.array_max)


# ---- morphology


def _odd(k: Column) -> Column:
    """Rounded, odd, in 3..13."""
    k = F.bround(k.cast("double"), 0).cast("int")
    return F.greatest(F.lit(3), F.least(F.lit(13), k + F.when(k % 2 == 0, 1).otherwise(0)))


def _diamond(a: Column, k: Column, pick: Callable[[Column], Column]) -> Column:
    """Least or greatest pixel within the diamond of width k."""
    half = F.floor(_odd(k) / 2).cast("int")
    h, w = a["h"], a["w"]

    def at(p: Column, i: Column) -> Column:
        r, c = i % h, F.floor(i / h).cast("int")
        columns = F.sequence(F.greatest(c - half, F.lit(0)), F.least(c + half, w - 1))

        def run(x):
            reach = half - F.abs(x - c)
            lo, hi = F.greatest(r - reach, F.lit(0)), F.least(r + reach, h - 1)
            return pick(F.slice(p, (x * h + lo + 1).cast("int"), (hi - lo + 1).cast("int")))

        return pick(F.transform(columns, run))

    return let(a["pixels"], lambda p: F.transform(p, lambda x, i: at(p, i)))


def _again(a: Column, pixels: Column) -> Column:
    return image(a["h"], a["w"], a["kind"], pixels)


def erode(a: Column, k: Column) -> Column:
    return _diamond(a, k, F.array_min)


def dilate(a: Column, k: Column) -> Column:
    return _diamond(a, k, F.array_max)


def _difference(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p - q)


def _laplace(a: Column, k: Column) -> Column:
    return normalize(F.zip_with(_difference(dilate(a, k), a["pixels"]), _difference(a["pixels"], erode(a, k)), lambda e, i: e - i))


MORPHOLOGY = {
    "erosion_2D": erode,
    "dilation_2D": dilate,
    "opening_2D": lambda a, k: let(_again(a, erode(a, k)), lambda e: dilate(e, k)),
    "closing_2D": lambda a, k: let(_again(a, dilate(a, k)), lambda d: erode(d, k)),
    "tophat_2D": lambda a, k: _difference(a["pixels"], let(_again(a, erode(a, k)), lambda e: dilate(e, k))),
    "bothat_2D": lambda a, k: _difference(let(_again(a, dilate(a, k)), lambda d: erode(d, k)), a["pixels"]),
    "morpholaplace_2D": _laplace,
}


def _morph(name: str, f: Callable[[Column, Column], Column]) -> None:
    @op("image number", "image", name=name, defaults=(3.0,))
    def build(a, k):
        return with_pixels(a, f(a, k))


for _name, _f in MORPHOLOGY.items():
    _morph(_name, _f)


@op("image number number", "image", defaults=(3.0, -1.0))
def morphogradient_2D(a, k, mode):
    """Below 0: dilated - eroded; 0: image - eroded; above 0: dilated - image."""
    d, e = dilate(a, k), erode(a, k)
    return with_pixels(a, F.when(mode < 0, _difference(d, e)).when(mode == 0, _difference(a["pixels"], e)).otherwise(_difference(d, a["pixels"])))


# ---- pools


def _pool(name: str, number: Callable[[Column], Column], cross: bool) -> None:
    @op("image number", "image", name=name, defaults=(2.0,))
    def build(a, k):
        k, h, w = F.greatest(F.lit(1), F.bround(k.cast("double"), 0).cast("int")), a["h"], a["w"]

        def at(i):
            r, c = i % h, F.floor(i / h).cast("int")
            r0, c0 = F.floor(r / k) * k, F.floor(c / k) * k
            r1, c1 = F.least(r0 + k, h) - 1, F.least(c0 + k, w) - 1
            block = _window(a, F.lit(0), r0, r1, c0, c1)
            if not cross:
                return let(block, number)
            rows, mid_r, mid_c = r1 - r0 + 1, F.floor((r1 - r0 + 1) / 2), F.floor((c1 - c0 + 1) / 2)
            return let(F.filter(block, lambda x, j: (j % rows == mid_r) | (F.floor(j / rows) == mid_c)), number)

        return with_pixels(a, F.transform(a["pixels"], lambda x, i: at(i)))


for _name, _f in (("avg", _mean), ("max", F.array_max), ("min", F.array_min)):
    _pool(f"{_name}pool_blocks", _f, False)
    _pool(f"{_name}pool_cross_blocks", _f, True)

_count = lambda v, x: F.size(F.filter(v, lambda y: y == x)).cast("double")
#: Reducers of a sliding window, and whether the result is scaled to 0..1.
POOLERS = {
    "meanpool": (_mean, False),
    "maxpool": (F.array_max, False),
    "minpool": (F.array_min, False),
    "stdpool": (_std, False),
    "medianpool": (lambda v: _quantile(v, 0.5), False),
    "uniquecountpool": (lambda v: F.size(F.array_distinct(v)).cast("double"), True),
    "argmaxcountpool": (lambda v: _count(v, F.array_max(v)), True),
    "argmincountpool": (lambda v: _count(v, F.array_min(v)), True),
    "iqrpool": (lambda v: _quantile(v, 0.75) - _quantile(v, 0.25), False),
}


def _pooler(name: str, number: Callable[[Column], Column], scaled: bool) -> None:
    @op("image number number", "image", name=name, defaults=(2.0, 1.0))
    def build(a, k, stride):
        h, w = a["h"], a["w"]
        whole = lambda x: F.greatest(F.lit(1), F.bround(x.cast("double"), 0).cast("int"))
        k, s = F.least(whole(k), h, w), whole(stride)
        rows, cols = F.floor((h - k) / s).cast("int") + 1, F.floor((w - k) / s).cast("int") + 1
        windows = F.transform(F.sequence(F.lit(0), rows * cols - 1), lambda j: let(_window(a, F.lit(0), (j % rows) * s, (j % rows) * s + k - 1, F.floor(j / rows) * s, F.floor(j / rows) * s + k - 1), number))
        small = normalize(windows) if scaled else F.transform(windows, clamp01)  # one number a window, worked out once an image
        back = lambda i: F.floor((i % h) * rows / h) + F.floor(F.floor(i / h) * cols / w) * rows
        return with_pixels(a, let(small, lambda v: F.transform(a["pixels"], lambda x, i: F.get(v, back(i).cast("int")))))


for _name, (_f, _scaled) in POOLERS.items():
    _pooler(_name, _f, _scaled)


# ---- numbers from images


def _number(name: str, f: Callable[[Column], Column], returns: str = "float") -> None:
    op("image", returns, name=name)(f)


def _mode(p: Column) -> Column:
    """(count, value) of the most frequent value; of equals the smallest."""
    return let(p, lambda v: F.array_max(F.transform(F.array_distinct(v), lambda x: F.struct(_count(v, x).alias("n"), (-x).alias("v")))))


def _argmax(a: Column) -> Column:
    return F.array_position(a["pixels"], F.array_max(a["pixels"])) - 1


_number("reduce_length", lambda a: F.size(a["pixels"]).cast("bigint"), "int")
_number("reduce_biggestAxis", lambda a: F.greatest(a["h"], a["w"]), "int")
_number("reduce_smallerAxis", lambda a: F.least(a["h"], a["w"]), "int")
_number("reduce_histMode", lambda a: -_mode(a["pixels"])["v"])
_number("reduce_histModeCount", lambda a: _mode(a["pixels"])["n"])
_number("reduce_propWhite", lambda a: _count(a["pixels"], F.lit(1.0)) / F.size(a["pixels"]))
_number("reduce_propBlack", lambda a: _count(a["pixels"], F.lit(0.0)) / F.size(a["pixels"]))
_number("reduce_nColors", lambda a: F.size(F.array_distinct(a["pixels"])), "int")
_number("reduce_mean", lambda a: _mean(a["pixels"]))
_number("reduce_median", lambda a: _quantile(a["pixels"], 0.5))
_number("reduce_std", lambda a: _std(a["pixels"]))
_number("reduce_maximum", lambda a: F.array_max(a["pixels"]))
_number("reduce_minimum", lambda a: F.array_min(a["pixels"]))
_number("experimental_horizontal_argmax", lambda a: F.floor(_argmax(a) / a["h"]) + 1, "int")
_number("experimental_vertical_argmax", lambda a: _argmax(a) % a["h"] + 1, "int")
_number("experimental_horizontal_relative_argmax", lambda a: (F.floor(_argmax(a) / a["h"]) + 1) / a["w"])
_number("experimental_vertical_relative_argmax", lambda a: (_argmax(a) % a["h"] + 1) / a["h"])


def _centre(size: Column, at: Column) -> Column:
    """0-based place of a coordinate in 0..1."""
    return (F.greatest(F.lit(1), F.least(size, F.bround(at.cast("double") * (size - 1), 0).cast("int") + 1)) - 1).cast("int")


def _entropy8(v: Column) -> Column:
    bins = lambda v: _range(v, lambda lo, hi: F.transform(v, lambda x: F.least(F.lit(7), F.floor(F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)) * 8))))
    shares = let(let(v, bins), lambda b: F.transform(F.array_distinct(b), lambda x: _count(b, x) / F.size(b)))
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


REGIONS = {
    "mean": _mean,
    "std": _std,
    "min": F.array_min,
    "max": F.array_max,
    "sum": lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x),
    "median": lambda v: _quantile(v, 0.5),
    "range": lambda v: F.array_max(v) - F.array_min(v),
    "energy": lambda v: _mean(F.transform(v, lambda x: x * x)),
    "entropy": _entropy8,
}


def _half(a: Column, share: float | None) -> Column:
    """Half the side of a region: 1, or by a share of the smaller axis, made odd."""
    if share is None:
        return F.lit(1)
    side = F.greatest(F.lit(1), F.bround(F.least(a["h"], a["w"]) * F.lit(share), 0).cast("int"))
    return F.floor((side + F.when(side % 2 == 0, 1).otherwise(0)) / 2).cast("int")


def _region(name: str, number: Callable[[Column], Column] | None, share: float | None) -> None:
    @op("image number number", "float", name=name)
    def build(a, cx, cy):
        half = _half(a, share)
        i = _centre(a["h"], cy) + _centre(a["w"], cx) * a["h"]
        patch = _window(a, i, -half, half, -half, half)
        if number is not None:
            return let(patch, number)
        outer = half + F.greatest(F.lit(1), half)
        wide = _window(a, i, -outer, outer, -outer, outer)
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        ring = F.try_divide(total(wide) - total(patch), F.size(wide) - F.size(patch))
        return _mean(patch) - F.coalesce(ring, _mean(patch))


for _share, _suffix in ((None, ""), (0.05, "_5p"), (0.10, "_10p"), (0.20, "_20p")):
    for _name, _f in (*REGIONS.items(), ("contrast", None)):
        _region(f"region_{_name}{_suffix}", _f, _share)


#: Signs of the halves, quadrants or thirds of a patch, from the offsets and the half size.
HAAR = {
    "haar_lr": lambda r, c, n: F.signum(-c),
    "haar_tb": lambda r, c, n: F.signum(-r),
    "haar_diag_main": lambda r, c, n: F.signum(r * c),
    "haar_diag_anti": lambda r, c, n: F.signum(-r * c),
    "haar_center_surround": lambda r, c, n: F.when((F.abs(r) * 3 <= n) & (F.abs(c) * 3 <= n), 1.0).otherwise(-1.0),
    "haar_three_h": lambda r, c, n: F.when(F.abs(c) * 3 <= n, -1.0).otherwise(1.0),
    "haar_three_v": lambda r, c, n: F.when(F.abs(r) * 3 <= n, -1.0).otherwise(1.0),
}


def _haar(name: str, sign: Callable[[Column, Column, Column], Column]) -> None:
    @op("image number number", "float", name=name)
    def build(a, position, region):
        h, w = a["h"], a["w"]
        half = F.greatest(F.bround(F.abs(region.cast("double")), 0).cast("int"), F.lit(1))
        at = F.greatest(F.lit(0), F.least(h * w - 1, F.bround(position.cast("double") * (h * w - 1), 0).cast("int")))
        r, c = at % h, F.floor(at / h).cast("int")
        marked = F.transform(a["pixels"], lambda x, i: F.struct((i % h - r).alias("r"), (F.floor(i / h) - c).alias("c"), x.alias("x")))
        near = F.filter(marked, lambda m: (F.abs(m["r"]) <= half) & (F.abs(m["c"]) <= half))
        side = lambda v, s: F.coalesce(_mean(F.transform(F.filter(v, lambda m: sign(m["r"], m["c"], half) == s), lambda m: m["x"])), F.lit(0.0))
        return let(near, lambda v: side(v, 1.0) - side(v, -1.0))


for _name, _f in HAAR.items():
    _haar(_name, _f)


# ---- orientation


def _gradients(a: Column) -> Column:
    """(magnitude, angle in 0..pi) of each pixel, with edges repeated."""
    sobel = DERIVATIVES["sobel"]
    gx, gy = correlate(a, _grid(sobel), F.lit(0)), correlate(a, _grid(_transposed(sobel)), F.lit(0))
    return F.zip_with(gx, gy, lambda x, y: F.struct(F.sqrt(x * x + y * y).alias("m"), F.pmod(F.atan2(y, x) + math.pi, F.lit(math.pi)).alias("t")))


@op("image", "image")
def grad_magnitude(a):
    return with_pixels(a, normalize(F.transform(_gradients(a), lambda g: g["m"])))


@op("image", "image")
def grad_orientation(a):
    return with_pixels(a, F.transform(_gradients(a), lambda g: g["t"] / math.pi))


def _apart(t: Column, u: Column) -> Column:
    d = F.abs(t - u)
    return F.least(d, math.pi - d)


@op("image number number", "image", defaults=(0.0, 0.2))
def orientation_select(a, theta, width):
    """Magnitudes whose direction is within width of theta."""
    t, b = F.pmod(theta.cast("double"), F.lit(1.0)) * math.pi, F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.abs(width.cast("double")))) * (math.pi / 2)
    return with_pixels(a, normalize(F.transform(_gradients(a), lambda g: F.when(_apart(g["t"], t) <= b, g["m"]).otherwise(0.0))))


def _energy(a: Column) -> Column:
    """Share of the magnitude nearest to 0, 45, 90 and 135 degrees."""
    kind = lambda x: F.pmod(F.bround(x["t"] / (math.pi / 4), 0), F.lit(4))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x["m"])
    part = lambda g, b: F.coalesce(F.try_divide(total(F.filter(g, lambda x: kind(x) == b)), total(g)), F.lit(0.0))
    return let(_gradients(a), lambda g: F.array(*[part(g, b) for b in range(4)]))


@op("image", "float", fallback=-1.0)
def orientation_coherence(a):

    def of(g: Column) -> Column:
        total = lambda f: F.aggregate(g, F.lit(0.0), lambda s, x: s + f(x))
        c, s, m = total(lambda x: x["m"] * F.cos(2 * x["t"])), total(lambda x: x["m"] * F.sin(2 * x["t"])), total(lambda x: x["m"])
        return F.when(m == 0, 0.0).otherwise(F.try_divide(F.sqrt(c * c + s * s), m))

    return let(_gradients(a), of)


@op("image", "float", fallback=-1.0)
def orientation_spread(a):
    flat = F.aggregate(_gradients(a), F.lit(0.0), lambda s, x: s + x["m"]) == 0
    return F.when(flat, 0.0).otherwise(1 - orientation_coherence(a))


@op("image", "float", fallback=-1.0)
def dominant_orientation(a):
    return let(_energy(a), lambda e: F.when(F.array_max(e) == 0, 0.0).otherwise((F.array_position(e, F.array_max(e)) - 1) / 4))


for _b, _degrees in enumerate((0, 45, 90, 135)):
    op("image", "float", name=f"orientation_energy_{_degrees}", fallback=-1.0)(lambda a, b=_b: F.get(_energy(a), F.lit(b)))


# ---- co-occurrence of grey levels

#: (row, column) steps of the four directions.
DIRECTIONS = ((0, -1), (-1, -1), (-1, 0), (-1, 1))


def _pairs(a: Column, step: tuple[int, int], distance: Column, levels: Column) -> Column:
    """(i, j) levels of neighbours at the distance, in both orders."""
    h, w, p = a["h"], a["w"], a["pixels"]
    grey = _range(p, lambda lo, hi: F.transform(p, lambda x: F.least(levels - 1, F.floor(F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)) * levels)).cast("double")))
    dr, dc = distance * step[0], distance * step[1]
    inside = lambda i: (i % h + dr).between(0, h - 1) & (F.floor(i / h) + dc).between(0, w - 1)
    both = lambda v: F.filter(F.transform(v, lambda x, i: F.when(inside(i), F.struct(x.alias("i"), F.get(v, (i + dr + dc * h).cast("int")).alias("j")))), lambda x: x.isNotNull())
    return let(let(grey, both), lambda v: F.concat(v, F.transform(v, lambda x: F.struct(x["j"].alias("i"), x["i"].alias("j")))))


def _over(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x)), F.size(v))


def _shares(v: Column) -> Column:
    """How often each pair of levels occurs, as a share of all; a pair is one number."""
    codes = F.transform(v, lambda x: x["i"] * 256 + x["j"])
    return let(codes, lambda c: F.transform(F.array_distinct(c), lambda x: _count(c, x) / F.size(c)))


def _variance(v: Column) -> Column:
    return let(_over(v, lambda x: x["i"]), lambda m: _over(v, lambda x: (x["i"] - m) * (x["i"] - m)))


def _correlation(v: Column) -> Column:
    together = let(_over(v, lambda x: x["i"]), lambda m: _over(v, lambda x: (x["i"] - m) * (x["j"] - m)))
    return F.try_divide(together, _variance(v))


_total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
GLCM = {
    "glcm_mean_ref": lambda v: _over(v, lambda x: x["i"]),
    "glcm_var_ref": _variance,
    "correlation": _correlation,
    "contrast": lambda v: _over(v, lambda x: (x["i"] - x["j"]) * (x["i"] - x["j"])),
    "IDM": lambda v: _over(v, lambda x: 1 / (1 + (x["i"] - x["j"]) * (x["i"] - x["j"]))),
    "ASM": lambda v: _total(_shares(v), lambda p: p * p),
    "glcm_entropy": lambda v: _total(_shares(v), lambda p: -p * F.log(p)),
    "max_prob": lambda v: F.array_max(_shares(v)),
    "energy": lambda v: F.sqrt(_total(_shares(v), lambda p: p * p)),
    "dissimilarity": lambda v: _over(v, lambda x: F.abs(x["i"] - x["j"])),
}
SUMMARIES = {"mean": _mean, "sum": lambda v: _total(v, lambda x: x), "std": _std, "minimum": F.array_min, "maximum": F.array_max}


def _glcm(name: str, prop: Callable[[Column], Column], summary: Callable[[Column], Column]) -> None:
    @op("image number number", "float", name=name, fallback=-1.0, defaults=(1.0, 16.0))
    def build(a, distance, levels):
        d = F.greatest(F.lit(1), F.least(F.lit(10), F.bround(distance.cast("double"), 0).cast("int")))
        colours = F.size(F.array_distinct(a["pixels"]))
        n = F.greatest(F.least(F.lit(5), colours), F.least(F.lit(255), F.bround(levels.cast("double"), 0).cast("int")))
        return let(n, lambda k: let(F.array(*[let(_pairs(a, s, d, k), prop) for s in DIRECTIONS]), summary))


for _name, _f in GLCM.items():
    for _short, _g in SUMMARIES.items():
        _glcm(f"glcm_{_name}_{_short}", _f, _g)
