"""Binarisation and segmentation against plain loops and planted classes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import binarize
from sparkloom.functions.images import image
from sparkloom.plans import program
from sparkloom.registry import REGISTRY as op

IMG = "struct<h:int,w:int,kind:string,pixels:array<double>>"


def apply(spark, name, h, w, pixels, *args, types=()):
    row = spark.createDataFrame([((h, w, "intensity", pixels),)], f"img {IMG}")
    column = op(name, F.col("img"), *args, types=["image", *types])
    got = row.select(column.alias("x")).first()["x"]
    return None if got is None else (got["kind"], got["pixels"])


def two_classes():
    rng = np.random.default_rng(5)
    truth = np.arange(400) % 20 < 8
    return np.clip(np.where(truth, rng.normal(0.8, 0.04, 400), rng.normal(0.2, 0.04, 400)), 0, 1).tolist(), truth.astype(float).tolist()


@pytest.mark.parametrize("name", [n for n in binarize.HISTOGRAM if n not in ("binarize_unimodalrosin2D", "binarize_entropy2D", "binarize_yen2D")] + ["binarize_polysegment2D"])
def test_two_classes_are_told_apart(spark, name):
    pixels, truth = two_classes()
    kind, got = apply(spark, name, 20, 20, pixels)
    assert kind == "binary" and sum(a != b for a, b in zip(got, truth, strict=True)) <= 4


def test_rosin_finds_the_corner():
    n = np.array([1000, 400, 100, 20, 10, 8, 6, 4, 2, 1])
    assert binarize.rosin(n) in (2, 3)


def test_entropy_and_yen_against_all_cuts():
    """Both maximise a criterion, which may cut into a narrow class."""
    log = lambda x: math.log(x) if x > 0 else 0.0
    rng = np.random.default_rng(2)
    for _ in range(20):
        p = rng.integers(1, 30, 12) / 1.0
        p /= p.sum()
        own = lambda q: -sum(x / q.sum() * log(x / q.sum()) for x in q)
        kapur = [own(p[:c]) + own(p[c:]) for c in range(1, 12)]
        yen = [-log((p[:c] ** 2).sum() * (p[c:] ** 2).sum()) + 2 * log(p[:c].sum() * p[c:].sum()) for c in range(1, 12)]
        assert math.isclose(kapur[binarize.entropy(p) - 1], max(kapur)) and math.isclose(yen[binarize.yen(p) - 1], max(yen))


def test_otsu_against_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(0, 9, 12)
        n[[0, -1]] += 1
        v = np.repeat(np.arange(12), n)
        spread = [(v < c).mean() * (v >= c).mean() * (v[v < c].mean() - v[v >= c].mean()) ** 2 for c in range(1, 12)]
        assert math.isclose(spread[binarize.otsu(n) - 1], max(spread))


@pytest.mark.parametrize(("name", "rule"), [("binarize_adaptive2D", lambda m, s: m * 0.85), ("binarize_niblack2D", lambda m, s: m + 0.2 * s), ("binarize_sauvola2D", lambda m, s: m * (1 + 0.2 * (s / 0.5 - 1)))])
def test_local_windows_against_loops(spark, name, rule):
    h, w = 9, 7
    p = np.random.default_rng(3).random((w, h))
    reach = 2 if name == "binarize_adaptive2D" else 5
    want = []
    for c in range(w):
        for r in range(h):
            near = p[max(0, c - reach) : c + reach + 1, max(0, r - reach) : r + reach + 1]
            want.append(float(p[c, r] > rule(near.mean(), near.std())))
    assert apply(spark, name, h, w, p.reshape(-1).tolist(), F.lit(5), types=["int"]) == ("binary", want)


def test_manual_overloads(spark):
    p = [0.1, 0.5, 0.9, 0.4]
    assert apply(spark, "binarize_manual2D", 2, 2, p) == ("binary", [0.0, 1.0, 1.0, 0.0])
    assert apply(spark, "binarize_manual2D", 2, 2, p, F.lit(7.0), types=["float"]) == ("binary", [0.0] * 4)
    assert apply(spark, "binarize_manual2D", 2, 2, p, F.lit(51), types=["int"]) == ("binary", [0.0, 1.0, 1.0, 1.0])
    other = image(F.lit(1), F.lit(2), "intensity", F.array(F.lit(0.8), F.lit(1.0)))
    assert apply(spark, "binarize_manual2D", 2, 2, p, other, types=["image"]) == ("binary", [0.0, 0.0, 1.0, 0.0])


def test_growing_joins_regions():
    left, right = [0.1, 0.12, 0.11], [0.9, 0.88, 0.91]
    assert binarize.grow(left + right + right, 3, 3, 0.1) == [1.0] * 3 + [2.0] * 6
    # A U: two arms that meet further on are one segment.
    assert binarize.grow([1, 1, 1, 0, 0, 1, 1, 1, 1], 3, 3, 0.1) == [1, 1, 1, 2, 2, 1, 1, 1, 1]


def test_flood_parts_two_basins():
    h, w = 5, 21
    wall = np.zeros((w, h))
    wall[[0, 10, 20]] = 1
    got = np.array(binarize.flood(wall.reshape(-1), np.ones(h * w), h, w, -3)).reshape(w, h)
    assert set(got[1:10].reshape(-1)) == {1.0} and set(got[11:20].reshape(-1)) == {2.0} and (got > 0).all()
    half = np.ones((w, h))
    half[11:] = 0
    assert set(np.array(binarize.flood(wall.reshape(-1), half.reshape(-1), h, w, -3)).reshape(w, h)[11:].reshape(-1)) == {0.0}


@pytest.mark.parametrize("name", ["binarize_otsu2D", "binarize_niblack2D", "binarize_polysegment2D", "fastscanning_image2D", "watershed_image2D"])
def test_edges_do_not_fail(spark, name):
    assert apply(spark, name, 0, 0, []) is None and apply(spark, name, 0, 0, None) is None
    kind, got = apply(spark, name, 2, 2, [0.5, float("nan"), 0.5, 0.5])
    assert kind in ("binary", "segment") and len(got) == 4 and all(x == x for x in got)
    assert len(apply(spark, name, 2, 2, [0.5] * 4)[1]) == 4


def test_later_steps_may_use_the_result(spark):
    img = program.Input("img", "image")
    out = program.call("experimental_tobinary_image2D", program.call("fastscanning_image2D", img))
    df = spark.createDataFrame([((1, 4, "intensity", [0.1, 0.1, 0.9, 0.9]),)], f"img {IMG}")
    assert program.project(df, {"x": out}).first()["x"]["pixels"] == [0.0, 0.0, 1.0, 1.0]
