"""Window operators in programs against the same operators as expressions, over shapes, borders, constant and odd images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import windows
from sparkloom.functions.images import image
from sparkloom.plans.program import Constant, Input, call, project
from sparkloom.registry import REGISTRY as op

IMG = Input("img", "image")


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h, w, kind in ((6, 5, "intensity"), (9, 7, "intensity"), (4, 8, "binary"), (1, 1, "intensity"), (1, 6, "segment"), (5, 5, "segment")):
        for k in range(2):
            p = rng.random(h * w) if kind == "intensity" else np.floor(rng.random(h * w) * (2 if kind == "binary" else 5))
            rows.append((h, w, kind, (p if k else np.round(p, 1)).tolist(), float(rng.integers(-1, 2)), float(rng.integers(1, 9))))
    rows += [(3, 4, "intensity", [0.5] * 12, 0.0, 1.0), (2, 2, "intensity", [0.0, float("nan"), 1.0, 0.5], 1.0, 4.0), (2, 2, "intensity", None, 0.0, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, h int, w int, kind string, p array<double>, mode double, k double")
    return df.select("id", image(F.col("h"), F.col("w"), F.col("kind"), F.col("p")).alias("img"), "mode", "k").cache()


def same(a, b):
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return a is b is None or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9))


def both(pictures, nodes, columns, kept="id"):
    made = {r["id"]: r for r in project(pictures, nodes).collect()}
    direct = {r["id"]: r for r in pictures.select("id", *[c.alias(k) for k, c in columns.items()]).collect()}
    for i in direct:
        for k in nodes:
            x, y = made[i][k], direct[i][k]
            x, y = (x["pixels"] if x is not None and not isinstance(x, float) else x), (y["pixels"] if y is not None and not isinstance(y, float) else y)
            assert same(x, y), (i, k, x, y)


@pytest.mark.parametrize("names", [["ando4x_image2D", "sobelm_image2D", "gaussian9_image2D", "scharry_image2D"]])
def test_filters(pictures, names):
    some = pictures.where("id <> 13")  # NaN pixels: sums over them are NaN in one place or another
    both(some, {n: call(n, IMG, Input("mode", "float")) for n in names[:3]}, {n: op(n, F.col("img"), F.col("mode")) for n in names[:3]})
    both(some, {n: call(n, IMG) for n in names[3:]}, {n: op(n, F.col("img")) for n in names[3:]})


def test_morphology(pictures):
    some = pictures.where("id <> 13")
    both(some, {n: call(n, IMG, Input("k", "float")) for n in windows.MORPHOLOGY}, {n: op(n, F.col("img"), F.col("k")) for n in windows.MORPHOLOGY})
    both(some, {"e": call("erosion_2D", IMG)}, {"e": op("erosion_2D", F.col("img"))})


@pytest.mark.parametrize("args", [(), (3.0, 300.0)])
def test_cooccurrences(pictures, args):
    some = pictures.where("id not in (13)")
    names = [n for n in windows.GLCM_NAMES if n.endswith("_minimum") or "correlation" in n or not args and n.endswith("_std")]
    both(some, {n: call(n, IMG, *[Constant(a, "float") for a in args]) for n in names}, {n: op(n, F.col("img"), *[F.lit(a) for a in args]) for n in names})


@pytest.mark.parametrize("at", [(0.4, 0.9)])
def test_regions(pictures, at):
    some = pictures.where("id not in (13)")
    both(some, {n: call(n, IMG, *[Constant(a, "float") for a in at]) for n in windows.REGION_NAMES[::3]}, {n: op(n, F.col("img"), *[F.lit(a) for a in at]) for n in windows.REGION_NAMES[::3]})


def test_programs_nest_and_share(pictures):
    edge = call("sobelm_image2D", call("gaussian5_image2D", IMG))
    out = project(pictures.where("id < 4"), {"a": call("glcm_contrast_mean", edge), "b": call("glcm_ASM_maximum", edge), "c": call("reduce_mean", edge)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_glcm_measured") == 1 and all(r["a"] is not None and r["c"] is not None for r in out.collect())
