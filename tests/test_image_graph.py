"""Graphs of image regions against breadth-first searches and all triangles, image by image."""

import itertools
import math
import statistics
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import image_graph as graph
from sparkloom.functions.images import image
from sparkloom.plans.program import Input, call, project
from sparkloom.registry import REGISTRY as op


def regions(img, r):
    """(first place, pixels) of each region, by flooding."""
    h, w = img.shape
    left, out = {(i, j) for i in range(h) for j in range(w) if img[i, j]}, []
    while left:
        start = min(left, key=lambda p: p[1] * h + p[0])
        seen, todo = {start}, [start]
        while todo:
            i, j = todo.pop()
            near = {(a, b) for a, b in left - seen if abs(a - i) <= r and abs(b - j) <= r}
            seen |= near
            todo += near
        left -= seen
        out.append(seen)
    return out


def edges(points):
    """The sides of all triangles whose circle holds no other point."""
    found = set()
    for t in itertools.combinations(range(len(points)), 3):
        (ax, ay), (bx, by), (cx, cy) = (points[k] for k in t)
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        x = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        y = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        radius = math.dist((x, y), (ax, ay))
        if all(math.dist((x, y), points[k]) > radius for k in range(len(points)) if k not in t):
            found |= {tuple(sorted(p)) for p in itertools.combinations(t, 2)}
    return found


def plain(points, linked):
    """All measures by name, node by node."""
    n = len(points)
    around = [{b for e in linked for a, b in (e, e[::-1]) if a == v} for v in range(n)]
    far, ways = [], []
    for s in range(n):
        d, c, todo = {s: 0}, Counter({s: 1}), deque([s])
        while todo:
            v = todo.popleft()
            for u in sorted(around[v]):
                if u not in d:
                    d[u] = d[v] + 1
                    todo.append(u)
                if d[u] == d[v] + 1:
                    c[u] += c[v]
        far.append(d)
        ways.append(c)
    between, stress = [0.0] * n, [0] * n
    for v in range(n):
        for s in range(n):
            if s == v:
                continue
            between[v] += sum(ways[s][v] * ways[v][t] / ways[s][t] for t in range(n) if t not in (s, v) and far[s][v] + far[v][t] == far[s][t])

            def below(u):  # noqa: B023
                return sum(1 + below(x) for x in around[u] if far[s][x] == far[s][u] + 1)  # noqa: B023

            stress[v] += below(v)
    closed = [sum(b in around[a] for a, b in itertools.combinations(around[v], 2)) for v in range(n)]
    pairs = [math.comb(len(around[v]), 2) for v in range(n)]
    total, rim = [sum(d.values()) for d in far], [max(d.values()) for d in far]
    matrix = np.array([[float(j in around[i]) for j in range(n)] for i in range(n)])
    x = np.ones(n)
    for _ in range(5000):
        x = matrix @ x + x
        x /= np.linalg.norm(x)
    degree = [len(a) / (n - 1) for a in around]
    nodes = {"betweennesscentrality": [b / ((n - 1) * (n - 2)) for b in between], "closenesscentrality": [(n - 1) / t for t in total], "degreecentrality": degree, "indegreecentrality": degree, "outdegreecentrality": degree, "eigenvectorcentrality": list(x), "radialitycentrality": [(max(rim) + 1 - t / (n - 1)) / max(rim) for t in total], "stresscentrality": stress, "clusteringcoefficient": [c / p if p else 0.0 for c, p in zip(closed, pairs, strict=True)], "triangles": closed, "eccentricity": rim}
    out = {}
    for k, v in nodes.items():
        out |= {f"mean{k}": statistics.mean(v), f"median{k}": statistics.median(v), f"minimum{k}": min(v), f"maximum{k}": max(v), f"std{k}": statistics.stdev(v)}
        top, low = v.index(max(v)), v.index(min(v))
        if k not in ("eigenvectorcentrality", "betweennesscentrality"):  # ties of rounded numbers fall either way
            out |= {f"xcoorargmax{k}": points[top][0], f"ycoorargmax{k}": points[top][1], f"xcoorargmin{k}": points[low][0], f"ycoorargmin{k}": points[low][1]}
    ends = [(len(around[a]) - 1, len(around[b]) - 1) for e in linked for a, b in (e, e[::-1])]
    a, b = zip(*ends, strict=True)
    mean = statistics.mean(a)
    spread = statistics.mean([i * i for i in a]) - mean**2
    out["assortativity"] = (statistics.mean([i * j for i, j in ends]) - mean**2) / spread if spread > 1e-12 else None
    out |= {"clustering_coefficient": sum(closed) / sum(pairs), "diameter": max(rim)}
    label = list(range(n))
    while True:
        before = list(label)
        for v in range(n):
            count = Counter(label[u] for u in around[v])
            best = max(count.values())
            label[v] = label[v] if count[label[v]] == best else min(c for c in count if count[c] == best)
        if before == label:
            break
    return out | {"label_propagation": len(set(label))}


def pictures(seed, n, h=8, w=8):
    rng = np.random.default_rng(seed)
    return [rng.random((h, w)) < rng.choice([0.1, 0.2, 0.3, 0.5]) for _ in range(n)]


@pytest.mark.parametrize("r", [1, 2])
def test_all_measures_against_plain_searches(spark, r):
    imgs = [*pictures(1, 40), *pictures(2, 10, 6, 11), np.zeros((8, 8), bool), np.ones((8, 8), bool), np.eye(8, dtype=bool) & (np.arange(8) % 3 == 0)]
    rows = [(k, *i.shape, i.T.ravel().astype(float).tolist()) for k, i in enumerate(imgs)] + [(len(imgs), 8, 8, None)]
    df = spark.createDataFrame(rows, "id int, h int, w int, p array<double>").select("id", image(F.col("h"), F.col("w"), "binary", F.col("p")).alias("img"), F.lit(1.0 if r == 1 else 0.0).alias("r"))
    img, window = Input("img", "image"), Input("r", "float")
    got = {row["id"]: row.asDict() for row in project(df, {k: call(k, img, window) for k in graph.NAMES}).collect()}
    seen = 0
    for k, i in enumerate(imgs):
        parts = regions(i, r)
        points = [tuple(np.mean(list(p), axis=0) + 1) for p in parts]
        if len(points) < 3 or np.linalg.matrix_rank(np.array(points) - np.mean(points, axis=0), tol=1e-6) < 2:
            assert {got[k][m] for m in graph.NAMES} == {0.0}
            continue
        linked = {tuple(e) for e in graph.triangulate(graph.shaken(np.array(points))).tolist()}
        for name, want in plain(points, linked).items():
            value = got[k][name]
            assert math.isnan(value) if want is None else abs(value - want) < 1e-6, (k, name, value, want)
        seen += 1
    assert seen > 8 and {got[len(imgs)][m] for m in graph.NAMES} == {0.0}


def test_triangulation_against_all_triangles():
    rng = np.random.default_rng(3)
    for n in [3, 4, 5, 8, 13, 30]:
        for _ in range(10):
            points = rng.random((n, 2)) * 10
            assert {tuple(e) for e in graph.triangulate(points).tolist()} == edges(points.tolist())
    # Points of a grid lie on circles and lines: still a triangulation of the hull, with 3 n - 3 - b edges.
    grid = graph.shaken(np.array([(i, j) for i in range(7) for j in range(6)], float))
    found = graph.triangulate(grid)
    assert 3 * 42 - 3 - 42 < len(found) <= 3 * 42 - 3 - 4
    many = rng.random((1500, 2))
    assert len(graph.triangulate(many)) > 2.9 * 1500


def test_labels_of_long_and_winding_regions():
    snake = np.zeros((1, 61, 61), bool)
    snake[0, ::4] = True
    snake[0, 2::8, -1] = snake[0, 1::8, -1] = snake[0, 3::8, -1] = True
    snake[0, 6::8, 0] = snake[0, 5::8, 0] = snake[0, 7::8, 0] = True
    assert len(np.unique(graph.label_regions(snake, 1))) == 2
    for r in (1, 2):
        for img in pictures(5, 30, 9, 7):
            places = graph.label_regions(img[None], r)[0]
            assert [sorted(zip(*np.nonzero(places == p), strict=True)) for p in np.unique(places[places >= 0])] == [sorted(p) for p in regions(img, r)]


def test_operators_as_columns_and_shared_work(spark):
    i = pictures(7, 1)[0]
    df = spark.createDataFrame([(i.T.ravel().astype(float).tolist(),)], "p array<double>").select(image(F.lit(8), F.lit(8), "binary", F.col("p")).alias("img"))
    one = df.select(op("meandegreecentrality", F.col("img")).alias("x")).first()["x"]
    img = Input("img", "image")
    both = project(df, {"a": call("meandegreecentrality", img), "b": call("diameter", img), "c": call("meandegreecentrality", call("erosion_2D", img))})
    assert both.first()["a"] == one and len([n for n in both._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in n]) <= 2
    assert len(graph.NAMES) == 103 and all(n in op.ops for n in graph.NAMES)
