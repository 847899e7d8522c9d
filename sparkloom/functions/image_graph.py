"""Graph measures of binary images: set regions are nodes at their centroids, joined by a Delaunay triangulation.

All measures of an image come from one pandas UDF, as one array; each operator picks its number, so that a program with
many of them labels, triangulates and searches once. In a batch images of one shape are labelled together and graphs
with equally many nodes are one tensor: breadth-first search, path counts, betweenness and stress go level by level
over all sources of all graphs at once. Fewer than three regions, or centroids on one line, give NULL, whose fallback is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..registry import REGISTRY, op

#: Fixed names: measures of nodes, what is told of them, measures of the whole graph.
NODE_MEASURES = ("betweennesscentrality", "closenesscentrality", "degreecentrality", "indegreecentrality", "outdegreecentrality", "eigenvectorcentrality", "radialitycentrality", "stresscentrality", "clusteringcoefficient", "triangles", "eccentricity")
STATISTICS = ("mean", "median", "minimum", "maximum", "std", "xcoorargmax", "ycoorargmax", "xcoorargmin", "ycoorargmin")
GRAPH_MEASURES = ("assortativity", "clustering_coefficient", "diameter", "label_propagation")
NAMES = (*[f"{s}{m}" for m in NODE_MEASURES for s in STATISTICS], *GRAPH_MEASURES)
#: Numbers in the adjacency matrices of the graphs that are worked on at once.
CELLS = 2_000_000
JITTER, LINE = 1e-8, 1e-8


def label_regions(images: np.ndarray, r: int) -> np.ndarray:
    """images (n, h, w) of booleans: for each set pixel the least column-major place in its region, counted in its image; -1 elsewhere.

    Pixels are joined in windows of 2 r + 1. Places fall to the least in the window and to the place of that place, so
    that the rounds grow with the logarithm of a region's length.
    """
    n, h, w = images.shape
    own = np.broadcast_to(np.arange(h)[:, None] + np.arange(w)[None, :] * h, images.shape)
    none = h * w
    at = np.where(images, own, none)
    while True:
        wide = np.pad(at, ((0, 0), (r, r), (r, r)), constant_values=none)
        low = at
        for i in range(2 * r + 1):
            for j in range(2 * r + 1):
                low = np.minimum(low, wide[:, i : i + h, j : j + w])
        low = np.where(images, low, none)
        flat = np.concatenate([low.transpose(0, 2, 1).reshape(n, -1), np.full((n, 1), none)], axis=1)
        low = np.take_along_axis(flat, low.reshape(n, -1), axis=1).reshape(n, h, w)
        if (low == at).all():
            return np.where(images, at, -1)
        at = low


def centroids(places: np.ndarray) -> np.ndarray:
    """(row, column) of the middle of each region of one image, from 1, by the regions' first places."""
    rows, columns = np.nonzero(places >= 0)
    _, of, sizes = np.unique(places[rows, columns], return_inverse=True, return_counts=True)
    return np.column_stack([np.bincount(of, weights=v) / sizes + 1 for v in (rows, columns)]) if len(sizes) else np.zeros((0, 2))


def on_a_line(points: np.ndarray) -> bool:
    spread = np.linalg.svd(points - points.mean(axis=0), compute_uv=False)
    return bool(spread[-1] < LINE * (spread[0] + np.finfo(float).eps))


def shaken(points: np.ndarray) -> np.ndarray:
    """Moved by about 1e-8, by a rule of their numbers, so that no four lie on a circle."""
    k = np.arange(1, len(points) + 1)
    return points + JITTER * np.column_stack([((7 * k * k + 31 * k) % 101 - 50) / 50, ((13 * k * k + 17 * k) % 103 - 51) / 51])


def _turn(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])


def _in_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b, c = a - p, b - p, c - p
    aa, bb, cc = ((x * x).sum(axis=1) for x in (a, b, c))
    return aa * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]) - bb * (a[:, 0] * c[:, 1] - a[:, 1] * c[:, 0]) + cc * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])


def triangulate(points: np.ndarray) -> np.ndarray:
    """The edges (i, j) of the Delaunay triangulation, by inserting points; outside the hull each edge has a triangle with the point -1."""
    first = [0, 1, 2] if _turn(points[:1], points[1:2], points[2])[0] > 0 else [0, 2, 1]
    a, b, c = first
    triangles = np.array([first, [b, a, -1], [c, b, -1], [a, c, -1]])
    n = len(points) + 1
    for k in range(3, len(points)):
        p, (i, j, m) = points[k], triangles.T
        hit = np.where(m < 0, _turn(points[i], points[j], p) > 0, _in_circle(points[i], points[j], points[m], p) > 0)
        gone = triangles[hit]
        u, v = gone.ravel(), np.roll(gone, -1, axis=1).ravel()
        outer = ~np.isin(u * n + v, v * n + u)
        u, v = u[outer], v[outer]
        new = np.column_stack([u, v, np.full(len(u), k)])
        new[v < 0] = np.column_stack([new[v < 0][:, 2], new[v < 0][:, 0], new[v < 0][:, 1]])
        new[u < 0] = np.column_stack([new[u < 0][:, 1], new[u < 0][:, 2], new[u < 0][:, 0]])
        triangles = np.concatenate([triangles[~hit], new])
    pairs = np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]])
    return np.unique(np.sort(pairs[(pairs >= 0).all(axis=1)], axis=1), axis=0)


def communities(linked: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """How many labels are left when nodes, one by one in order, take the most frequent label around them; their own stays among equals, else the least."""
    n = linked.shape[1]
    labels = np.broadcast_to(np.arange(n), linked.shape[:2]).copy()
    every = np.arange(len(linked))
    for _ in range(rounds):
        before = labels.copy()
        for v in range(n):
            counts = np.zeros(linked.shape[:2])
            np.add.at(counts, (every[:, None], labels), linked[:, v, :])
            best = counts.max(axis=1)
            own = counts[every, labels[:, v]] == best
            labels[:, v] = np.where(own, labels[:, v], counts.argmax(axis=1))
        if (before == labels).all():
            break
    return np.array([len(np.unique(x)) for x in labels], float)


def measures(linked: np.ndarray, points: np.ndarray) -> np.ndarray:
    """linked (graphs, n, n) of 0 and 1, connected; points (graphs, n, 2): all measures of each graph, in the order of NAMES."""
    n = linked.shape[1]
    far, paths, here = np.where(np.eye(n, dtype=bool), 0.0, np.inf) + np.zeros_like(linked), np.eye(n) + np.zeros_like(linked), np.eye(n) + np.zeros_like(linked)
    level = 0
    while True:
        level += 1
        here = here @ linked
        here[np.isfinite(far)] = 0
        if not here.any():
            break
        far[here > 0] = level
        paths += here
    share, down = np.zeros_like(linked), np.zeros_like(linked)
    for at in range(level - 1, 0, -1):
        now, before = far == at, far == at - 1
        share += np.where(before, paths * ((np.where(now, (1 + share) / np.maximum(paths, 1), 0)) @ linked), 0)
        down += np.where(before, np.where(now, 1 + down, 0) @ linked, 0)
    off = 1 - np.eye(n)
    degree, total = linked.sum(axis=2), far.sum(axis=2)
    rim = far.max(axis=2)
    diameter = rim.max(axis=1)
    triangles = ((linked @ linked) * linked).sum(axis=2) / 2
    pairs = degree * (degree - 1) / 2
    eigen = np.abs(np.linalg.eigh(linked)[1][:, :, -1])
    central = degree / (n - 1)
    nodes = [(share * off).sum(axis=1) / ((n - 1) * (n - 2)), (n - 1) / total, central, central, central, eigen, (diameter[:, None] + 1 - total / (n - 1)) / diameter[:, None], (down * off).sum(axis=1), np.divide(triangles, pairs, out=np.zeros_like(pairs), where=pairs > 0), triangles, rim]
    out, every = [], np.arange(len(linked))
    for v in nodes:
        top, low = v.argmax(axis=1), v.argmin(axis=1)
        out += [v.mean(axis=1), np.median(v, axis=1), v.min(axis=1), v.max(axis=1), v.std(axis=1, ddof=1), *points[every, top].T, *points[every, low].T]
    # Every edge once: the two ends' degrees less one.
    i, j = np.triu_indices(n, 1)
    edge, less = linked[:, i, j], degree - 1
    ends, count = (less[:, i], less[:, j]), edge.sum(axis=1)
    mean = ((edge * (ends[0] + ends[1])).sum(axis=1) / (2 * count)) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        mixed = ((edge * ends[0] * ends[1]).sum(axis=1) / count - mean) / ((edge * (ends[0] ** 2 + ends[1] ** 2)).sum(axis=1) / (2 * count) - mean)
    return np.column_stack([*out, mixed, triangles.sum(axis=1) / pairs.sum(axis=1), diameter, communities(linked)])


def _shapes(pixels: pd.Series, h: pd.Series, w: pd.Series, r: pd.Series) -> Iterator[tuple[tuple[int, int, int], list[int]]]:
    """(height, width, window) and the rows of the batch with it; rows without an image or a window are left out."""
    groups: dict[tuple[int, int, int], list[int]] = {}
    for k, (p, *shape, window) in enumerate(zip(pixels, h, w, r, strict=True)):
        if p is not None and len(p) and window == window and window is not None:
            groups.setdefault((int(shape[0]), int(shape[1]), 1 if window > 0 else 2), []).append(k)
    yield from groups.items()


def graph_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(adjacency, centroids) of a labelled image, None where there is no triangulation."""
    points = centroids(places)
    if len(points) < 3 or on_a_line(points):
        return None
    linked = np.zeros((len(points), len(points)))
    i, j = triangulate(shaken(points)).T
    linked[i, j] = linked[j, i] = 1
    return linked, points


@F.pandas_udf(ArrayType(DoubleType()))
def _measured(pixels: pd.Series, h: pd.Series, w: pd.Series, r: pd.Series) -> pd.Series:
    out: list[list[float] | None] = [None] * len(pixels)
    for (height, width, window), rows in _shapes(pixels, h, w, r):
        by_size: dict[int, list[tuple]] = {}
        for lo in range(0, len(rows), step := max(1, CELLS // (height * width))):
            some = rows[lo : lo + step]
            images = np.stack([np.asarray(pixels.iloc[k], float) for k in some]).reshape(-1, width, height).transpose(0, 2, 1) >= 0.5
            for k, places in zip(some, label_regions(images, window), strict=True):
                if (found := graph_of(places)) is not None:
                    by_size.setdefault(len(found[1]), []).append((k, *found))
        for n, graphs in by_size.items():
            for lo in range(0, len(graphs), step := max(1, CELLS // (n * n))):
                ks, linked, points = zip(*graphs[lo : lo + step], strict=True)
                for k, values in zip(ks, measures(np.stack(linked), np.stack(points)), strict=True):
                    out[k] = values.tolist()
    return pd.Series(out, dtype=object)


@op("image number", "list<float>", defaults=(1,))
def graph_measures(a, r):
    """All measures of the image's graph, in the order of NAMES."""
    return _measured.asNondeterministic()(a["pixels"], a["h"], a["w"], r.cast("double"))


@op("list<float> int", "float", fallback=0.0, family="image_graph_part")
def graph_measure(measured, k):
    """One of them, by its number from 0; a measure that isn't defined is NaN, and Arrow hands it over as NULL."""
    return F.when(measured.isNotNull(), F.coalesce(F.get(measured, k.cast("int")), F.lit(float("nan"))))


def _register(name: str, k: int) -> None:
    def lower(args):
        # Programs work all measures of an image out once, whichever of them they ask for.
        from ..plans.program import Call, Constant

        given = args if len(args) > 1 else (*args, Constant(1, "int"))
        return Call("graph_measure", (Call("graph_measures", tuple(given[:2]), "list<float>"), Constant(k, "int")), "float")

    @op("image number", "float", name=name, fallback=0.0, defaults=(1,), family="image_graph_part", lower=lower)
    def build(a, r):
        return graph_measure(graph_measures(a, r), F.lit(k))

    told = next(((s, m) for m in NODE_MEASURES for s in STATISTICS if f"{s}{m}" == name), None)
    REGISTRY.ops[name][-1] = replace(REGISTRY.ops[name][-1], doc=f"The {told[0]} of the nodes' {told[1]}." if told else f"The graph's {name}.")


for _k, _name in enumerate(NAMES):
    _register(_name, _k)
