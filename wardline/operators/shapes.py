"""Dissolving groups of precincts, and smallest enclosing circles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RING
from .noding import grid_scale, union_border


def outline(precincts: DataFrame, by: str = "community_id") -> DataFrame:
    """[X4, X6, X7, A24] (by, x1, y1, x2, y2): directed border segments of the union of each group's precincts.

    Borders are cut where they meet first, so they need not share vertices; adding or taking away precincts only
    means another assignment. Coordinates are whole numbers of the grid; such in floating point are rounded to multiples of
    2^-18. A group without area has no border; its shapes may overlap. Holes stay out; hulls may run either way.
    """
    scale = grid_scale(precincts.schema["hull"].dataType)
    out = union_border(precincts, by)
    return out if scale == 1 else out.select(by, *[(F.col(c) / scale).alias(c) for c in ("x1", "y1", "x2", "y2")])


def outline_length(precincts: DataFrame, by: str = "community_id") -> DataFrame:
    """Length of each group's border."""
    return outline(precincts, by).groupBy(by).agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))


def stitch(segments_: pd.DataFrame) -> list[np.ndarray]:
    """Directed segments joined into rings; at a vertex with several ways on, the sharpest left turn, so rings that touch stay apart.

    Rings begin at their smallest vertex; vertices are put in order once, whatever the number of rings.
    """
    ways: dict[tuple, list[tuple]] = {}
    for x1, y1, x2, y2 in segments_[["x1", "y1", "x2", "y2"]].itertuples(index=False):
        ways.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for start in sorted(ways):
        while start in ways:
            ring, at, came = [start], start, None
            while True:
                out = ways[at]
                if came is not None and len(out) > 1:
                    back = np.arctan2(came[1] - at[1], came[0] - at[0])
                    out.sort(key=lambda q: (back - np.arctan2(q[1] - at[1], q[0] - at[0])) % (2 * np.pi), reverse=True)
                to = out.pop()
                if not out:
                    del ways[at]
                came, at = at, to
                if at == start or at not in ways:
                    break
                ring.append(at)
            rings.append(np.array(ring, float))
    return rings


def dissolve(precincts: DataFrame, by: str = "community_id") -> DataFrame:
    """[X4, X5] (by, ring, is_hull): each group's border as rings; hulls counter-clockwise, holes clockwise.

    A group's border, not its area, is brought together in one task.
    """
    edges = outline(precincts, by)
    kind = edges.schema[by].dataType.simpleString()

    def rings(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in stitch(pdf):
            x, y = r[:, 0], r[:, 1]
            hull = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) > 0
            rows.append((pdf[by].iloc[0], [{"x": a, "y": b} for a, b in r.tolist()], hull))
        return pd.DataFrame(rows, columns=[by, "ring", "is_hull"])

    return edges.groupBy(by).applyInPandas(rings, f"`{by}` {kind}, ring {RING}, is_hull boolean")


def hull_points(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull: monotone chain."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def smallest_circle(points: np.ndarray, seed: int = 0) -> tuple[float, float, float]:
    """[M20] Centre and radius of the smallest circle about the points: incremental, in random order, shifted to their mean."""
    if len(points) == 0:
        return float("nan"), float("nan"), float("nan")
    origin = points.mean(axis=0)
    p = hull_points(points - origin)
    p = p[np.random.default_rng(seed).permutation(len(p))]

    def two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        return (a + b) / 2, float(np.hypot(*(a - b)) / 2)

    def three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
        u, v = b - a, c - a
        d = 2 * (u[0] * v[1] - u[1] * v[0])
        if d == 0:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda x: x[1])
        uu, vv = u @ u, v @ v
        o = np.array([v[1] * uu - u[1] * vv, u[0] * vv - v[0] * uu]) / d
        return a + o, float(np.hypot(*o))

    def outside(c: np.ndarray, r: float, upto: int) -> int:
        far = np.flatnonzero(np.hypot(*(p[:upto] - c).T) > r * (1 + 1e-12) + 1e-12)
        return int(far[0]) if len(far) else -1

    c, r, i = p[0], 0.0, 0
    for i in range(1, len(p)):
        if np.hypot(*(p[i] - c)) > r * (1 + 1e-12) + 1e-12:
            c, r = p[i], 0.0
            for j in range(i):
                if np.hypot(*(p[j] - c)) > r * (1 + 1e-12) + 1e-12:
                    c, r = two(p[i], p[j])
                    while (k := outside(c, r, j)) >= 0:
                        c2, r2 = three(p[i], p[j], p[k])
                        if r2 <= r:
                            break
                        c, r = c2, r2
    return float(c[0] + origin[0]), float(c[1] + origin[1]), r


def _hulls(by: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, x, y) for k, g in f.groupby(by, sort=False) for x, y in hull_points(g[["x", "y"]].to_numpy(float))]
            yield pd.DataFrame(rows, columns=[by, "x", "y"])

    return run


def enclosing_circles(vertices: DataFrame, by: str = "community_id") -> DataFrame:
    """[M16, M20] (by, x, y, r): smallest circles about each group's vertices (by, x, y).

    Every batch is cut down to its groups' convex hulls before the shuffle: only hull corners decide.
    """
    v = vertices.select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = v.schema[by].dataType.simpleString()
    corners = v.mapInPandas(_hulls(by), f"`{by}` {kind}, x double, y double")

    def circle(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, r = smallest_circle(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "x": [x], "y": [y], "r": [r]})

    return corners.groupBy(by).applyInPandas(circle, f"`{by}` {kind}, x double, y double, r double")


def reock(members: DataFrame, by: str = "community_id") -> DataFrame:
    """[M16, M17] (by, reock): area over that of the smallest circle about all hull vertices.

    ``members``: by, hull, area.
    """
    circles = enclosing_circles(members.select(by, F.explode("hull").alias("p")).select(by, "p.x", "p.y"), by)
    area = members.groupBy(by).agg(F.sum(F.abs("area")).alias("area"))
    return area.join(circles, by).select(by, F.try_divide(F.col("area"), F.pi() * F.col("r") * F.col("r")).alias("reock"))
