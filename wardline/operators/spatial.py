"""Spatial joins: grid keys and equi-joins in place of pair loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_inside, polygon_area, segments
from .boxes import box_join
from .noding import shared_pieces


def edges_both_ways(pairs: DataFrame) -> DataFrame:
    """[G2] (src, dst) in both directions, once each."""
    return pairs.select("src", "dst").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def shared_segments(precincts: DataFrame, key: str = "id", ring: str = "hull") -> DataFrame:
    """(src, dst, n, length), src < dst: segments that two rings have in common, met by their end points."""
    one = precincts.select(F.col(key).alias("id"), F.explode(segments(F.col(ring))).alias("s"))
    low, high = (F.struct(F.col(f"s.x{i}").alias("x"), F.col(f"s.y{i}").alias("y")) for i in (1, 2))
    ends = one.select("id", F.least(low, high).alias("p"), F.greatest(low, high).alias("q"), F.hypot(F.expr("s.x2 - s.x1"), F.expr("s.y2 - s.y1")).alias("l")).distinct()
    two = ends.select(F.col("id").alias("dst"), "p", "q")
    return ends.withColumnRenamed("id", "src").join(two, ["p", "q"]).where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("length"))


def rook_adjacency(precincts: DataFrame, key: str = "id", ring: str = "hull", collinear: bool = False, overlapping: bool = False) -> DataFrame:
    """[J7, J8, F17, F18] (src, dst) with src < dst: precincts that share a line of positive length; points do not count.

    By equal segments, an equi-join. ``collinear``: borders are cut where they meet first, so that lines count which lie along each
    other without equal ends. ``overlapping``: also precincts that overlap, as their union is one shape.
    """
    if collinear or overlapping:
        return shared_pieces(precincts, key, ring, overlapping)
    return shared_segments(precincts, key, ring).select("src", "dst")


#: Vertices to a slab, and numbers that one step may hold.
_SLAB, _BLOCK = 16, 1 << 20


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """Edges from their lower to their upper end, without level ones, by their lower ends: columns x1, y1, x2, y2."""
    parts = [np.hstack((r, np.roll(r, -1, axis=0))) for r in rings]
    e = np.vstack(parts) if parts else np.empty((0, 4))
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    e = e[e[:, 1] < e[:, 3]]
    return e[np.argsort(e[:, 1], kind="stable")]


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of a cross edges of b, in blocks of their pairs."""
    out = []
    step = max(1, _BLOCK // max(1, len(b)))
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    for i in range(0, len(a), step):
        p, q = a[i : i + step, None], b[None]
        d1, d2, w = p[..., 2:] - p[..., :2], q[..., 2:] - q[..., :2], q[..., :2] - p[..., :2]
        det = cross(d1, d2)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(w, d2) / det, cross(w, d1) / det
        hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        k, _ = np.nonzero(hit)
        out.append(a[i + k, 1] + t[hit] * (a[i + k, 3] - a[i + k, 1]))
    return np.concatenate(out) if out else np.empty(0)


def _strips(a: np.ndarray, b: np.ndarray, levels: np.ndarray) -> float:
    """Area that both share between levels, of edges that do not cross between two levels: per strip the length at mid-height."""
    e, own = np.vstack((a, b)), np.arange(len(a) + len(b)) < len(a)
    total, step = 0.0, max(1, _BLOCK // max(1, len(e)))
    with np.errstate(invalid="ignore"):
        for i in range(0, len(levels) - 1, step):
            low, high = levels[i : i + step], levels[i + 1 : i + 1 + step]
            low = low[: len(high)]
            y = ((low + high) / 2)[:, None]
            x = np.where((e[:, 1] <= y) & (e[:, 3] > y), e[:, 0] + (y - e[:, 1]) * ((e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])), np.inf)
            order = np.argsort(x, axis=1, kind="stable")
            x = np.take_along_axis(x, order, 1)
            here = np.isfinite(x)
            first = np.cumsum(own[order] & here, axis=1) % 2 == 1
            second = np.cumsum(~own[order] & here, axis=1) % 2 == 1
            both = (first & second)[:, :-1]
            total += float((np.where(both, x[:, 1:] - x[:, :-1], 0.0).sum(axis=1) * (high - low)).sum())
    return total


def overlap_area(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """[X1] Area that two polygons share; each a list of rings (hull, then holes), of any shape.

    A sweep over slabs of a few vertices each, with lists of the edges that reach into the slab at hand: these
    are cut further where they cross, and between two cuts sides are straight, so the length shared at mid-height times the height is
    exact. Memory is that of the edges.
    """
    edges = [_edges(a), _edges(b)]
    if not len(edges[0]) or not len(edges[1]):
        return 0.0
    low, high = max(e[:, 1].min() for e in edges), min(e[:, 3].max() for e in edges)
    ys = np.concatenate([e[:, [1, 3]].ravel() for e in edges])
    ys = np.unique(np.concatenate((ys[(ys > low) & (ys < high)], (low, high))))
    if low >= high:
        return 0.0
    total, live, at = 0.0, [e[:0] for e in edges], [0, 0]
    for i in range(0, len(ys) - 1, _SLAB):
        slab = ys[i : i + _SLAB + 1]
        for k, e in enumerate(edges):
            to = int(np.searchsorted(e[:, 1], slab[-1], "left"))
            live[k] = np.vstack((live[k][live[k][:, 3] > slab[0]], e[at[k] : to][e[at[k] : to, 3] > slab[0]]))
            at[k] = to
        if len(live[0]) and len(live[1]):
            cuts = _crossed(*live)
            levels = np.unique(np.concatenate((slab, cuts[(cuts > slab[0]) & (cuts < slab[-1])])))
            total += _strips(*live, levels)
    return total


def _points(ring: pa.StructArray) -> np.ndarray:
    return np.column_stack([ring.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")])


def _rings(hull: pa.ListScalar, holes: pa.ListScalar) -> list[np.ndarray]:
    rings = [hull.values, *[h.values for h in (holes.values or [])]]
    return [_points(r) for r in rings if r is not None and len(r)]


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        shape = [batch.column(names.index(c)) for c in ("hull", "holes", "mask_hull", "mask_holes")]
        shared = [overlap_area(_rings(h, x), _rings(m, n)) for h, x, m, n in zip(*shape)]
        rest = [c for c in names if c not in ("hull", "holes", "mask_hull", "mask_holes")]
        yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in rest], pa.array(shared, pa.float64())], [*rest, "shared"])


def box_overlap_area(a: str = "", b: str = "b_") -> Column:
    """Area that two boxes share, in closed form."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "xmax"), c(b, "xmax")) - F.greatest(c(a, "xmin"), c(b, "xmin"))
    h = F.least(c(a, "ymax"), c(b, "ymax")) - F.greatest(c(a, "ymin"), c(b, "ymin"))
    return F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0))


def overlay(precincts: DataFrame, masks: DataFrame, rectangles: bool = False, inside: bool = False, key: str = "id", mask_key: str = "mask_id") -> DataFrame:
    """[J11, J13, X1, X2] (key, mask_key, shared, area, ratio): overlaps of positive area; ratio is the precinct's share in the mask.

    Both sides hold hull, holes and boxes. ``rectangles``: all shapes are their boxes, closed form, no
    Python. ``inside``: only precincts whose box lies strictly within the mask's. The area outside all
    masks is ``area`` less the sum of ``shared``.
    """
    area = (F.col("xmax") - F.col("xmin")).cast("double") * (F.col("ymax") - F.col("ymin")) if rectangles else polygon_area(F.col("hull"), F.col("holes"))
    box = ["xmin", "xmax", "ymin", "ymax"]
    shape = [] if rectangles else ["hull", "holes"]
    a = precincts.select(key, area.alias("area"), *box, *shape)
    b = masks.select(mask_key, *box, *[F.col(c).alias(f"mask_{c}") for c in shape])
    pairs = box_join(a, b)
    if inside:
        pairs = pairs.where(box_inside())
    if rectangles:
        pairs = pairs.withColumn("shared", box_overlap_area())
    else:
        pairs = pairs.drop(*box, *[f"b_{c}" for c in box])
        kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
        pairs = pairs.mapInArrow(_overlaps, f"`{key}` {kinds[key]}, area double, `{mask_key}` {kinds[mask_key]}, shared double")
    return pairs.where("shared > 0").select(key, mask_key, "shared", "area", F.try_divide(F.col("shared"), F.col("area")).alias("ratio"))


def areal_population(overlaps: DataFrame, population: DataFrame, key: str = "id", mask_key: str = "mask_id") -> DataFrame:
    """[J11] (mask_key, pop): populations weighed by overlap share."""
    return overlaps.join(population.select(key, "pop"), key).groupBy(mask_key).agg(F.sum(F.col("pop") * F.col("ratio")).alias("pop"))


def areal_votes(overlaps: DataFrame, votes: DataFrame, key: str = "id", mask_key: str = "mask_id") -> DataFrame:
    """[J12, J13] (mask_key, party, votes): votes weighed by overlap share."""
    return overlaps.join(votes.select(key, "party", "votes"), key).groupBy(mask_key, "party").agg(F.sum(F.col("votes") * F.col("ratio")).alias("votes"))


def best_overlap(populations: DataFrame, by: str = "district_id", choice: str = "community_id") -> DataFrame:
    """[J14] Per ``by`` the ``choice`` with the largest population; ties go to the smaller one."""
    w = Window.partitionBy(by).orderBy(F.desc("pop"), choice)
    own = "_" * (1 + max(len(c) for c in populations.columns))
    return populations.withColumn(own, F.row_number().over(w)).where(F.col(own) == 1).drop(own)
