"""Geometry as column expressions over rings (arrays of points), without UDFs.

A ring is an array<struct<x, y>>, open or closed. Counter-clockwise rings have positive signed area.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RING_OPEN, SEVERAL_PARTS
from ..schema import SCALE


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def scaled(v: Column) -> Column:
    """Coordinate times 2^18, truncated toward zero."""
    return (v * SCALE).cast("bigint")


def scaled_rounded(v: Column) -> Column:
    """[M28] Coordinate times 2^18, rounded half to even."""
    return F.bround(v * SCALE).cast("bigint")


def closed(ring: Column) -> Column:
    """The ring with its first point at its end."""
    return F.when(F.size(ring) == 0, ring).when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))


def segments(ring: Column) -> Column:
    """[W5, M4] Consecutive vertices with wrap-around, without zero lengths: array<struct<x1, y1, x2, y2>>."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, turned, lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))
    return F.filter(pairs, lambda s: (s.x1 != s.x2) | (s.y1 != s.y2))


def segment_length(s: Column) -> Column:
    """[M1]"""
    return F.hypot(s.x2 - s.x1, s.y2 - s.y1)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """[M2] Euclidean."""
    return F.hypot(bx - ax, by - ay)


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """[M3]"""
    return (bx - ax) * (bx - ax) + (by - ay) * (by - ay)


def line_equation(s: Column) -> Column:
    """[M5] Whole-number slope and intercept; null for vertical segments."""
    dx, dy = (s.x2 - s.x1).cast("bigint"), (s.y2 - s.y1).cast("bigint")
    m = F.try_divide(dy, dx).cast("bigint")
    return F.when(dx != 0, F.struct(m.alias("m"), (s.y1.cast("bigint") - m * s.x1.cast("bigint")).alias("b")))


def signed_area(ring: Column) -> Column:
    """[M6] Shoelace."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s.x1.cast("double") * s.y2 - s.x2.cast("double") * s.y1)) / 2


def area(ring: Column) -> Column:
    """[M9]"""
    return F.abs(signed_area(ring))


def polygon_area(hull: Column, holes: Column) -> Column:
    """[M7] Hull less holes, whatever their orientation."""
    return area(hull) - F.aggregate(F.coalesce(holes, F.array()), F.lit(0.0), lambda t, h: t + area(h))


def multipolygon_area(parts: Column) -> Column:
    """[M8] Sum over parts, array<struct<hull, holes>>."""
    return F.aggregate(parts, F.lit(0.0), lambda t, p: t + polygon_area(p.hull, p.holes))


def perimeter(ring: Column) -> Column:
    """[M10]"""
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + segment_length(s))


def polygon_perimeter(hull: Column, holes: Column) -> Column:
    """[M11] Hull and holes."""
    return perimeter(hull) + F.aggregate(F.coalesce(holes, F.array()), F.lit(0.0), lambda t, h: t + perimeter(h))


def multipolygon_perimeter(parts: Column) -> Column:
    """[M12]"""
    return F.aggregate(parts, F.lit(0.0), lambda t, p: t + polygon_perimeter(p.hull, p.holes))


def centroid(ring: Column) -> Column:
    """[M13, M15] Area-weighted; null for rings without area. Taken about the first vertex for precision."""
    ox, oy = ring[0].x.cast("double"), ring[0].y.cast("double")
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(t: Column, s: Column) -> Column:
        x1, y1, x2, y2 = s.x1 - ox, s.y1 - oy, s.x2 - ox, s.y2 - oy
        c = x1 * y2 - x2 * y1
        return F.struct((t.a + c).alias("a"), (t.x + (x1 + x2) * c).alias("x"), (t.y + (y1 + y2) * c).alias("y"))

    return F.aggregate(segments(ring), zero, add, lambda t: F.struct((ox + F.try_divide(t.x, 3 * t.a)).alias("x"), (oy + F.try_divide(t.y, 3 * t.a)).alias("y")))


def bounding_box(ring: Column) -> dict[str, Column]:
    """[A23] ymax, ymin, xmin, xmax as scalar columns, which filters and joins can push down."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return {"ymax": F.array_max(ys), "ymin": F.array_min(ys), "xmin": F.array_min(xs), "xmax": F.array_max(xs)}


def with_box(df, ring: str = "ring"):
    """The rows with their rings' bounding boxes."""
    return df.withColumns(bounding_box(F.col(ring)))


def boxes_overlap(a: str = "", b: str = "b_") -> Column:
    """Closed boxes in columns of these prefixes; touching counts."""
    c = F.col
    return (c(f"{a}xmin") <= c(f"{b}xmax")) & (c(f"{b}xmin") <= c(f"{a}xmax")) & (c(f"{a}ymin") <= c(f"{b}ymax")) & (c(f"{b}ymin") <= c(f"{a}ymax"))


def box_inside(a: str = "", b: str = "b_") -> Column:
    """Box of a strictly within that of b, in columns of these prefixes."""
    c = F.col
    return (c(f"{a}xmin") > c(f"{b}xmin")) & (c(f"{a}xmax") < c(f"{b}xmax")) & (c(f"{a}ymin") > c(f"{b}ymin")) & (c(f"{a}ymax") < c(f"{b}ymax"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Inside or on the boundary: crossings of a ray to the right, or a segment through the point."""
    x, y = x.cast("double"), y.cast("double")

    def on(s: Column) -> Column:
        cross = (s.x2 - s.x1) * (y - s.y1) - (s.y2 - s.y1) * (x - s.x1)
        return (cross == 0) & x.between(F.least(s.x1, s.x2), F.greatest(s.x1, s.x2)) & y.between(F.least(s.y1, s.y2), F.greatest(s.y1, s.y2))

    def crossed(s: Column) -> Column:
        where = s.x1 + F.try_divide((y - s.y1) * (s.x2 - s.x1), s.y2 - s.y1)
        return ((s.y1 > y) != (s.y2 > y)) & F.coalesce(x < where, F.lit(False))

    all_ = segments(ring)
    return F.exists(all_, on) | (F.size(F.filter(all_, crossed)) % 2 == 1)


def ring_inside(inner: Column, outer: Column) -> Column:
    """All vertices in or on the other ring."""
    return F.forall(inner, lambda p: point_in_ring(p.x, p.y, outer))


def first_inside(inner: Column, outer: Column) -> Column:
    """[F15]"""
    return point_in_ring(inner[0].x, inner[0].y, outer)


def point_in_circle(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """[F16]"""
    return F.hypot(x - cx, y - cy) <= radius


def regular_ring(n: Column, radius: Column, cx: Column | float = 0.0, cy: Column | float = 0.0) -> Column:
    """[M22] Corners of a regular n-gon, open, from angle 0 on."""
    turn = lambda i: i * (2 * F.pi() / n)
    cx, cy = (c if isinstance(c, Column) else F.lit(c) for c in (cx, cy))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(cx + radius * F.cos(turn(i)), cy + radius * F.sin(turn(i))))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """[M24] A box as a counter-clockwise ring of four corners."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax))


def oriented(ring: Column, clockwise: bool = False) -> Column:
    """[M29] The ring turned so that its orientation is the one asked for."""
    wrong = signed_area(ring) > 0 if clockwise else signed_area(ring) < 0
    return F.when(wrong, F.reverse(ring)).otherwise(ring)


def is_hull(ring: Column) -> Column:
    """[X5] Rings of positive signed area are hulls, the others holes."""
    return signed_area(ring) > 0


def affine(ring: Column, ax: Column, bx: Column, ay: Column, by: Column) -> Column:
    """x -> ax x + bx, y -> ay y + by."""
    return F.transform(ring, lambda p: point(ax * p.x + bx, ay * p.y + by))


def repeated_vertices(ring: Column) -> Column:
    """[X9] Vertices that an open ring visits more than once: it touches itself there."""
    return F.array_distinct(F.filter(ring, lambda p: F.size(F.filter(ring, lambda q: q == p)) > 1))


def rook_overlap(a: Column, b: Column, pixel: float = 1 / SCALE) -> Column:
    """Length that two segments share on one line; 0 if they do not lie on one line or share less than a pixel.

    On one line: both ends of the other lie within half a ``pixel`` of it, so that borders in decimals are found whose
    ends lie on the line but for rounding.
    """
    dx, dy = a.x2 - a.x1, a.y2 - a.y1
    near = lambda x, y: 2 * F.abs(dx * (y - a.y1) - dy * (x - a.x1)).cast("double") <= pixel * (F.abs(dx) + F.abs(dy))
    size2 = (dx * dx + dy * dy).cast("double")
    t1 = (dx * (b.x1 - a.x1) + dy * (b.y1 - a.y1)) / size2
    t2 = (dx * (b.x2 - a.x1) + dy * (b.y2 - a.y1)) / size2
    shared = (F.least(F.lit(1.0), F.greatest(t1, t2)) - F.greatest(F.lit(0.0), F.least(t1, t2))) * F.sqrt(size2)
    return F.when(near(b.x1, b.y1) & near(b.x2, b.y2) & (shared > pixel), shared).otherwise(F.lit(0.0))


def equal(a: Column, b: Column) -> Column:
    """Points by coordinates, rings by their vertices in order, polygons by hull and holes; nulls equal each other."""
    return a.eqNullSafe(b)


def equal_by_id(a: Column, b: Column) -> Column:
    """Precincts and nodes are equal by their ids, whatever else they hold."""
    return a["id"].eqNullSafe(b["id"])


def checked_closed(ring: Column) -> Column:
    """[G33] The ring; one whose last vertex is not its first raises."""
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.raise_error(F.lit(RING_OPEN)))


def only_part(parts: Column) -> Column:
    """[G34] A precinct's single part; several raise."""
    return F.when(F.size(parts) == 1, parts[0]).otherwise(F.raise_error(F.lit(SEVERAL_PARTS)))


def crossing(a: Column, b: Column) -> Column:
    """Whether two segments cross within both."""
    side = lambda s, x, y: F.signum((s.x2 - s.x1).cast("double") * (y - s.y1) - (s.y2 - s.y1).cast("double") * (x - s.x1))
    return (side(a, b.x1, b.y1) * side(a, b.x2, b.y2) < 0) & (side(b, a.x1, a.y1) * side(b, a.x2, a.y2) < 0)


def union_is_one(a: Column, b: Column) -> Column:
    """[X3] Whether two rings' union is a single shape: a common line, a crossing, or one within the other. Common points are not enough."""
    meet = F.exists(segments(a), lambda s: F.exists(segments(b), lambda t: (rook_overlap(s, t) > 0) | crossing(s, t)))
    return meet | ring_inside(a, b) | ring_inside(b, a)


def simple_rings(ring: Column) -> Column:
    """[X9] The open ring split at vertices that it visits again: array of rings that touch themselves nowhere.

    Walked once: coming back to a vertex of the way so far cuts off the loop in between. Loops of fewer than
    three vertices hold no area and go.
    """
    none = F.slice(F.array(ring), 1, 0)
    start = F.struct(F.slice(ring, 1, 0).alias("way"), none.alias("found"))

    def step(t: Column, p: Column) -> Column:
        at = F.array_position(t.way, p).cast("int")
        loop = F.slice(t.way, F.greatest(at, F.lit(1)), F.size(t.way))
        found = F.when((at > 0) & (F.size(loop) > 2), F.concat(t.found, F.array(loop))).otherwise(t.found)
        way = F.when(at > 0, F.slice(t.way, 1, at)).otherwise(F.concat(t.way, F.array(p)))
        return F.struct(way.alias("way"), found.alias("found"))

    return F.aggregate(ring, start, step, lambda t: F.when(F.size(t.way) > 2, F.concat(t.found, F.array(t.way))).otherwise(t.found))
