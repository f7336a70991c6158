"""Borders cut where they meet: snap rounding to a grid, by box joins and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import oriented, segments
from ..schema import SCALE
from ..session import cut
from .boxes import box_join

_LINE = ("x1", "y1", "x2", "y2")
#: Share of a pixel's side that rounding of doubles may move a line.
_SLACK = 1e-9


def grid_scale(ring: T.DataType) -> float:
    """Pixels a unit: coordinates in whole numbers are scaled already, others are scaled by 2^18."""
    return 1.0 if isinstance(ring.elementType["x"].dataType, T.IntegralType) else float(SCALE)


def directed(shapes: DataFrame, keys: list[str], ring: str = "hull", holes: str = "holes") -> DataFrame:
    """(keys, x1, y1, x2, y2): segments in grid units, as doubles; a shape lies to the left of its own."""
    scale = F.lit(grid_scale(shapes.schema[ring].dataType))
    out = shapes.select(*keys, F.explode(segments(oriented(F.col(ring)))).alias("s"))
    if holes in shapes.columns:
        inner = shapes.select(*keys, F.explode(F.coalesce(holes, F.array())).alias("h"))
        out = out.union(inner.select(*keys, F.explode(segments(oriented(F.col("h"), clockwise=True))).alias("s")))
    return out.select(*keys, *[(F.col(f"s.{c}").cast("double") * scale).alias(c) for c in _LINE])


def _pixel(v: Column) -> Column:
    return F.floor(v + 0.5)


def _turned(rows: DataFrame) -> DataFrame:
    """With lines from their smaller end to their larger, and ``forth``: whether they ran so."""
    forth = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    swap = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    return rows.withColumns({**{c: F.when(forth, F.col(c)).otherwise(F.col(o)) for c, o in swap.items()}, "forth": forth})


def _boxed(lines: DataFrame) -> DataFrame:
    """Lines with boxes; a turned line's x1 is its smallest."""
    return lines.withColumns({"xmin": F.col("x1"), "xmax": F.col("x2"), "ymin": F.least("y1", "y2"), "ymax": F.greatest("y1", "y2")})


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _crossings(lines: DataFrame) -> DataFrame:
    """(x1..y2, px, py): lines that cross another within both, and the pixel where they do; one row for each line of a pair."""
    one = _boxed(lines)
    two = one.withColumnsRenamed({c: f"o{c}" for c in _LINE})
    c = F.col
    dx, dy, ox, oy = c("x2") - c("x1"), c("y2") - c("y1"), c("ox2") - c("ox1"), c("oy2") - c("oy1")
    side = lambda x, y: _cross(dx, dy, c(x) - c("x1"), c(y) - c("y1"))
    other = lambda x, y: _cross(ox, oy, c(x) - c("ox1"), c(y) - c("oy1"))
    apart = lambda p, q: ((p > 0) & (q < 0)) | ((p < 0) & (q > 0))
    pairs = box_join(one, two).where(F.struct(*_LINE) < F.struct(*[f"o{n}" for n in _LINE]))
    pairs = pairs.where(apart(side("ox1", "oy1"), side("ox2", "oy2")) & apart(other("x1", "y1"), other("x2", "y2")))
    t = _cross(c("ox1") - c("x1"), c("oy1") - c("y1"), ox, oy) / _cross(dx, dy, ox, oy)
    found = pairs.withColumns({"px": _pixel(c("x1") + t * dx), "py": _pixel(c("y1") + t * dy)})
    return found.select(*_LINE, "px", "py").union(found.select(*[f"o{n}" for n in _LINE], "px", "py"))


def _passes() -> Column:
    """Whether a line runs through the pixel about (px, py), which holds its left and lower sides only.

    The pixel's centre lies in the line's box, so what is left to tell is whether the whole line meets the
    square: its distance is under half the square's extent across it, or it touches the lower left corner.
    """
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    off, reach = 2 * _cross(dx, dy, c("px") - c("x1"), c("py") - c("y1")), F.abs(dx) + F.abs(dy)
    return (F.abs(off) < reach * (1 - _SLACK)) | (F.abs(off - (dx - dy)) <= reach * _SLACK)


def cut_lines(rows: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2, i, ax, ay, bx, by): the pieces of each different line, turned, on the grid, in order.

    Hot pixels are those of all ends and all crossings; a line becomes the way through the centres of the hot
    pixels that it passes. Two pieces then share an end, all of themselves, or nothing, and
    no point has moved by more than a pixel. Lines within one pixel vanish. A line's hot pixels are one array.
    """
    lines = cut(_turned(rows).select(*_LINE).distinct(), "lines")
    crossed = cut(_crossings(lines), "crossings")
    ends = [lines.select(_pixel(F.col(f"x{i}")).alias("px"), _pixel(F.col(f"y{i}")).alias("py")) for i in (1, 2)]
    hot = cut(ends[0].union(ends[1]).union(crossed.select("px", "py")).distinct(), "pixels")
    near = lambda v, by: v + F.lit(by)
    square = hot.withColumns({"xmin": near(F.col("px"), -0.5), "xmax": near(F.col("px"), 0.5), "ymin": near(F.col("py"), -0.5), "ymax": near(F.col("py"), 0.5)})
    met = box_join(_boxed(lines), square).where(_passes()).select(*_LINE, "px", "py")
    stops = met.union(crossed)
    for i in (1, 2):
        stops = stops.union(lines.select(*_LINE, _pixel(F.col(f"x{i}")).alias("px"), _pixel(F.col(f"y{i}")).alias("py")))
    along = (F.col("px") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("py") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    way = stops.groupBy(*_LINE).agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), "px", "py"))).alias("way"))
    step = F.zip_with(F.slice("way", 1, F.size("way") - 1), F.slice("way", 2, F.size("way")), lambda p, q: F.struct(p.px.alias("ax"), p.py.alias("ay"), q.px.alias("bx"), q.py.alias("by")))
    return way.where(F.size("way") > 1).select(*_LINE, F.posexplode(step).alias("i", "s")).select(*_LINE, "i", "s.*")


def noded(shapes: DataFrame, keys: list[str], ring: str = "hull", holes: str = "holes") -> DataFrame:
    """(keys, ax, ay, bx, by, n): the borders of shapes in pieces, each from its smaller end to its larger, on the grid.

    n: how often the shape lies to its left, less how often to its right; pieces that a shape has both ways are
    none of its border. Shapes without area have no border.
    """
    rows = cut(directed(shapes, keys, ring, holes), "border")
    forth = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    own = _turned(rows)
    pieces = own.join(cut_lines(rows), list(_LINE))
    a, b = (F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab")
    a, b = F.when(forth, a).otherwise(b), F.when(forth, b).otherwise(a)
    n = F.when(forth == F.col("forth"), 1).otherwise(-1)
    out = pieces.select(*keys, a.alias("a"), b.alias("b"), n.alias("n")).groupBy(*keys, "a", "b").agg(F.sum("n").cast("int").alias("n"))
    return out.where("n <> 0").select(*keys, "a.x", "a.y", F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "n").toDF(*keys, "ax", "ay", "bx", "by", "n")


def covered(pieces: DataFrame, borders: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """(ax, ay, bx, by, [by], key): pieces that run within a shape, not along its border.

    ``pieces``: ax to by and, with ``by``, that column; ``borders``: as noded() gives them, with ``key`` and ``by``. A piece is
    within a shape if the shape's border winds about its middle; pieces do not cross borders. A shape's border is one array.
    """
    s = F.struct("ax", "ay", "bx", "by", "n")
    group = [key] if by is None else [key, by]
    box = {"xmin": F.min(F.least("ax", "bx")), "xmax": F.max(F.greatest("ax", "bx")), "ymin": F.min(F.least("ay", "by")), "ymax": F.max(F.greatest("ay", "by"))}
    shapes = borders.groupBy(*group).agg(*[v.cast("double").alias(k) for k, v in box.items()], F.collect_list(s).alias("border"))
    if by is not None:
        shapes = shapes.withColumnRenamed(by, "own")
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    spots = pieces.withColumns({"xmin": mx, "xmax": mx, "ymin": my, "ymax": my})
    pairs = box_join(spots, shapes.withColumnRenamed(key, "within"))
    if by is not None:
        pairs = pairs.where(F.col(by).eqNullSafe(F.col("own"))).drop("own")
    x, y = F.col("xmin"), F.col("ymin")

    def turn(e: Column) -> Column:
        # half-open in y: a ray to the right meets the border once at a vertex
        up, down = (e.ay <= y) & (e.by > y), (e.by <= y) & (e.ay > y)
        left = _cross((e.bx - e.ax).cast("double"), (e.by - e.ay).cast("double"), x - e.ax, y - e.ay)
        return F.when(up & (left > 0), e.n).when(down & (left < 0), -e.n).otherwise(0)

    along = F.exists("border", lambda e: (e.ax == F.col("ax")) & (e.ay == F.col("ay")) & (e.bx == F.col("bx")) & (e.by == F.col("by")))
    winding = F.aggregate("border", F.lit(0).cast("long"), lambda t, e: t + turn(e).cast("long"))
    return pairs.where(~along & (winding != 0)).select(*[c for c in pieces.columns], F.col("within").alias(key))


def union_border(shapes: DataFrame, by: str, ring: str = "hull", holes: str = "holes") -> DataFrame:
    """[X4, X6, X7, A24] (by, x1, y1, x2, y2): the directed border of the union of each group's shapes, in grid units.

    Where no two shapes of a group overlap, what is left of a group's pieces is what only one side has; of overlapping shapes the
    pieces within another go too.
    """
    own = "_" * (1 + max(len(c) for c in shapes.columns))
    parts = [c for c in (ring, holes) if c in shapes.columns]
    one = shapes.select(F.col(by), F.md5(F.to_json(F.struct(*parts))).alias(own), *parts)
    borders = cut(noded(one, [by, own], ring, holes), "pieces")
    sides = borders.groupBy(by, "ax", "ay", "bx", "by").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    # the union lies on one side only
    rim = sides.where("most > 0 and least > 0 or most < 0 and least < 0").select(by, "ax", "ay", "bx", "by", (F.col("most") > 0).alias("left"))
    rim = cut(rim, "rim")
    hidden = covered(rim.drop("left"), borders, own, by).select(by, "ax", "ay", "bx", "by").distinct()
    hidden = hidden.withColumnRenamed(by, own)
    at = [rim[c].eqNullSafe(hidden[c]) for c in ("ax", "ay", "bx", "by")]
    rim = rim.join(hidden, [F.col(by).eqNullSafe(F.col(own)), *at], "left_anti")
    pick = lambda p, q: F.when(F.col("left"), F.col(p)).otherwise(F.col(q))
    return rim.select(by, pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"), pick("bx", "ax").alias("x2"), pick("by", "ay").alias("y2"))


def shared_pieces(shapes: DataFrame, key: str = "id", ring: str = "hull", overlapping: bool = False) -> DataFrame:
    """[F17, X3] (src, dst), src < dst: shapes with a piece of border in common; ``overlapping``: also those that run into or lie within each other.

    Points in common are not enough; holes are not looked at.
    """
    borders = cut(noded(shapes.select(key, ring), [key], ring).withColumnRenamed(key, "src"), "pieces")
    at = ["ax", "ay", "bx", "by"]
    two = borders.select(F.col("src").alias("dst"), *at)
    out = borders.select("src", *at).join(two, at).where("src < dst").select("src", "dst")
    if overlapping:
        inner = covered(borders.select("src", *at), borders.withColumnRenamed("src", "dst"), "dst").where("src <> dst")
        out = out.union(inner.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    return out.distinct()
