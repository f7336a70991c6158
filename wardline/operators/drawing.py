"""What maps and graph drawings need, as rows: shapes, spans of pixels, places, colours. [M37, O12, R3, U4, U5, U6]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import lean_colour, svg_path
from ..functions.geometry import segments
from ..schema import unused


def fit_to_canvas(points: DataFrame, width: float, height: float, x: str = "x", y: str = "y") -> DataFrame:
    """[M37] Points moved and scaled, in proportion, to fill a canvas; y runs down, what is left over is shared between both sides."""
    x0, x1, y0, y1 = (f"{unused(points)}{n}" for n in ("x0", "x1", "y0", "y1"))
    low = points.agg(F.min(x).alias(x0), F.max(x).alias(x1), F.min(y).alias(y0), F.max(y).alias(y1))
    dx, dy = (F.col(x1) - F.col(x0)).cast("double"), (F.col(y1) - F.col(y0)).cast("double")
    scale = F.coalesce(F.least(F.try_divide(F.lit(float(width)), dx), F.try_divide(F.lit(float(height)), dy)), F.lit(1.0))
    across = (F.col(x) - F.col(x0)) * scale + (width - dx * scale) / 2
    down = height - ((F.col(y) - F.col(y0)) * scale + (height - dy * scale) / 2)
    return points.join(F.broadcast(low)).withColumns({x: across, y: down}).drop(x0, x1, y0, y1)  # one row


def map_rows(precincts: DataFrame, coords: Column, colour: Column, **extras: Column) -> DataFrame:
    """[U4] (path, colour, extras): one row per shape; ``coords`` is its ring, all are columns over ``precincts``."""
    return precincts.select(svg_path(coords).alias("path"), colour.alias("colour"), *[c.alias(k) for k, c in extras.items()])


def graph_rows(nodes: DataFrame, x: Column, y: Column, colour: Column, size: Column) -> DataFrame:
    """[U5] (x, y, colour, size): one row per node."""
    return nodes.select(x.alias("x"), y.alias("y"), colour.alias("colour"), size.alias("size"))


def coloured_by_lean(precincts: DataFrame, lean: Column) -> DataFrame:
    """[U6] With ``colour`` by any column that gives a lean from -1 to 1."""
    return precincts.withColumn("colour", lean_colour(lean))


def spans(shapes: DataFrame, key: str = "id") -> DataFrame:
    """[O12, R3] (key, row, x0, x1): the pixels of each shape as half-open spans of whole numbers, by scan lines.

    A shape (hull, holes, in pixels) has those pixels whose middle lies within it; a middle on a left or lower border counts,
    on a right or upper one not, so neighbours share no pixel. An edge meets the rows whose middle it passes and
    gives one crossing in each; a row's crossings, in order, begin and end its spans in turn. Rows of one shape are worked on apart.
    """
    rings = F.concat(F.array("hull"), F.coalesce("holes", F.array()))
    edge = shapes.select(key, F.explode(F.flatten(F.transform(rings, segments))).alias("s")).where("s.y1 <> s.y2")
    first = lambda v: F.ceil(v - 0.5)
    low, high = first(F.least("s.y1", "s.y2")), first(F.greatest("s.y1", "s.y2")) - 1
    rows = edge.where(low <= high).select(key, "s", F.explode(F.sequence(low, high)).alias("row"))
    x = F.col("s.x1") + (F.col("row") + 0.5 - F.col("s.y1")) * (F.col("s.x2") - F.col("s.x1")) / (F.col("s.y2") - F.col("s.y1"))
    cuts = rows.select(key, "row", first(x).alias("x")).groupBy(key, "row").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pair = F.transform(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2)), lambda i: F.struct(F.get("x", i).alias("x0"), F.get("x", i + 1).alias("x1")))
    return cuts.select(key, "row", F.explode(pair).alias("p")).select(key, "row", "p.x0", "p.x1").where("x0 < x1")
