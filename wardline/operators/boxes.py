"""Joins of overlapping boxes by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import boxes_overlap

#: Boxes (columns of a row) in the order in which helpers take them.
_BOX = ("xmin", "xmax", "ymin", "ymax")
#: Doublings of the cell's side up to which large boxes are dealt out in as many copies.
_COPIES = 12


def box_join(a: DataFrame, b: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs of rows whose closed boxes (xmin, xmax, ymin, ymax) overlap.

    Grids whose cells' sides double from ``cell`` on, by default twice the mean extent of the boxes, each a power of two. A box is
    at home in the grid whose cells are no smaller than it, so it covers four cells or so however large it is;
    two boxes meet in the coarser of their grids, by cell. A grid of side 2^l cells is dealt into 2^l parts:
    boxes at home there go to all of them (no more than half of all boxes in sum, as their mean extent tells),
    smaller ones to one by hash. A pair counts in the first cell they share
    only, so no distinct is needed. Columns of both sides; b's box as b_xmin and so on. Rows without a box meet none.
    """
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).cast("double")
    step = F.ceil(F.log2(size)).cast("int")  # null where a box is a point
    # one job a side; a table of boxes has as many different steps as doublings at most
    known = [df.agg(F.avg(size).alias("mean"), F.collect_set(step).alias("steps")).first() for df in (a, b)]
    cell = cell or 2 * max(r.mean or 0.0 for r in known) or 1.0
    least = math.ceil(math.log2(cell))
    home = F.greatest(F.lit(0), F.coalesce(step, F.lit(least)) - least)
    levels = [sorted({0, *(max(0, n - least) for n in r.steps)}) for r in known]
    own = "_" * (1 + max(len(c) for c in (*a.columns, *b.columns)))
    level, part, gx, gy = (f"{own}{n}" for n in ("level", "part", "gx", "gy"))
    flat = not any(levels[0] + levels[1])  # one grid, in one part
    at = [gx, gy] if flat else [level, part, gx, gy]
    side = F.lit(2.0**least) * (F.lit(1.0) if flat else F.pow(F.lit(2.0), F.col(level)))
    parts = F.pow(F.lit(2), F.least(F.col(level), F.lit(_COPIES))).cast("int")

    def dealt(df: DataFrame) -> DataFrame:
        span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)))
        return df.withColumn(gx, span("xmin", "xmax")).withColumn(gy, span("ymin", "ymax"))

    def settled(df: DataFrame) -> DataFrame:
        return dealt(df if flat else df.withColumn(level, home).withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))))

    def visiting(df: DataFrame, grids: list[int], low: Column) -> DataFrame:
        coarser = F.filter(F.array(*[F.lit(n) for n in grids]), lambda n: n >= low)
        return dealt(df if flat else df.withColumn(level, F.explode(coarser)).withColumn(part, F.pmod(F.xxhash64(*_BOX), parts).cast("int")))

    meet = boxes_overlap()
    first = (F.col(gx) == F.floor(F.greatest("xmin", "b_xmin") / side)) & (F.col(gy) == F.floor(F.greatest("ymin", "b_ymin") / side))
    pair = lambda x, y: x.join(y.withColumnsRenamed({c: f"b_{c}" for c in _BOX}), at).where(meet & first).drop(*at)
    out = pair(settled(a), visiting(b, levels[0], home))
    return out.union(pair(visiting(a, levels[1], home + 1), settled(b.where(home > 0)))) if any(levels[1]) else out
