"""Putting geometry, population and votes together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area as ring_area
from ..functions.geometry import bounding_box, point_in_ring, polygon_area, ring_inside
from ..functions.text import contains_any
from ..schema import unused
from ..session import cut
from .spatial import box_join


def drop_water(df: DataFrame, tokens: Sequence[str], key: str = "id") -> DataFrame:
    """Without rows whose key contains a blocked token."""
    return df.where(~F.coalesce(contains_any(F.col(key), tokens), F.lit(False)))


def merge_votes(geometry: DataFrame, votes: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """[J1, J2] Geometry with votes; ``how='left'`` keeps precincts without votes, with 0 of them."""
    out = geometry.join(votes, key, how)
    return out.fillna(0, [c for c in votes.columns if c != key]) if how == "left" else out


def assemble(geometry: DataFrame, population: DataFrame, votes: DataFrame, key: str = "id") -> DataFrame:
    """[J2] Precincts that all three sources know."""
    return geometry.join(population, key).join(votes, key)


def compare_ids(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """[J3] One row: ids in both, only left, only right."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


def sibling_share(df: DataFrame, value: Column, key: str = "id", prefix: str = "") -> DataFrame:
    """[J4, W4] ``share`` of the row's value in its key's ``total``; ``prefix`` goes before both names."""
    total = F.sum(value).over(Window.partitionBy(key))
    return df.withColumns({f"{prefix}total": total, f"{prefix}share": F.try_divide(value, total)})


def apportion(parts: DataFrame, columns: Sequence[str], key: str = "id", whole: bool = False) -> DataFrame:
    """[A9, A10, W3] Values of a key's row dealt to its polygon parts by area (holes taken off).

    Parts of split rows get the id ``<id>_s<part>``. ``whole``: truncate to whole numbers.
    """
    area, own = polygon_area(F.col("hull"), F.col("holes")), unused(parts)
    dealt = sibling_share(parts.withColumn("area", area), F.col("area"), key, own)
    for c in columns:
        v = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) * F.coalesce(F.col(f"{own}share"), F.lit(1.0))
        dealt = dealt.withColumn(c, v.cast("long") if whole else v)
    new = F.when(F.col("n_parts") > 1, F.concat(F.col(key).cast("string"), F.lit("_s"), F.col("part").cast("string"))).otherwise(F.col(key).cast("string"))
    return dealt.withColumn(key, new).drop(f"{own}total", f"{own}share")


def absorb(precincts: DataFrame, columns: Sequence[str], rule: str = "centroid_in_hole", key: str = "id") -> DataFrame:
    """[J5, J6] Precincts within others are absorbed: the container gains their values, they go, holes go.

    ``precincts``: key, hull, holes, cx, cy, bounding box and ``columns``. ``rule``: 'centroid_in_hole' (and
    its box within the hole's), or 'vertices_in_hull'. A container is larger than what it holds, of equal
    rings the smaller key. However deeply precincts nest, the outermost container gets the values.
    """
    a = precincts.select(F.col(key).alias("inner"), F.col("hull").alias("ring"), "cx", "cy", "xmin", "xmax", "ymin", "ymax")
    b = precincts.select(F.col(key).alias("outer"), "hull", "holes", "xmin", "xmax", "ymin", "ymax")
    size, other = ring_area(F.col("hull")), ring_area(F.col("ring"))
    pairs = box_join(a, b).where((size > other) | ((size == other) & (F.col("outer") < F.col("inner"))))
    if rule == "centroid_in_hole":

        def within(hole: Column) -> Column:
            box = bounding_box(hole)
            fits = (F.col("xmin") >= box["xmin"]) & (F.col("xmax") <= box["xmax"]) & (F.col("ymin") >= box["ymin"]) & (F.col("ymax") <= box["ymax"])
            return fits & point_in_ring(F.col("cx"), F.col("cy"), hole)

        held = F.exists(F.coalesce(F.col("holes"), F.array()), within)
    elif rule == "vertices_in_hull":
        held = ring_inside(F.col("ring"), F.col("hull"))
    else:
        raise ValueError(f"unknown rule: {rule}")
    inner = cut(pairs.where(held).groupBy("inner").agg(F.min("outer").alias("outer")), "absorbed")
    while True:  # pointers double: as many turns as the depth has binary digits
        up = inner.select(F.col("inner").alias("outer"), F.col("outer").alias("next"))
        if inner.join(up, "outer", "left_semi").isEmpty():
            break
        inner = cut(inner.join(up, "outer", "left").select("inner", F.coalesce("next", "outer").alias("outer")), "absorbed")
    own = [f"__gain_{i}" for i in range(len(columns))]
    gain = precincts.join(inner, precincts[key] == inner["inner"]).groupBy(F.col("outer").alias("__outer")).agg(*[F.sum(c).alias(g) for c, g in zip(columns, own)])
    kept = precincts.join(inner, precincts[key] == inner["inner"], "left_anti").join(gain, F.col(key) == F.col("__outer"), "left").drop("__outer")
    for c, g in zip(columns, own):
        kept = kept.withColumn(c, F.col(c) + F.coalesce(g, F.lit(0))).drop(g)
    return kept.withColumn("holes", F.filter("holes", lambda _: F.lit(False)))


def fit_to_box(rows: DataFrame, target: DataFrame, ring: str = "hull") -> DataFrame:
    """[M23] Rings moved and stretched so that their common box becomes that of ``target`` (xmin, xmax, ymin, ymax)."""
    lim = lambda df, p: df.agg(F.min("xmin").alias(f"{p}x0"), F.max("xmax").alias(f"{p}x1"), F.min("ymin").alias(f"{p}y0"), F.max("ymax").alias(f"{p}y1"))
    both = lim(rows, "a").join(lim(target, "b"))  # one row each
    sx, sy = F.try_divide(F.expr("bx1 - bx0").cast("double"), F.expr("ax1 - ax0")), F.try_divide(F.expr("by1 - by0").cast("double"), F.expr("ay1 - ay0"))
    both = both.select(sx.alias("sx"), (F.col("bx0") - sx * F.col("ax0")).alias("tx"), sy.alias("sy"), (F.col("by0") - sy * F.col("ay0")).alias("ty"))
    from ..functions.geometry import affine

    out = rows.join(F.broadcast(both))
    return out.withColumn(ring, affine(F.col(ring), F.col("sx"), F.col("tx"), F.col("sy"), F.col("ty"))).drop("sx", "tx", "sy", "ty")
