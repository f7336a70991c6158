"""Borders that do not share vertices: noding, unions and adjacency against plain geometry."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.functions import geometry as geo
from wardline.operators import noding, shapes, spatial

SHAPE = "id long, community_id long, hull array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>"
WHOLE = SHAPE.replace("double", "long")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def lengths(df):
    return {r.community_id: r.length for r in shapes.outline_length(df).collect()}


def areas(df):
    rings = shapes.dissolve(df)
    return {r.community_id: r.area for r in rings.groupBy("community_id").agg(F.sum(geo.signed_area(F.col("ring"))).alias("area")).collect()}


def test_a_tall_and_two_small_rectangles(spark):
    rows = [(1, 7, box(0.0, 0.0, 1.0, 2.0), []), (2, 7, box(1.0, 0.0, 2.0, 1.0), []), (3, 7, box(1.0, 1.0, 2.0, 2.0), [])]
    df = spark.createDataFrame(rows, SHAPE)
    assert lengths(df) == {7: 8.0} and areas(df) == {7: 4.0}
    assert {tuple(r) for r in spatial.rook_adjacency(df, collinear=True).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in spatial.rook_adjacency(df).collect()} == {(2, 3)}


def test_borders_along_each_other_in_decimals(spark):
    a = [(0.3, 0.1), (0.9, 0.3), (0.5, 0.9)]
    b = [(0.3, 0.1), (0.6, 0.2), (0.6, -0.4)]
    away = [(0.3, 0.1), (0.2, 0.1), (0.2, 0.2)]  # one point only
    df = spark.createDataFrame([(1, 0, a, []), (2, 0, b, []), (3, 0, away, [])], SHAPE)
    assert [tuple(r) for r in spatial.rook_adjacency(df, collinear=True).collect()] == [(1, 2)]
    side = spark.createDataFrame([(a, b, away)], "a " + "array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>, c array<struct<x: double, y: double>>")
    got = side.select(geo.union_is_one(F.col("a"), F.col("b")), geo.union_is_one(F.col("a"), F.col("c"))).first()
    assert tuple(got) == (True, False)


def guillotine(rng, x0, y0, x1, y1, depth):
    if depth == 0:
        return [(x0, y0, x1, y1)]
    if rng.random() < 0.5:
        x = x0 + (x1 - x0) * rng.uniform(0.3, 0.7)
        return guillotine(rng, x0, y0, x, y1, depth - 1) + guillotine(rng, x, y0, x1, y1, depth - 1)
    y = y0 + (y1 - y0) * rng.uniform(0.3, 0.7)
    return guillotine(rng, x0, y0, x1, y, depth - 1) + guillotine(rng, x0, y, x1, y1, depth - 1)


@pytest.mark.parametrize("turn", [0.0, 0.4])
def test_uneven_partition_of_a_square(spark, turn):
    rng = random.Random(3)
    parts = guillotine(rng, 0.0, 0.0, 10.0, 10.0, 6)
    spin = lambda p: (p[0] * math.cos(turn) - p[1] * math.sin(turn), p[0] * math.sin(turn) + p[1] * math.cos(turn))
    group = [rng.randrange(3) for _ in parts]
    rows = [(i, g, [spin(p) for p in box(*b)][:: rng.choice([1, -1])], []) for i, (g, b) in enumerate(zip(group, parts))]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    assert lengths(df.withColumn("community_id", F.lit(1).cast("long")))[1] == pytest.approx(40, abs=1e-3)
    for g, a in areas(df).items():
        assert a == pytest.approx(sum((b[2] - b[0]) * (b[3] - b[1]) for b, k in zip(parts, group) if k == g), abs=1e-3)
    span = lambda a0, a1, b0, b1: min(a1, b1) - max(a0, b0)
    near = set()
    border = {g: 0.0 for g in range(3)}
    for i, b in enumerate(parts):
        border[group[i]] += 2 * (b[2] - b[0] + b[3] - b[1])
    for i, j in itertools.combinations(range(len(parts)), 2):
        a, b = parts[i], parts[j]
        both = max(span(a[1], a[3], b[1], b[3]) if a[2] == b[0] or b[2] == a[0] else 0, span(a[0], a[2], b[0], b[2]) if a[3] == b[1] or b[3] == a[1] else 0)
        if both > 1e-9:
            near.add((i, j))
            if group[i] == group[j]:
                border[group[i]] -= 2 * both
    assert {tuple(r) for r in spatial.rook_adjacency(df, collinear=True).collect()} == near
    assert lengths(df) == pytest.approx(border, abs=1e-2)


def test_pieces_never_cross_and_stay_near(spark):
    rng = random.Random(4)
    lines = list({(rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 40)) for _ in range(120)})
    lines = [l for l in lines if l[:2] != l[2:]]
    df = spark.createDataFrame([tuple(map(float, l)) for l in lines], "x1 double, y1 double, x2 double, y2 double")
    rows = noding.cut_lines(df).collect()
    pieces = list({(r.ax, r.ay, r.bx, r.by) for r in rows})
    pieces += [(p[2], p[3], p[0], p[1]) for p in pieces]
    e = np.array(pieces, float)
    cross = lambda o, a, b: (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])
    p, q = e[:, None, :2], e[:, None, 2:]
    r, s = e[None, :, :2], e[None, :, 2:]
    d1, d2, d3, d4 = cross(p, q, r), cross(p, q, s), cross(r, s, p), cross(r, s, q)
    assert not ((d1 * d2 < 0) & (d3 * d4 < 0)).any()
    # no end within a piece
    on = (d1 == 0) & (((r - p) * (r - q)).sum(-1) < 0)
    assert not on.any()
    for x in rows:
        d = math.hypot(x.x2 - x.x1, x.y2 - x.y1)
        for px, py in ((x.ax, x.ay), (x.bx, x.by)):
            assert abs((x.x2 - x.x1) * (py - x.y1) - (x.y2 - x.y1) * (px - x.x1)) / d <= 0.7072


def test_overlaps_holes_and_repeats(spark):
    rows = [
        (1, 1, box(0, 0, 40, 40), []), (2, 1, box(20, 20, 60, 60), []),  # overlap
        (3, 2, box(0, 0, 40, 40), []), (4, 2, box(10, 10, 20, 20), []),  # one within the other
        (5, 3, box(0, 0, 40, 40), []), (5, 3, box(0, 0, 40, 40), []), (6, 3, box(40, 0, 80, 40), []),  # repeated
        (7, 4, box(0, 0, 40, 40), [box(10, 10, 20, 20)]),
        (8, 5, box(0, 0, 40, 40), [box(10, 10, 20, 20)]), (9, 5, box(10, 10, 20, 20), []),  # a filled hole
        (10, 6, box(0, 0, 40, 40), None), (11, 7, [(0, 0), (5, 5)], []),
    ]
    df = spark.createDataFrame(rows, WHOLE)
    assert lengths(df) == {1: 240, 2: 160, 3: 240, 4: 200, 5: 160, 6: 160}
    assert areas(df) == {1: 2800, 2: 1600, 3: 3200, 4: 1500, 5: 1600, 6: 1600}
    pairs = spark.createDataFrame([(1, 0, box(0, 0, 40, 40), []), (2, 0, box(20, 20, 60, 60), []), (3, 0, box(60, 60, 70, 70), []), (4, 0, box(45, 45, 50, 50), []), (5, 0, box(0, 40, 40, 50), [])], WHOLE)
    assert {tuple(r) for r in spatial.rook_adjacency(pairs, overlapping=True).collect()} == {(1, 2), (2, 4), (1, 5), (2, 5)}
    assert {tuple(r) for r in spatial.rook_adjacency(pairs, collinear=True).collect()} == {(1, 5)}
    assert shapes.outline(df.limit(0)).count() == 0 and spatial.rook_adjacency(df.limit(0), collinear=True).count() == 0


def test_many_rings_are_put_in_order_once():
    asked = 0

    class Counted(int):
        def __lt__(self, other):
            nonlocal asked
            asked += 1
            return int(self) < int(other)

    n = 400
    # every third square apart, the others in twos that touch at a corner
    rows = [r for i in range(n) for x in [i if i % 3 else i + 5 * n] for r in ((x, i, x + 1, i), (x + 1, i, x + 1, i + 1), (x + 1, i + 1, x, i + 1), (x, i + 1, x, i))]
    rings = shapes.stitch(pd.DataFrame([[Counted(v) for v in r] for r in rows], columns=["x1", "y1", "x2", "y2"], dtype=object))
    assert len(rings) == n and all(len(r) == 4 for r in rings)
    assert asked < 40 * len(rows)
