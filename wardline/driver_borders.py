"""Bindings of borders that do not share vertices, plan measures and contraction in rounds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .driver_queries import _REACH, _nodes, _query, _table, CELL, EDGE, LAND, cell_votes, cells, edges, land
from .functions import geometry as geo
from .operators import graph, shapes, spatial
from .plan_checks import by_parts, compactness, efficiency_gap, open_exchanges
from .plans import contraction, make
from .schema import SCALE
from .session import cut

# ---- tiles: cells merged by twos in even rows and by threes in odd ones, so that borders break at different vertices ----

TILE = "tile AS (SELECT min(id) AS id, gy, gx // (2 + gy % 2) AS blk, (gy // 2 + gx // (2 + gy % 2)) % 3 AS community_id, min(gx) AS x0, max(gx) + 1 AS x1 FROM cell GROUP BY ALL)"
UNIT = "u AS (SELECT c.gx, c.gy, t.id, t.community_id FROM cell c JOIN tile t ON c.gy = t.gy AND c.gx // (2 + c.gy % 2) = t.blk)"
_NEXT = "((a.gy = b.gy AND abs(a.gx - b.gx) = 1) OR (a.gx = b.gx AND abs(a.gy - b.gy) = 1))"


def tiles(spark, d, wide: float = 0.0, decimal: bool = False) -> DataFrame:
    """id, community_id, hull, holes, box: rectangles, ``wide`` cells wider to the right; ``decimal``: tenths of a degree, unscaled."""
    c = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).alias("gx"), F.expr("s_suppkey div 10").alias("gy"))
    block = F.floor(F.col("gx") / (2 + F.col("gy") % 2))
    t = c.groupBy("gy", block.alias("blk")).agg(F.min("id").alias("id"), F.min("gx").alias("x0"), (F.max("gx") + 1 + wide).alias("x1"))
    place = (lambda v: 0.3 + v * 0.1) if decimal else (lambda v: (v * SCALE).cast("long"))
    box = {"xmin": place(F.col("x0")), "xmax": place(F.col("x1")), "ymin": place(F.col("gy")), "ymax": place(F.col("gy") + 1)}
    t = t.select("id", ((F.expr("gy div 2") + F.col("blk")) % 3).alias("community_id"), *[v.alias(k) for k, v in box.items()])
    hull = geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return t.withColumn("hull", hull).withColumn("holes", F.filter(F.array("hull"), lambda _: F.lit(False)))


@_query(f"WITH {CELL}, {TILE}, {UNIT}, e AS (SELECT a.community_id, count(*) AS n FROM u a JOIN u b ON a.community_id = b.community_id AND {_NEXT} GROUP BY 1) SELECT community_id, (4 * count(*) - coalesce(any_value(n), 0)) * {SCALE}::DOUBLE AS length FROM u LEFT JOIN e USING (community_id) GROUP BY 1")
def uneven_outline_length(spark, d):
    return shapes.outline_length(tiles(spark, d))


@_query(f"WITH {CELL}, {TILE}, {UNIT} SELECT community_id, round(count(*) / 100.0::DOUBLE, 3) AS area FROM u GROUP BY 1")
def uneven_dissolved_area(spark, d):
    rings = shapes.dissolve(tiles(spark, d, decimal=True))
    return rings.groupBy("community_id").agg(F.round(F.sum(geo.signed_area(F.col("ring"))), 3).alias("area"))


@_query(f"WITH {CELL}, {TILE}, {UNIT} SELECT DISTINCT a.id AS src, b.id AS dst FROM u a JOIN u b ON {_NEXT} WHERE a.id < b.id")
def uneven_adjacency(spark, d):
    return spatial.rook_adjacency(tiles(spark, d, decimal=True), collinear=True)


@_query(f"WITH {CELL}, {TILE}, {UNIT} SELECT a.id AS a, b.id AS b, bool_or({_NEXT}) AS one FROM u a JOIN u b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 WHERE a.id < b.id GROUP BY ALL")
def uneven_union_test(spark, d):
    t = tiles(spark, d)
    a = t.select(F.col("id").alias("a"), F.col("hull").alias("ring"), "xmin", "xmax", "ymin", "ymax")
    b = t.select(F.col("id").alias("b"), "hull", "xmin", "xmax", "ymin", "ymax")
    return spatial.box_join(a, b).where("a < b").select("a", "b", geo.union_is_one(F.col("ring"), F.col("hull")).alias("one"))


_HALF = "h AS (SELECT DISTINCT community_id, gy, unnest(range(2 * x0, 2 * x1 + 1)) AS hx FROM tile)"


@_query(f"WITH {CELL}, {TILE}, {_HALF}, e AS (SELECT a.community_id, sum(CASE WHEN a.gy = b.gy THEN 1 ELSE 0.5::DOUBLE END) AS n FROM h a JOIN h b ON a.community_id = b.community_id AND ((a.gy = b.gy AND abs(a.hx - b.hx) = 1) OR (a.hx = b.hx AND abs(a.gy - b.gy) = 1)) GROUP BY 1) SELECT community_id, (3 * count(*) - coalesce(any_value(n), 0)) * {SCALE}::DOUBLE AS length, count(*) / 2.0::DOUBLE * {SCALE} * {SCALE} AS area FROM h LEFT JOIN e USING (community_id) GROUP BY 1")
def overlapping_union(spark, d):
    """Tiles that reach half a cell into those to their right: length and area of each community's union."""
    t = tiles(spark, d, wide=0.5)
    rings = shapes.dissolve(t)
    return rings.groupBy("community_id").agg(F.sum(geo.perimeter(F.col("ring"))).alias("length"), F.sum(geo.signed_area(F.col("ring"))).alias("area"))


@_query(f"WITH {CELL}, {TILE} SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM tile a JOIN tile b ON a.id < b.id AND ((a.gy = b.gy AND least(2 * a.x1, 2 * b.x1) + 1 >= greatest(2 * a.x0, 2 * b.x0)) OR (abs(a.gy - b.gy) = 1 AND least(2 * a.x1, 2 * b.x1) + 1 > greatest(2 * a.x0, 2 * b.x0)))")
def overlapping_neighbours(spark, d):
    return spatial.rook_adjacency(tiles(spark, d, wide=0.5), overlapping=True)


_COMB = "comb AS (SELECT n_nationkey AS id, 40 + n_nationkey AS teeth, (n_nationkey % 5) * 2.0::DOUBLE AS x, n_nationkey % 3 / 8.0::DOUBLE AS up FROM nation)"


@_query(f"WITH {CELL}, {_COMB} SELECT c.id, k.id AS comb_id, round(sum(greatest(0, least(gx + 1.0::DOUBLE, x + t.t + 0.5) - greatest(gx::DOUBLE, x + t.t)) * greatest(0, least(gy + 1.0::DOUBLE, up + 9.0) - greatest(gy::DOUBLE, up))) + greatest(0, least(gx + 1.0::DOUBLE, x + teeth) - greatest(gx::DOUBLE, x)) * greatest(0, least(gy + 1.0::DOUBLE, up) - greatest(gy::DOUBLE, up - 1)), 9) AS shared FROM cell c CROSS JOIN comb k, unnest(range(teeth)) t(t) GROUP BY c.id, k.id, gx, gy, x, up, teeth HAVING shared > 0")
def overlay_of_combs(spark, d):
    """Shapes of many edges over one another: combs whose teeth are half as wide as their gaps are apart, over the cells."""
    n = _table(spark, d, "nation")
    x, up, teeth = F.col("n_nationkey") % 5 * 2.0, F.col("n_nationkey") % 3 / 8.0, 40 + F.col("n_nationkey")
    p = lambda a, b: geo.point(a.cast("double"), b.cast("double"))
    tooth = lambda t: F.array(p(x + t + 0.5, up), p(x + t + 0.5, up + 9), p(x + t, up + 9), p(x + t, up))
    teeth_ = F.flatten(F.transform(F.reverse(F.sequence(F.lit(0), teeth - 1)), tooth))
    ring = F.concat(F.array(p(x, up - 1), p(x + teeth, up - 1), p(x + teeth, up)), teeth_)
    combs = n.select(F.col("n_nationkey").alias("comb_id"), ring.alias("hull"))
    combs = geo.with_box(combs.withColumn("holes", F.filter(F.array("hull"), lambda _: F.lit(False))), "hull")
    unit = lambda c: F.col(c) / float(SCALE)
    c = cells(spark, d).select("id", *[unit(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])
    c = c.withColumn("hull", geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))).withColumn("holes", F.filter(F.array("hull"), lambda _: F.lit(False)))
    return spatial.overlay(c, combs, mask_key="comb_id").select("id", "comb_id", F.round("shared", 9).alias("shared"))


@_query(f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, {_REACH} SELECT id, component FROM c")
def components_by_turns(spark, d):
    """Components by turns of large-star and small-star to the end, as for links of any number."""
    return graph.components(land(spark, d), edges(spark, d), few=0)


# ---- plans ---------------------------------------------------------------------------------------------


#: Nodes and communities of each island, none of its exchanges better, and the measure no worse than the start's.
_ENDED = f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, {_REACH} SELECT component AS state, count(*) AS nodes, least(2, count(*))::BIGINT AS communities, 0::BIGINT AS open, true AS no_worse FROM c GROUP BY 1"


def _ended(spark, d, score, measure, maximize):
    nodes, e = _nodes(spark, d)
    votes = cell_votes(spark, d).groupBy(F.col("id").alias("node_id")).pivot("party", ["dem", "rep"]).agg(F.sum("votes")).fillna(0, ["dem", "rep"])
    both = F.array(F.coalesce("dem", F.lit(0)).cast("double"), F.coalesce("rep", F.lit(0)).cast("double"))
    nodes = cut(nodes.join(votes, "node_id", "left").withColumn("votes", both).drop("dem", "rep"), "states")
    start = cut(make.initial_plans(nodes, 2).select("state", "node_id", "community_id"), "start")
    plan = cut(make.refine(nodes.join(start, ["state", "node_id"]), "steepest", measure=measure, maximize=maximize).select("state", "node_id", "community_id"), "plan")
    rows = plan.groupBy("state").agg(F.count_distinct("node_id").alias("nodes"), F.count_distinct("community_id").alias("communities"))
    before = open_exchanges(nodes, e, start, score).select("state", F.col("score").alias("first"))
    out = rows.join(open_exchanges(nodes, e, plan, score), "state").join(before, "state")
    return out.select("state", "nodes", "communities", "open", (F.col("score") >= F.col("first") - 1e-9).alias("no_worse"))


@_query(_ENDED)
def refine_least_compact(spark, d):
    """Steepest ascent on the least compact community of each island's plan."""
    return _ended(spark, d, by_parts(compactness, F.min), "least_compact", True)


@_query(_ENDED)
def refine_efficiency_gap(spark, d):
    """Steepest descent of the efficiency gap of each island's plan."""
    return _ended(spark, d, efficiency_gap, "efficiency_gap", False)


@_query(f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, {_REACH} SELECT component AS state, count(*) AS nodes, least(3, count(*))::BIGINT AS communities, least(3, count(*))::BIGINT AS pieces FROM c GROUP BY 1")
def contraction_in_rounds(spark, d):
    """Every island in three by rounds over tables, none of them gathered."""
    nodes, e = land(spark, d).select("id"), cut(edges(spark, d), "edges")
    states = graph.components(nodes, e).select(F.col("component").alias("state"), F.col("id").alias("node_id"))
    plan = cut(contraction.communities(states, e, 3), "plan").withColumn("own", F.concat_ws(":", "state", "community_id"))
    end = lambda n: plan.select(F.col("node_id").alias(n), F.col("own").alias(f"{n}_own"))
    inner = e.join(end("src"), "src").join(end("dst"), "dst").where("src_own = dst_own").select("src", "dst")
    pieces = graph.components(plan.select(F.col("node_id").alias("id")), inner).withColumnRenamed("id", "node_id")
    return plan.join(pieces, "node_id").groupBy("state").agg(F.count_distinct("node_id").alias("nodes"), F.count_distinct("community_id").alias("communities"), F.count_distinct("component").alias("pieces"))
