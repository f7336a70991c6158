"""Contiguity graphs: (src, dst) edges in both directions, and node tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import unused
from ..session import cut
from .spatial import edges_both_ways

#: Links that one task contracts, and pairs of points that one join compares, where no more are left.
FEW, PAIRS = 500_000, 1_000_000
#: Levels of the quadtree, and how many a turn goes down.
_DEPTH, _STEP = 30, 2


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """[G1, G2] With further undirected edges."""
    return edges.union(edges_both_ways(more)).distinct()


def without_nodes(edges: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """[G1, G3, G4, G5] Edges that touch none of the nodes."""
    own = unused(edges)
    g = gone.select(F.col(key).alias(own)).distinct()
    return edges.join(g, F.col("src") == F.col(own), "left_anti").join(g, F.col("dst") == F.col(own), "left_anti")


def induced(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """[J18, J19] Edges with both ends among the nodes."""
    own = unused(edges)
    s = nodes.select(F.col(key).alias(own)).distinct()
    return edges.join(s, F.col("src") == F.col(own), "left_semi").join(s, F.col("dst") == F.col(own), "left_semi")


def light_copy(edges: DataFrame) -> DataFrame:
    """[G11] Edges alone."""
    return edges.select("src", "dst")


def precincts_of(nodes: DataFrame, precincts: DataFrame, key: str = "id") -> DataFrame:
    """[G28] The precincts that a graph's nodes stand for."""
    return nodes.select(key).join(precincts, key)


def contract(edges: DataFrame, a: int, b: int, new: int) -> DataFrame:
    """[G12, X8] Two nodes become one; its neighbours are theirs, without loops or repetitions."""
    one = lambda c: F.when(F.col(c).isin(a, b), F.lit(new)).otherwise(F.col(c)).alias(c)
    return edges.select(one("src"), one("dst")).where("src <> dst").distinct()


def contract_nodes(nodes: DataFrame, a: int, b: int, new: int) -> DataFrame:
    """[G12] (id, attrs): the two nodes' attribute lists are joined, in order of id."""
    rest = nodes.where(~F.col("id").isin(a, b))
    both = nodes.where(F.col("id").isin(a, b)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "attrs"))), lambda x: x.attrs)).alias("attrs"))
    return rest.select("id", "attrs").union(both.select(F.lit(new).cast(nodes.schema["id"].dataType), "attrs"))


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) for every node b of the links: a is the smallest id it reaches, where that is another one."""
    above: dict = {}

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist()):
            a, b = root(above.setdefault(a, a)), root(above.setdefault(b, b))
            above[max(a, b)] = min(a, b)
    ends = [(root(x), x) for x in above]
    yield pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame, key: str = "id", few: int = FEW) -> DataFrame:
    """[G6, G9, G10] (id, component): the smallest id that a node reaches; nodes without edges are their own.

    Turns of large-star and small-star over edges written between turns: few turns, bounded lineage, and a
    node with many neighbours is only ever aggregated, never gathered. Once no more than ``few`` links are
    left, counted where they are written, one task contracts them.
    """
    links = cut(edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "links")
    while links.count() > few:
        # done once nobody has a smaller neighbour and a larger one, or two smaller ones
        ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = cut(both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct(), "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        near = large.join(low, "b")
        small = near.select(F.col("m").alias("a"), F.col("a").alias("b")).union(near.select(F.col("m").alias("a"), "b"))
        links = cut(small.where("a < b").distinct(), "links")
    else:
        links = links.coalesce(1).mapInPandas(_contracted, links.schema)
    named = links.select(F.col("b").alias(key), F.col("a").alias("component"))
    return nodes.select(key).distinct().join(named, key, "left").select(key, F.coalesce("component", key).alias("component"))


def component_count(found: DataFrame) -> DataFrame:
    """[G7, G8] One row: number of components and whether the graph is connected."""
    return found.agg(F.count_distinct("component").alias("components")).withColumn("connected", F.col("components") <= 1)


def exchanges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """[J15] (node_id, community_id, other): nodes with each foreign community they border on, once."""
    a = assignment.select(F.col("node_id").alias("src"), "community_id")
    b = assignment.select(F.col("node_id").alias("dst"), F.col("community_id").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("community_id <> other").select(F.col("src").alias("node_id"), "community_id", "other").distinct()


def giveable(edges: DataFrame, assignment: DataFrame, community: int) -> DataFrame:
    """[J16] (node_id, other): a community's boundary nodes with one foreign community, that of the largest foreign neighbour."""
    a = assignment.where(F.col("community_id") == community).select(F.col("node_id").alias("src"))
    b = assignment.where(F.col("community_id") != community).select(F.col("node_id").alias("dst"), F.col("community_id").alias("other"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("node_id")).agg(F.max_by("other", "dst").alias("other"))


def takeable(edges: DataFrame, assignment: DataFrame, community: int) -> DataFrame:
    """[J17] (node_id, owner): foreign nodes next to a community."""
    a = assignment.where(F.col("community_id") == community).select(F.col("node_id").alias("src"))
    b = assignment.where(F.col("community_id") != community).select(F.col("node_id").alias("dst"), F.col("community_id").alias("owner"))
    return edges.join(a, "src").join(b, "dst").select(F.col("dst").alias("node_id"), "owner").distinct()


def nodes_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """[J20] One row: nodes whose community differs."""
    b = after.select("node_id", F.col("community_id").alias("then"))
    return before.join(b, "node_id").agg(F.count_if(F.expr("community_id <> then")).alias("changed"))


def degrees(edges: DataFrame) -> DataFrame:
    """[O2] (id, degree), by degree."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("degree")).orderBy("degree", "id")


def renumber_by_x(nodes: DataFrame, key: str = "id", x: str = "cx") -> DataFrame:
    """[O1] (key, node_id): 0, 1, ... by centroid x, ties by key.

    Rows are range-partitioned by x; each partition numbers its own and adds what lies before it, so no task
    sorts the whole.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(key, x).repartitionByRange(n, x, key).sortWithinPartitions(x, key)
    rows = cut(rows.withColumn("__p", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("__p").orderBy(x, key)) - 1
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return rows.withColumn("__i", within).join(before, "__p").select(key, (F.col("__i") + F.col("__b")).cast("int").alias("node_id"))


def renumber_edges(edges: DataFrame, numbers: DataFrame, key: str = "id") -> DataFrame:
    """[O1] Edges under the new numbers."""
    a = numbers.select(F.col(key).alias("src"), F.col("node_id").alias("s"))
    b = numbers.select(F.col(key).alias("dst"), F.col("node_id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def closest_pairs(points: DataFrame, key: str = "id", pairs: int = PAIRS) -> DataFrame:
    """[J9, J10, O3, O6] (a, b, d2): the closest two points of different components, smallest ids on ties.

    ``points``: key, component, cx, cy. No row where there are not two components.
    """
    best = nearest_other(points, key, pairs).agg(F.min(F.struct("d2", "a", "b")).alias("r"))
    return best.where("r is not null").select("r.a", "r.b", "r.d2")


def link_islands(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """[J9, J10] Edges with the closest pair of two components added, until the graph is connected.

    Each round labels components and links every component to its nearest other one at once: the pairs that
    adding one at a time would choose, in rounds that at least halve the number of components.
    """
    while True:
        labels = components(nodes, edges, key)
        points = cut(nodes.join(labels, key), "points")
        if component_count(labels).first().connected:
            return edges
        pair = nearest_other(points, key)
        edges = cut(add_edges(edges, pair.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "edges")


def nearest_other(points: DataFrame, key: str = "id", pairs: int = PAIRS) -> DataFrame:
    """(component, a, b, d2): each component's closest pair with another one, by a total order on pairs.

    ``points``: key, component, cx, cy; points without coordinates take no part. A quadtree is walked from its
    root, two levels a turn. A component's cells meet the cells that hold points of others; of such pairs of
    cells those go whose boxes lie further apart than the component's nearest pair can, so that far clusters
    meet by their facing sides only. Points are compared once what is left makes no more than ``pairs`` pairs,
    or eight a point.
    """
    cx, cy = (F.col(c).cast("double") for c in ("cx", "cy"))
    box = points.agg(F.min(cx).alias("x0"), F.max(cx).alias("x1"), F.min(cy).alias("y0"), F.max(cy).alias("y1"), F.count(F.lit(1)).alias("n")).first()
    x0, y0 = box.x0 or 0.0, box.y0 or 0.0
    extent = max((box.x1 or 0.0) - x0, (box.y1 or 0.0) - y0, 1e-9)
    cell = lambda c, low: F.least(F.floor((c - F.lit(low)) / F.lit(extent) * F.lit(float(1 << _DEPTH))), F.lit((1 << _DEPTH) - 1))
    spots = points.groupBy("component", cx.alias("x"), cy.alias("y")).agg(F.min(key).alias("id")).where("x is not null and y is not null")
    spots = cut(spots.withColumn("gx", cell(F.col("x"), x0)).withColumn("gy", cell(F.col("y"), y0)), "spots")
    at = lambda level: [F.shiftright(c, _DEPTH - level).alias(c) for c in ("gx", "gy")]
    spans = [f(c).alias(f"{c}{n}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))] + [F.count(F.lit(1)).alias("n")]
    sided = lambda df, side: df.withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c != "component"})
    where, above = (["a_gx", "a_gy"], ["b_gx", "b_gy"]), (["a_ux", "a_uy"], ["b_ux", "b_uy"])
    up = lambda df, side: df.withColumns({f"{side}_u{c}": F.shiftright(f"{side}_g{c}", _STEP) for c in ("x", "y")})
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"b_{c}min") - F.col(f"a_{c}max"), F.col(f"a_{c}min") - F.col(f"b_{c}max"))
    reach = lambda c: F.greatest(F.col(f"b_{c}max") - F.col(f"a_{c}min"), F.col(f"a_{c}max") - F.col(f"b_{c}min"))
    held, level, cost = spots.select("component", *[F.lit(0).cast("long").alias(c) for c in (*where[0], *where[1])]).distinct(), 0, box.n**2
    while cost > max(pairs, 8 * box.n) and level < _DEPTH:
        level += _STEP
        own = up(sided(spots.groupBy("component", *at(level)).agg(*spans), "a"), "a")
        others = up(sided(spots.groupBy(*at(level)).agg(*spans, F.min("component").alias("low"), F.max("component").alias("high")), "b"), "b")
        held = held.withColumnsRenamed(dict(zip((*where[0], *where[1]), (*above[0], *above[1]))))
        met = held.join(own, ["component", *above[0]]).join(others, above[1]).where("b_low <> component or b_high <> component")
        least, most = (c("x") * c("x") + c("y") * c("y") for c in (apart, reach))
        met = cut(met.select("component", *where[0], *where[1], (F.col("a_n") * F.col("b_n")).alias("cost"), least.alias("least"), most.alias("most")), "cells")
        limit = met.groupBy("component").agg(F.min("most").alias("limit"))
        held = cut(met.join(limit, "component").where("least <= limit").select("component", *where[0], *where[1], "cost"), "cells")
        cost = held.agg(F.sum("cost")).first()[0] or 0
    a = sided(spots.select("component", "id", "x", "y", *at(level)), "a")
    b = sided(spots.select(F.col("component").alias("of"), "id", "x", "y", *at(level)), "b")
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    rank = F.struct((dx * dx + dy * dy).alias("d2"), F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    found = held.join(a, ["component", *where[0]]).join(b, where[1]).where("component <> b_of")
    return found.groupBy("component").agg(F.min(rank).alias("r")).select("component", "r.a", "r.b", "r.d2")
