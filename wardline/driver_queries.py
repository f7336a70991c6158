"""Bindings of the operators to the driver's tables, each with its SQL.

Orders are votes (priority names the party), customers precincts (their nation is the district),
suppliers the cells of a grid ten wide, nations five by five masks over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plan_checks
from .functions import colour, stats, text
from .functions import geometry as geo
from .functions import votes as vt
from .operators import community, drawing, fairness, graph, merge, shapes, spatial
from .plans import make
from .schema import SCALE
from .session import cut, shared_path
from .sources import geojson, tables, writers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- relations -------------------------------------------------------------------------------------

_PARTY_OF = {"1-URGENT": "dem", "2-HIGH": "rep", "3-MEDIUM": "green", "4-NOT SPECIFIED": "lib", "5-LOW": "other"}
_PARTY = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PARTY_OF.items()) + " END"
_ORD = "CASE party WHEN 'other' THEN 0 WHEN 'dem' THEN 1 WHEN 'rep' THEN 2 WHEN 'green' THEN 3 ELSE 4 END"

PV = f"pv AS (SELECT o_custkey AS id, {_PARTY} AS party, count(*) AS votes FROM orders GROUP BY ALL)"
PRE = "pre AS (SELECT c_custkey AS id, c_nationkey AS community_id, coalesce(n, 0)::BIGINT AS pop FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
VOTE = f"vote AS (SELECT c_nationkey AS district, {_PARTY} AS party, count(*) AS votes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
TV = "tv AS (SELECT id, party, votes, community_id, sum(votes) OVER (PARTITION BY id)::BIGINT AS total FROM pv JOIN pre USING (id))"
CELL = f"cell AS (SELECT s_suppkey AS id, s_suppkey % 10 AS gx, s_suppkey // 10 AS gy, s_nationkey AS community_id, s_acctbal AS bal, (s_suppkey % 10) * {SCALE}::BIGINT AS xmin, (s_suppkey // 10) * {SCALE}::BIGINT AS ymin, ((s_suppkey % 10) + 1) * {SCALE}::BIGINT AS xmax, ((s_suppkey // 10) + 1) * {SCALE}::BIGINT AS ymax FROM supplier)"
MASK = "mask AS (SELECT n_nationkey AS mask_id, (n_nationkey % 5) * 655360 + 65536 AS xmin, (n_nationkey // 5) * 655360 + 65536 AS ymin, (n_nationkey % 5 + 1) * 655360 + 65536 AS xmax, (n_nationkey // 5 + 1) * 655360 + 65536 AS ymax FROM nation)"
_SHIFT = f"gx + gx // 4 AS gx, gy + gy // 4 AS gy, xmin + gx // 4 * {SCALE}::BIGINT AS xmin, ymin + gy // 4 * {SCALE}::BIGINT AS ymin, xmax + gx // 4 * {SCALE}::BIGINT AS xmax, ymax + gy // 4 * {SCALE}::BIGINT AS ymax"
#: All cells, with a gap after every fourth column and row: islands of up to sixteen.
LAND = f"land AS (SELECT * REPLACE ({_SHIFT}) FROM cell)"
STRIP = f"land AS (SELECT * REPLACE ({_SHIFT}, gx // 3 AS community_id) FROM cell)"
EDGE = "edge AS (SELECT a.id AS src, b.id AS dst FROM land a JOIN land b ON (a.gy = b.gy AND abs(a.gx - b.gx) = 1) OR (a.gx = b.gx AND abs(a.gy - b.gy) = 1))"
OVER = "ov AS (SELECT id, mask_id, (least(c.xmax, m.xmax) - greatest(c.xmin, m.xmin))::DOUBLE * (least(c.ymax, m.ymax) - greatest(c.ymin, m.ymin)) / (262144.0::DOUBLE * 262144) AS ratio FROM cell c JOIN mask m ON least(c.xmax, m.xmax) > greatest(c.xmin, m.xmin) AND least(c.ymax, m.ymax) > greatest(c.ymin, m.ymin))"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _party() -> Column:
    out = F.lit(None).cast("string")
    for k, v in _PARTY_OF.items():
        out = F.when(F.col("o_orderpriority") == k, v).otherwise(out)
    return out


def precinct_votes(spark: SparkSession, d: str) -> DataFrame:
    """(id, party, votes)"""
    return _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), _party().alias("party")).agg(F.count(F.lit(1)).alias("votes"))


def precincts(spark: SparkSession, d: str) -> DataFrame:
    """(id, community_id, pop)"""
    n = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("pop"))
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community_id"))
    return c.join(n, "id", "left").fillna(0, ["pop"])


def votes(spark: SparkSession, d: str) -> DataFrame:
    """(district, party, votes)"""
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("district"))
    return precinct_votes(spark, d).join(c, "id").groupBy("district", "party").agg(F.sum("votes").alias("votes"))


def _total_votes(spark: SparkSession, d: str) -> DataFrame:
    """(id, party, votes, total, community_id): orders once, totals by window over the rows' own key."""
    v = merge.sibling_share(precinct_votes(spark, d), F.col("votes")).drop("share")
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community_id"))
    return v.join(c, "id")


def cells(spark: SparkSession, d: str, islands: bool = False) -> DataFrame:
    """Unit squares, scaled: id, community_id, bal, hull, holes, box, area, cx, cy, pop; ``islands``: with gaps after every fourth column and row."""
    s = _table(spark, d, "supplier")
    gx, gy = F.col("s_suppkey") % 10, F.expr("s_suppkey div 10")
    if islands:
        gx, gy = gx + F.expr("s_suppkey % 10 div 4"), gy + F.expr("s_suppkey div 10 div 4")
    s = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community_id"), F.col("s_acctbal").alias("bal"), (gx * SCALE).alias("xmin"), (gy * SCALE).alias("ymin"), ((gx + 1) * SCALE).alias("xmax"), ((gy + 1) * SCALE).alias("ymax"))
    ring = geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    s = s.withColumn("hull", ring).withColumn("holes", F.filter(F.array("hull"), lambda _: F.lit(False)))
    return s.withColumns({"area": F.lit(float(SCALE) * SCALE), "cx": F.col("xmin") + SCALE // 2, "cy": F.col("ymin") + SCALE // 2, "pop": (F.col("id") % 7 + 1)})


def masks(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation")
    gx, gy = F.col("n_nationkey") % 5, F.expr("n_nationkey div 5")
    m = n.select(F.col("n_nationkey").alias("mask_id"), (gx * 655360 + 65536).alias("xmin"), (gy * 655360 + 65536).alias("ymin"), ((gx + 1) * 655360 + 65536).alias("xmax"), ((gy + 1) * 655360 + 65536).alias("ymax"))
    m = m.withColumn("hull", geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
    return m.withColumn("holes", F.filter(F.array("hull"), lambda _: F.lit(False)))


def land(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, islands=True)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return spatial.edges_both_ways(spatial.rook_adjacency(land(spark, d)))


def assignment(spark: SparkSession, d: str) -> DataFrame:
    """Vertical strips of three columns as communities."""
    return land(spark, d).select(F.col("id").alias("node_id"), F.expr("id % 10 div 3").alias("community_id"))


# ---- elections and populations ------------------------------------------------------------------------


@_query(f"WITH {VOTE}, w AS (SELECT district, party FROM vote QUALIFY row_number() OVER (PARTITION BY district ORDER BY votes DESC, {_ORD} DESC) = 1), s AS (SELECT party, count(*) AS seats FROM w GROUP BY 1) SELECT party, coalesce(seats, 0) AS seats, round(sum(votes)::DOUBLE / sum(sum(votes)) OVER (), 6) AS share FROM vote LEFT JOIN s USING (party) GROUP BY party, seats")
def mock_election(spark, d):
    return fairness.mock_election(votes(spark, d)).withColumn("share", r6("share"))


@_query(f"WITH {VOTE}, t AS (SELECT *, max(votes) OVER (PARTITION BY district) AS top, list_sort(list(votes) OVER (PARTITION BY district), 'DESC') AS s FROM vote), p AS (SELECT party, sum(CASE WHEN votes = top THEN votes - coalesce(s[2], 0) ELSE votes END) AS w, sum(votes) AS n FROM t GROUP BY 1) SELECT round(abs(2 * max(w) - sum(w))::DOUBLE / sum(n), 6) AS gap FROM p")
def efficiency_gap(spark, d):
    return fairness.efficiency_gap(votes(spark, d)).select(r6("gap").alias("gap"))


_TWO = "s AS (SELECT district, sum(votes) FILTER (WHERE party = 'dem') AS dem, sum(votes) FILTER (WHERE party = 'rep') AS rep, sum(votes) AS n FROM vote GROUP BY 1)"


@_query(f"WITH {VOTE}, {_TWO}, h AS (SELECT coalesce(dem, 0)::DOUBLE / nullif(coalesce(dem, 0) + coalesce(rep, 0), 0) AS s FROM s), a AS (SELECT count(*) FILTER (WHERE s < 0.5) AS n_rep, count(*) FILTER (WHERE s > 0.5) AS n_dem, avg(s) FILTER (WHERE s < 0.5) AS lo, avg(s) FILTER (WHERE s > 0.5) AS hi, CASE WHEN count(*) FILTER (WHERE s = 0.5) > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS tie FROM h) SELECT n_rep, n_dem, round(2 * (atan((0.5 - lo) / (nullif(n_rep, 0) / 2.0::DOUBLE + tie)) - atan((hi - 0.5) / (nullif(n_dem, 0) / 2.0::DOUBLE + tie))) / pi(), 6) AS declination FROM a")
def declination(spark, d):
    return fairness.declination(votes(spark, d)).withColumn("declination", r6("declination"))


_STEP = "p AS (SELECT 1 - coalesce(dem, 0)::DOUBLE / n AS x, row_number() OVER (ORDER BY 1 - coalesce(dem, 0)::DOUBLE / n, district) AS k, count(*) OVER () AS m FROM s)"


@_query(f"WITH {VOTE}, {_TWO}, {_STEP} SELECT 0::DOUBLE AS x, 0::DOUBLE AS y UNION ALL SELECT 1, 1 UNION ALL SELECT round(x, 6), round((k - 1)::DOUBLE / m, 6) FROM p UNION ALL SELECT round(x, 6), round(k::DOUBLE / m, 6) FROM p")
def votes_to_seats_curve(spark, d):
    return fairness.votes_to_seats_curve(votes(spark, d)).select(r6("x").alias("x"), r6("y").alias("y"))


@_query(f"WITH {VOTE}, {_TWO}, {_STEP}, e AS (SELECT x, k::DOUBLE / m AS h, lead(x, 1, 1::DOUBLE) OVER (ORDER BY k) AS z FROM p) SELECT round(sum(CASE WHEN h <= x THEN (z - h) ** 2 / 2 - (x - h) ** 2 / 2 WHEN h >= z THEN (h - x) ** 2 / 2 - (h - z) ** 2 / 2 ELSE (h - x) ** 2 / 2 + (z - h) ** 2 / 2 END) + min(x) ** 2 / 2, 6) AS area FROM e")
def votes_to_seats_area(spark, d):
    return fairness.votes_to_seats_area(votes(spark, d)).select(r6("area").alias("area"))


@_query(f"WITH {VOTE} SELECT district, coalesce(sum(votes) FILTER (WHERE party = 'other'), 0)::BIGINT AS other, coalesce(sum(votes) FILTER (WHERE party = 'dem'), 0)::BIGINT AS dem, coalesce(sum(votes) FILTER (WHERE party = 'rep'), 0)::BIGINT AS rep FROM vote GROUP BY 1")
def district_vote_vector(spark, d):
    return fairness.district_votes(votes(spark, d), ["other", "dem", "rep"])


@_query(f"WITH {PV} SELECT id, party, round(votes::DOUBLE / sum(votes) OVER (PARTITION BY id), 6) AS share FROM pv")
def vote_shares(spark, d):
    v = merge.sibling_share(precinct_votes(spark, d), F.col("votes"))
    return v.select("id", "party", r6(vt.share(F.col("votes"), F.col("total"))).alias("share"))


def _wide(spark, d, parties=("dem", "rep", "green", "lib", "other")):
    return precinct_votes(spark, d).groupBy("id").pivot("party", list(parties)).agg(F.sum("votes")).fillna(0, list(parties))


_WIDE = "w AS (SELECT id, " + ", ".join(f"coalesce(sum(votes) FILTER (WHERE party = '{p}'), 0)::BIGINT AS {p}" for p in _PARTY_OF.values()) + " FROM pv GROUP BY 1)"


@_query(f"WITH {PV}, {_WIDE}, r AS (SELECT id, coalesce(rep::DOUBLE / nullif(rep + dem, 0), 0) AS r FROM w) SELECT id, round(CASE WHEN r < 0.5 THEN r - 1 ELSE r END, 6) AS lean FROM r")
def precinct_lean(spark, d):
    return _wide(spark, d).select("id", r6(vt.lean(F.col("rep"), F.col("dem"))).alias("lean"))


@_query(f"WITH {VOTE}, {_TWO}, r AS (SELECT district, coalesce(coalesce(rep, 0)::DOUBLE / nullif(coalesce(rep, 0) + coalesce(dem, 0), 0), 0) AS r FROM s) SELECT district, round(CASE WHEN r > 0.5 THEN r ELSE -(1 - r) END, 6) AS lean FROM r")
def community_lean(spark, d):
    return community.leans(votes(spark, d), "district").withColumn("lean", r6("lean"))


@_query(f"WITH {PV}, {_WIDE} SELECT id, (dem + rep + green + lib + other - 2 * dem - rep) AS raw, greatest(dem + rep + green + lib + other - 2 * dem - rep, 0) AS clamped FROM w")
def residual_other(spark, d):
    w = _wide(spark, d).withColumn("total", F.expr("dem + rep + green + lib + other"))
    known = (2 * F.col("dem"), F.col("rep"))
    return w.select("id", vt.residual(F.col("total"), *known, clamp=False).alias("raw"), vt.residual(F.col("total"), *known).alias("clamped"))


@_query(f"WITH {PRE} SELECT community_id, sum(pop)::BIGINT AS pop FROM pre GROUP BY 1")
def population_by_district(spark, d):
    return community.population(precincts(spark, d))


@_query(f"WITH {PRE} SELECT sum(pop)::BIGINT AS pop FROM pre")
def total_population(spark, d):
    return community.total_population(precincts(spark, d))


@_query("SELECT c_custkey AS id, (c_nationkey + length(c_mktsegment))::DOUBLE AS pop FROM customer")
def checked_population(spark, d):
    c = _table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), vt.checked_population(F.col("c_nationkey"), F.length("c_mktsegment")).alias("pop"))


_POPS = "p AS (SELECT community_id, sum(pop)::BIGINT AS pop FROM pre GROUP BY 1)"


@_query(f"WITH {PRE}, {_POPS}, i AS (SELECT sum(pop)::BIGINT // count(*) AS ideal FROM p), r AS (SELECT 1 - abs(1 - pop::DOUBLE / ideal) AS r FROM p, i) SELECT round(avg(CASE WHEN r >= 0.99 THEN 1.0::DOUBLE ELSE r END), 6) AS closeness FROM r")
def distance_from_population(spark, d):
    return community.distance_from_population(community.population(precincts(spark, d))).select(r6("closeness").alias("closeness"))


@_query(f"WITH {PRE}, {_POPS}, i AS (SELECT avg(pop) AS ideal FROM p) SELECT bool_and(abs(pop - ideal) / ideal <= 40 / 200.0::DOUBLE) AS complete FROM p, i")
def population_within_tolerance(spark, d):
    return community.within_tolerance(community.population(precincts(spark, d)), 40)


@_query(f"WITH {PRE}, {_POPS}, i AS (SELECT avg(pop) AS ideal FROM p) SELECT community_id, round(abs(pop - ideal), 6) AS off FROM p, i ORDER BY abs(pop - ideal) DESC, community_id LIMIT 1")
def worst_community(spark, d):
    return community.worst(community.population(precincts(spark, d))).withColumn("off", r6("off"))


@_query(f"WITH {PRE} SELECT community_id, round(stddev_pop(pop), 6) AS stdev FROM pre GROUP BY 1")
def population_stdev(spark, d):
    return community.population_deviation(precincts(spark, d)).withColumn("stdev", r6("stdev"))


@_query(f"WITH {PV}, {PRE}, e AS (SELECT community_id, party, stddev_pop(votes) AS d FROM pv JOIN pre USING (id) GROUP BY ALL) SELECT community_id, round(avg(d), 6) AS stdev FROM e GROUP BY 1")
def partisanship_stdev(spark, d):
    v = precinct_votes(spark, d).join(_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community_id")), "id")
    return community.partisanship_deviation(v).withColumn("stdev", r6("stdev"))


@_query(f"WITH {PV}, {PRE}, {TV}, e AS (SELECT community_id, party, stddev_pop(votes::DOUBLE / total) AS d FROM tv GROUP BY ALL) SELECT community_id, round(avg(d), 6) AS stdev FROM e GROUP BY 1")
def partisanship_share_stdev(spark, d):
    return community.share_deviation(_total_votes(spark, d)).withColumn("stdev", r6("stdev"))


@_query(f"WITH {PV}, {PRE}, {TV} SELECT community_id, party, round(avg(votes::DOUBLE / total), 6) AS mean FROM tv GROUP BY ALL")
def party_share_means(spark, d):
    return community.party_means(_total_votes(spark, d)).withColumn("mean", r6("mean"))


@_query(f"SELECT {_PARTY} AS party, count(*) AS votes FROM orders GROUP BY ALL")
def party_totals(spark, d):
    return community.party_totals(precinct_votes(spark, d))


@_query("WITH m AS (SELECT l_returnflag AS flag, sum(l_discount * l_quantity) / sum(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT flag, round(avg(l_discount), 6) AS mean, round(any_value(m), 6) AS weighted, round(stddev_pop(l_discount), 6) AS stdev, round(sqrt(sum(l_quantity * (l_discount - m) ** 2) / sum(l_quantity)), 6) AS weighted_stdev FROM lineitem JOIN m ON flag = l_returnflag GROUP BY 1")
def weighted_mean_stdev(spark, d):
    v, w = F.col("l_discount"), F.col("l_quantity")
    return _table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(r6(stats.mean(v)).alias("mean"), r6(stats.mean(v, w)).alias("weighted"), r6(stats.deviation(v)).alias("stdev"), r6(stats.deviation(v, w)).alias("weighted_stdev"))


# ---- merging ------------------------------------------------------------------------------------------


@_query(f"WITH {PV}, {PRE} SELECT pre.id, community_id, coalesce(votes, 0)::BIGINT AS dem FROM pre LEFT JOIN pv ON pre.id = pv.id AND party = 'dem'")
def left_outer_merge(spark, d):
    dem = precinct_votes(spark, d).where("party = 'dem'").select("id", F.col("votes").alias("dem"))
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community_id"))
    return merge.merge_votes(c, dem, how="left")


@_query(f"WITH {PV}, {PRE} SELECT pre.id, pop, votes AS dem FROM pre JOIN pv ON pre.id = pv.id AND party = 'dem' WHERE pop > 0")
def inner_merge(spark, d):
    v = precinct_votes(spark, d)
    pop = v.groupBy("id").agg(F.sum("votes").alias("pop"))
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return merge.assemble(c, pop, v.where("party = 'dem'").select("id", F.col("votes").alias("dem")))


@_query("WITH a AS (SELECT DISTINCT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS in_both, count(*) FILTER (WHERE b.id IS NULL) AS only_left, count(*) FILTER (WHERE a.id IS NULL) AS only_right FROM a FULL JOIN b ON a.id = b.id")
def id_reconciliation(spark, d):
    return merge.compare_ids(_table(spark, d, "customer").select(F.col("c_custkey").alias("id")), _table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@_query("SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS q, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def sibling_total_share(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"))
    return merge.sibling_share(rows, F.col("q")).select("id", "line", "q", r6("share").alias("share"))


@_query("SELECT p_partkey AS id, p_name FROM part WHERE NOT (contains(p_name, 'ring') OR contains(p_name, 'red'))")
def substring_filter(spark, d):
    rows = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return merge.drop_water(rows, ["ring", "red"], "p_name")


# ---- text and sources ---------------------------------------------------------------------------------


_CELL_TEXT = "(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 1 THEN split_part(o_orderpriority, '-', 1) WHEN o_orderkey % 4 = 2 THEN split_part(o_orderpriority, '-', 1) || '.5x' ELSE '+' || o_custkey || '.25' END)"


@_query(f"WITH t AS (SELECT o_orderkey AS id, {_CELL_TEXT} AS s FROM orders) SELECT id, regexp_full_match(s, '[+-]?[0-9]+(\\.[0-9]*)?') AS number, coalesce(try_cast(s AS DOUBLE), try_cast(split_part(s, '.', 1) AS DOUBLE), 0) AS value FROM t")
def safe_float(spark, d):
    one = F.substring_index("o_orderpriority", "-", 1)
    s = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 4 == 1, one).when(F.col("o_orderkey") % 4 == 2, F.concat(one, F.lit(".5x"))).otherwise(F.concat(F.lit("+"), F.col("o_custkey").cast("string"), F.lit(".25")))
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.is_number(s).alias("number"), text.to_number(s).alias("value"))


@_query("SELECT event_id AS id, (props->>'$.k')::DOUBLE AS k FROM events")
def json_props(spark, d):
    v = F.from_json("props", "map<string, string>")["k"]
    return _table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(~geojson.missing(v), v.try_cast("double")).alias("k"))


@_query("SELECT p_partkey AS id, len(string_split(p_name, ' ')) AS n, array_to_string(string_split(p_name, ' '), '_') AS joined, p_brand || p_size AS key, lpad(p_size::VARCHAR, 3, '0') AS padded FROM part")
def split_join(spark, d):
    s = text.split(F.col("p_name"), " ")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(s).alias("n"), text.join(s, "_").alias("joined"), text.composite_key(F.col("p_brand"), F.col("p_size")).alias("key"), text.zero_padded(F.col("p_size")).alias("padded"))


@_query(f"WITH {PV} SELECT id, party, votes FROM pv")
def votes_from_wide_table(spark, d):
    w = precinct_votes(spark, d).groupBy("id").pivot("party", list(_PARTY_OF.values())).agg(F.sum("votes"))
    w = w.select([F.col(c).cast("string").alias(c) for c in w.columns])
    long = tables.votes_long(w, "id", {p: p for p in _PARTY_OF.values()}, F.lit(0))
    return long.select(F.col("id").cast("long").alias("id"), "party", "votes")


@_query(f"WITH {CELL} SELECT id, community_id FROM cell")
def plan_round_trip(spark, d):
    names = cells(spark, d).select(F.col("community_id").alias("own")).distinct().select("own", F.rank().over(_window("own")).alias("c"))  # a row per community
    a = cells(spark, d).withColumnRenamed("community_id", "own").join(names, "own").select(F.col("id").alias("precinct_id"), F.col("c").alias("community_id"), "own")
    back = tables.plan_assignment(writers.plan_text(a))
    return back.join(names, F.col("community_id") + 1 == F.col("c")).select(F.col("precinct_id").cast("long").alias("id"), F.col("own").alias("community_id"))


def _window(*by):
    from pyspark.sql import Window

    return Window.orderBy(*by)


@_query(f"WITH {CELL} SELECT id, 4 AS n, {SCALE}::DOUBLE * {SCALE} AS area FROM cell")
def geojson_round_trip(spark, d):
    c = cells(spark, d)
    g = c.select("id", F.lit("Polygon").alias("kind"), writers.polygon_coordinates(F.col("hull"), F.col("holes")).alias("coordinates"))
    p = g.select("id", F.explode(geojson.parts(F.col("kind"), F.col("coordinates"))).alias("p"))
    return p.select("id", F.size(geo.segments(F.col("p.hull"))).alias("n"), geo.polygon_area(F.col("p.hull"), F.col("p.holes")).alias("area"))


# ---- geometry -----------------------------------------------------------------------------------------


@_query(f"WITH {CELL} SELECT id, 4 AS n, {SCALE}::DOUBLE * {SCALE} AS area, {SCALE}::DOUBLE * 4 AS perimeter, xmin + {SCALE / 2}::DOUBLE AS cx, ymin + {SCALE / 2}::DOUBLE AS cy, xmin, xmax, ymin, ymax FROM cell")
def ring_measures(spark, d):
    h = F.col("hull")
    c = cells(spark, d).select("id", "hull")
    return c.select("id", F.size(geo.segments(h)).alias("n"), geo.signed_area(h).alias("area"), geo.perimeter(h).alias("perimeter"), geo.centroid(h).x.alias("cx"), geo.centroid(h).y.alias("cy"), *[v.alias(k) for k, v in geo.bounding_box(h).items()])


_TRI = "[(0, 0), (3 + vec_id % 5, 0), (1, 2 + vec_id % 3)]"


@_query("SELECT vec_id AS id, (3 + vec_id % 5) * (2 + vec_id % 3) / 2.0::DOUBLE AS area, round((4 + vec_id % 5)::DOUBLE / 3, 6) AS cx, round((2 + vec_id % 3)::DOUBLE / 3, 6) AS cy, round((3 + vec_id % 5) + sqrt((2 + vec_id % 5) ** 2 + (2 + vec_id % 3) ** 2) + sqrt(1 + (2 + vec_id % 3) ** 2), 6) AS perimeter FROM embeddings")
def triangle_measures(spark, d):
    p = lambda x, y: geo.point(x.cast("double"), y.cast("double"))
    t = F.array(p(F.lit(0), F.lit(0)), p(3 + F.col("vec_id") % 5, F.lit(0)), p(F.lit(1), 2 + F.col("vec_id") % 3))
    c = geo.centroid(F.reverse(t))
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), geo.area(F.reverse(t)).alias("area"), r6(c.x).alias("cx"), r6(c.y).alias("cy"), r6(geo.perimeter(t)).alias("perimeter"))


_PT = f"pt AS (SELECT vec_id, trunc((embedding[1]::DOUBLE + 1) * 5 * {SCALE})::BIGINT AS x, trunc((embedding[2]::DOUBLE + 1) * 5 * {SCALE})::BIGINT AS y FROM embeddings)"


def points(spark, d):
    e = F.col("embedding")
    one = lambda i: ((e[i].cast("double") + 1) * 5 * SCALE).cast("bigint")
    return _table(spark, d, "embeddings").select("vec_id", one(0).alias("x"), one(1).alias("y"), "label")


@_query(f"WITH {CELL}, {_PT} SELECT vec_id, id FROM pt JOIN cell ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")
def point_in_ring(spark, d):
    p = points(spark, d).select("vec_id", F.col("x").alias("xmin"), F.col("x").alias("xmax"), F.col("y").alias("ymin"), F.col("y").alias("ymax"))
    pairs = spatial.box_join(p, cells(spark, d).select("id", "hull", "xmin", "xmax", "ymin", "ymax"))
    return pairs.where(geo.point_in_ring(F.col("xmin"), F.col("ymin"), F.col("hull"))).select("vec_id", "id")


@_query(f"WITH {_PT} SELECT vec_id, round(sqrt((x - {5 * SCALE})::DOUBLE ** 2 + (y - {5 * SCALE})::DOUBLE ** 2), 3) AS distance, ((x - {5 * SCALE})::DOUBLE ** 2 + (y - {5 * SCALE})::DOUBLE ** 2) AS squared, sqrt((x - {5 * SCALE})::DOUBLE ** 2 + (y - {5 * SCALE})::DOUBLE ** 2) <= {SCALE} AS inside FROM pt")
def point_in_circle(spark, d):
    x, y, c = F.col("x").cast("double"), F.col("y").cast("double"), F.lit(float(5 * SCALE))
    return points(spark, d).select("vec_id", F.round(geo.distance(x, y, c, c), 3).alias("distance"), geo.squared_distance(x, y, c, c).alias("squared"), geo.point_in_circle(x, y, c, c, F.lit(SCALE)).alias("inside"))


@_query(f"WITH {CELL}, {MASK} SELECT id, mask_id, c.xmin > m.xmin AND c.xmax < m.xmax AND c.ymin > m.ymin AND c.ymax < m.ymax AS inside FROM cell c JOIN mask m ON c.xmin <= m.xmax AND m.xmin <= c.xmax AND c.ymin <= m.ymax AND m.ymin <= c.ymax")
def box_overlap_join(spark, d):
    pairs = spatial.box_join(cells(spark, d).select("id", "xmin", "xmax", "ymin", "ymax"), masks(spark, d).select("mask_id", "xmin", "xmax", "ymin", "ymax"))
    return pairs.select("id", "mask_id", geo.box_inside().alias("inside"))


@_query(f"WITH {CELL}, {LAND}, {EDGE} SELECT src, dst FROM edge WHERE src < dst")
def rook_adjacency(spark, d):
    return spatial.rook_adjacency(land(spark, d))


@_query(f"WITH {CELL}, {LAND}, {EDGE} SELECT src, dst FROM edge WHERE src < dst")
def rook_adjacency_collinear(spark, d):
    return spatial.rook_adjacency(land(spark, d), collinear=True)


@_query(f"WITH {CELL}, {MASK}, {OVER} SELECT mask_id, round(sum((id % 7 + 1) * ratio), 6) AS pop FROM ov GROUP BY 1")
def areal_population(spark, d):
    c = cells(spark, d)
    return spatial.areal_population(spatial.overlay(c, masks(spark, d), rectangles=True), c).withColumn("pop", r6("pop"))


@_query(f"WITH {CELL}, {MASK}, {OVER} SELECT mask_id, round(sum((id % 7 + 1) * ratio), 6) AS pop FROM ov GROUP BY 1")
def areal_population_general(spark, d):
    c = cells(spark, d)
    return spatial.areal_population(spatial.overlay(c, masks(spark, d)), c).withColumn("pop", r6("pop"))


_CV = f"cv AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS id, {_PARTY} AS party, count(*) AS votes FROM orders GROUP BY ALL)"


def cell_votes(spark, d):
    n = _table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    v = precinct_votes(spark, d).join(F.broadcast(n)).withColumn("id", F.col("id") % F.col("n"))
    return v.groupBy("id", "party").agg(F.sum("votes").alias("votes"))


@_query(f"WITH {CELL}, {MASK}, {OVER}, {_CV} SELECT mask_id, party, round(sum(votes * ratio), 6) AS votes FROM ov JOIN cv USING (id) GROUP BY ALL")
def areal_partisanship(spark, d):
    o = spatial.overlay(cells(spark, d), masks(spark, d), rectangles=True)
    return spatial.areal_votes(o, cell_votes(spark, d)).withColumn("votes", r6("votes"))


@_query(f"WITH {CELL}, {MASK}, {OVER}, {_CV} SELECT mask_id, party, round(sum(votes * ratio), 6) AS votes FROM ov JOIN cv USING (id) JOIN cell c USING (id) JOIN mask m USING (mask_id) WHERE c.xmin > m.xmin AND c.xmax < m.xmax AND c.ymin > m.ymin AND c.ymax < m.ymax GROUP BY ALL")
def areal_partisanship_inside(spark, d):
    o = spatial.overlay(cells(spark, d), masks(spark, d), rectangles=True, inside=True)
    return spatial.areal_votes(o, cell_votes(spark, d)).withColumn("votes", r6("votes"))


_IN = "inn AS (SELECT mask_id AS district_id, community_id, sum((id % 7 + 1) * ratio) AS pop FROM ov JOIN cell USING (id) GROUP BY ALL), best AS (SELECT * FROM inn QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY round(pop, 9) DESC, community_id) = 1)"


@_query(f"WITH {CELL}, {MASK}, {OVER}, {_IN} SELECT district_id, community_id, round(pop, 6) AS pop FROM best")
def best_overlap(spark, d):
    c = cells(spark, d)
    o = spatial.overlay(c, masks(spark, d), rectangles=True).join(c.select("id", "community_id", "pop"), "id")
    pops = o.groupBy(F.col("mask_id").alias("district_id"), "community_id").agg(F.round(F.sum(F.col("pop") * F.col("ratio")), 9).alias("pop"))
    return spatial.best_overlap(pops).withColumn("pop", r6("pop"))


@_query(f"""WITH {CELL}, {MASK}, {OVER}, {_CV}, {_IN},
people AS (SELECT community_id, sum(id % 7 + 1) AS n FROM cell GROUP BY 1),
tot AS (SELECT community_id, party, sum(votes) AS v FROM cv JOIN cell USING (id) WHERE party IN ('dem', 'rep') GROUP BY ALL),
held AS (SELECT mask_id AS district_id, community_id, party, sum(votes * ratio) AS h FROM ov JOIN cell USING (id) JOIN cv USING (id) WHERE party IN ('dem', 'rep') GROUP BY ALL),
rest AS (SELECT b.district_id, sum(CASE WHEN t.party = 'rep' THEN v - coalesce(h, 0) ELSE 0 END) AS rep, sum(v - coalesce(h, 0)) AS two FROM best b JOIN tot t USING (community_id) LEFT JOIN held x ON x.district_id = b.district_id AND x.community_id = b.community_id AND x.party = t.party GROUP BY 1)
SELECT b.district_id, b.community_id, round(coalesce((n - pop) / n, 0), 6) AS absolute, round(coalesce(rep / nullif(two, 0), 0.5), 6) AS rep_share FROM best b JOIN people USING (community_id) LEFT JOIN rest USING (district_id)""")
def quantification(spark, d):
    c = cells(spark, d)
    o = spatial.overlay(c, masks(spark, d), rectangles=True)
    q = fairness.quantification(o, c.select("id", "community_id", "pop"), cell_votes(spark, d))
    return q.withColumns({"absolute": r6("absolute"), "rep_share": r6("rep_share")})


@_query("SELECT l_orderkey AS id, l_linenumber AS line, round(l_discount * 2 * (0.5 - l_tax), 6) AS collapsed FROM lineitem")
def collapse_values(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), r6(vt.collapse(F.col("l_discount"), F.col("l_tax"))).alias("collapsed"))


@_query("SELECT round(avg(l_discount), 6) AS g, round(2 * (0.5 - avg(l_tax)) * avg(l_discount), 6) AS s FROM lineitem")
def two_number_score(spark, d):
    g, s = vt.two_number_score(F.col("l_discount"), F.col("l_tax"))
    return _table(spark, d, "lineitem").agg(r6(g).alias("g"), r6(s).alias("s"))


# ---- graphs -------------------------------------------------------------------------------------------


@_query(f"WITH {CELL}, {STRIP}, {EDGE} SELECT DISTINCT src AS node_id, a.community_id, b.community_id AS other FROM edge JOIN land a ON a.id = src JOIN land b ON b.id = dst WHERE a.community_id <> b.community_id")
def exchanges(spark, d):
    return graph.exchanges(edges(spark, d), assignment(spark, d))


@_query(f"WITH {CELL}, {STRIP}, {EDGE} SELECT src AS node_id, arg_max(b.community_id, dst) AS other FROM edge JOIN land a ON a.id = src JOIN land b ON b.id = dst WHERE a.community_id = 1 AND b.community_id <> 1 GROUP BY 1")
def giveable(spark, d):
    return graph.giveable(edges(spark, d), assignment(spark, d), 1)


@_query(f"WITH {CELL}, {STRIP}, {EDGE} SELECT DISTINCT dst AS node_id, b.community_id AS owner FROM edge JOIN land a ON a.id = src JOIN land b ON b.id = dst WHERE a.community_id = 1 AND b.community_id <> 1")
def takeable(spark, d):
    return graph.takeable(edges(spark, d), assignment(spark, d), 1)


@_query(f"WITH {CELL}, {LAND}, {EDGE} SELECT src, dst FROM edge WHERE src % 3 <> 0 AND dst % 3 <> 0")
def induced_subgraph(spark, d):
    return graph.induced(edges(spark, d), land(spark, d).where("id % 3 <> 0"))


@_query(f"WITH {CELL}, {LAND}, {EDGE} SELECT src, dst FROM edge WHERE src % 5 <> 0 AND dst % 5 <> 0")
def edges_without_nodes(spark, d):
    return graph.without_nodes(edges(spark, d), land(spark, d).where("id % 5 = 0"))


@_query(f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, reach AS (SELECT id, id AS component FROM land UNION SELECT dst, component FROM reach JOIN edge ON src = reach.id) SELECT id, min(component) AS component FROM reach GROUP BY 1")
def components(spark, d):
    return graph.components(land(spark, d), edges(spark, d))


@_query(f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, reach AS (SELECT id, id AS component FROM land UNION SELECT dst, component FROM reach JOIN edge ON src = reach.id), c AS (SELECT id, min(component) AS component FROM reach GROUP BY 1) SELECT count(DISTINCT component) AS components, count(DISTINCT component) <= 1 AS connected FROM c")
def component_count(spark, d):
    return graph.component_count(graph.components(land(spark, d), edges(spark, d)))


@_query(f"WITH {CELL}, {LAND}, {EDGE}, k AS (SELECT CASE WHEN src IN (1, 2) THEN 1000000 ELSE src END AS src, CASE WHEN dst IN (1, 2) THEN 1000000 ELSE dst END AS dst FROM edge) SELECT DISTINCT src, dst FROM k WHERE src <> dst")
def contract_edge(spark, d):
    return graph.contract(edges(spark, d), 1, 2, 1_000_000)


@_query(f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, reach AS (SELECT id, id AS component FROM land UNION SELECT dst, component FROM reach JOIN edge ON src = reach.id), c AS (SELECT id, min(component) AS component FROM reach GROUP BY 1), p AS (SELECT * FROM c JOIN land USING (id)) SELECT a.id AS a, b.id AS b, ((a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2) * {SCALE}::DOUBLE * {SCALE} AS d2 FROM p a JOIN p b ON a.id < b.id AND a.component <> b.component ORDER BY d2, a, b LIMIT 1")
def closest_island_pair(spark, d):
    nodes = land(spark, d)
    return graph.closest_pairs(graph.components(nodes, edges(spark, d)).join(nodes.select("id", "cx", "cy"), "id"))


_REACH = "reach AS (SELECT id, id AS component FROM land UNION SELECT dst, component FROM reach JOIN edge ON src = reach.id), c AS (SELECT id, min(component) AS component FROM reach GROUP BY 1)"


# neighbouring islands are two cells apart, so a shortest tree between k of them has k - 1 links of that length
@_query(f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, {_REACH} SELECT 1 AS components, true AS connected, count(DISTINCT component) - 1 AS added, coalesce((count(DISTINCT component) - 1) * 4::DOUBLE * {SCALE} * {SCALE}, 0) AS total FROM c")
def linked_islands(spark, d):
    nodes = land(spark, d).select("id", "cx", "cy")
    linked = graph.link_islands(nodes, edges(spark, d))
    place = lambda e: nodes.select(F.col("id").alias(e), F.col("cx").alias(f"{e}x"), F.col("cy").alias(f"{e}y"))
    d2 = F.pow(F.expr("srcx - dstx"), 2) + F.pow(F.expr("srcy - dsty"), 2)
    new = linked.where("src < dst").join(place("src"), "src").join(place("dst"), "dst").select(d2.alias("d2")).where(F.col("d2") > float(SCALE) * SCALE)
    added = new.agg(F.count(F.lit(1)).alias("added"), F.coalesce(F.sum("d2"), F.lit(0.0)).alias("total"))
    return graph.component_count(graph.components(nodes, linked)).join(F.broadcast(added))  # one row each


@_query(f"WITH {CELL}, {LAND}, {EDGE} SELECT src AS id, count(*) AS degree FROM edge GROUP BY 1")
def degrees(spark, d):
    return graph.degrees(edges(spark, d))


@_query(f"WITH {CELL} SELECT id, row_number() OVER (ORDER BY xmin, id) - 1 AS node_id FROM cell")
def renumber_by_x(spark, d):
    return graph.renumber_by_x(cells(spark, d))


@_query(f"WITH {CELL} SELECT count(*) FILTER (WHERE community_id <> (community_id + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END)) AS changed FROM cell")
def precincts_changed(spark, d):
    a = cells(spark, d).select(F.col("id").alias("node_id"), "community_id")
    return graph.nodes_changed(a, a.withColumn("community_id", F.col("community_id") + F.when(F.col("node_id") % 4 == 0, 1).otherwise(0)))


# ---- shapes of groups ---------------------------------------------------------------------------------


@_query(f"WITH {CELL}, m AS (SELECT community_id, avg(xmin + {SCALE // 2}) AS mx, avg(ymin + {SCALE // 2}) AS my, count(*) * {SCALE}::DOUBLE * {SCALE} AS area FROM cell GROUP BY 1) SELECT community_id, round(any_value(area) / nullif(pi() * max((xmin + {SCALE // 2} - mx) ** 2 + (ymin + {SCALE // 2} - my) ** 2), 0), 6) AS compactness FROM cell JOIN m USING (community_id) GROUP BY 1")
def approx_compactness(spark, d):
    return community.quick_compactness(cells(spark, d)).withColumn("compactness", r6("compactness"))


@_query(f"WITH {CELL} SELECT community_id, sum(xmin + {SCALE // 2})::BIGINT // count(*) AS cx, sum(ymin + {SCALE // 2})::BIGINT // count(*) AS cy FROM cell GROUP BY 1")
def community_centroids(spark, d):
    return community.centroids(cells(spark, d), whole=True)


@_query(f"WITH {CELL} SELECT community_id, max(ymax) AS ymax, min(ymin) AS ymin, min(xmin) AS xmin, max(xmax) AS xmax FROM cell GROUP BY 1")
def community_boxes(spark, d):
    return community.boxes(cells(spark, d))


@_query(f"WITH {CELL}, {LAND}, g AS (SELECT * EXCLUDE (community_id), id % 3 AS community_id FROM land), e AS (SELECT a.community_id, count(*) AS n FROM g a JOIN g b ON a.community_id = b.community_id AND ((a.gy = b.gy AND abs(a.gx - b.gx) = 1) OR (a.gx = b.gx AND abs(a.gy - b.gy) = 1)) GROUP BY 1) SELECT community_id, (4 * count(*) - coalesce(any_value(n), 0)) * {SCALE}::DOUBLE AS length FROM g LEFT JOIN e USING (community_id) GROUP BY 1")
def dissolve_outline_length(spark, d):
    return shapes.outline_length(land(spark, d).withColumn("community_id", F.col("id") % 3))


@_query(f"WITH {CELL}, {LAND} SELECT id % 3 AS community_id, count(*) * {SCALE}::DOUBLE * {SCALE} AS area FROM land GROUP BY 1")
def dissolved_area(spark, d):
    rings = shapes.dissolve(land(spark, d).withColumn("community_id", F.col("id") % 3))
    return rings.groupBy("community_id").agg(F.sum(geo.signed_area(F.col("ring"))).alias("area"))


@_query(f"WITH {CELL} SELECT gy AS community_id, round(count(*) / (pi() * ((max(gx) - min(gx) + 1) ** 2 + 1) / 4.0::DOUBLE), 6) AS reock FROM cell GROUP BY gy")
def reock_of_rows(spark, d):
    c = cells(spark, d).withColumn("community_id", F.expr("id div 10"))
    return shapes.reock(c).withColumn("reock", r6("reock"))


@_query(f"""WITH {CELL}, corner AS (SELECT DISTINCT community_id AS k, gx + i AS x, gy + j AS y FROM cell, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j)),
pt AS (SELECT k, min(x)::DOUBLE AS x, y::DOUBLE AS y FROM corner GROUP BY k, y UNION SELECT k, max(x), y FROM corner GROUP BY k, y),
two AS (SELECT a.k, (a.x + b.x) / 2 AS u, (a.y + b.y) / 2 AS v, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4 AS r2 FROM pt a JOIN pt b ON a.k = b.k AND (a.x, a.y) < (b.x, b.y)),
tri AS (SELECT a.k, a.x, a.y, a.x ** 2 + a.y ** 2 AS a2, b.x ** 2 + b.y ** 2 AS b2, c.x ** 2 + c.y ** 2 AS c2, b.x AS bx, b.y AS b_y, c.x AS cx, c.y AS cy, 2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d FROM pt a JOIN pt b ON a.k = b.k AND (a.x, a.y) < (b.x, b.y) JOIN pt c ON b.k = c.k AND (b.x, b.y) < (c.x, c.y)),
mid AS (SELECT k, x, y, (a2 * (b_y - cy) + b2 * (cy - y) + c2 * (y - b_y)) / d AS u, (a2 * (cx - bx) + b2 * (x - cx) + c2 * (bx - x)) / d AS v FROM tri WHERE d <> 0),
circle AS (SELECT DISTINCT * FROM two UNION SELECT k, u, v, (x - u) ** 2 + (y - v) ** 2 FROM mid),
fits AS (SELECT c.k, c.r2 FROM circle c JOIN pt USING (k) GROUP BY c.k, u, v, r2 HAVING max((x - u) ** 2 + (y - v) ** 2) <= r2 * (1 + 1e-9)),
n AS (SELECT community_id AS k, count(*) AS n FROM cell GROUP BY 1)
SELECT k AS community_id, round(any_value(n) / (pi() * min(r2)), 6) AS reock FROM fits JOIN n USING (k) GROUP BY k""")
def reock(spark, d):
    return shapes.reock(cells(spark, d)).withColumn("reock", r6("reock"))


@_query(f"WITH {CELL} SELECT count(*) AS precincts, sum(id % 7 + 1)::BIGINT AS pop, count(*)::DOUBLE AS area, sum(id % 5)::BIGINT AS dem, 0::BIGINT AS missing FROM cell")
def state_summary(spark, d):
    return writers.summary(cells(spark, d).withColumn("dem", F.col("id") % 5), ["dem"])


_L1 = "x AS (SELECT vec_id % 256 AS r, vec_id * 7 % 256 AS g, vec_id * 13 % 256 AS b, vec_id FROM embeddings)"


@_query(f"WITH {_L1} SELECT vec_id, 255::BIGINT * 16777216 + r * 65536 + g * 256 + b AS packed, r, g, b FROM x")
def colour_pack(spark, d):
    x = _table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 256).alias("r"), (F.col("vec_id") * 7 % 256).alias("g"), (F.col("vec_id") * 13 % 256).alias("b"))
    x = x.withColumn("packed", colour.pack(F.col("r"), F.col("g"), F.col("b"), F.lit(255)))
    u = colour.unpack(F.col("packed"))
    h = colour.rgb_to_hsl(u.r, u.g, u.b)
    back = colour.hsl_to_rgb(h.h, h.s, h.l)
    return x.select("vec_id", "packed", back.r.alias("r"), back.g.alias("g"), back.b.alias("b"))


# ---- apportioning, absorbing --------------------------------------------------------------------------


@_query(f"WITH {CELL}, t AS (SELECT community_id, sum(1 + id % 2) AS total, count(*) AS n FROM cell GROUP BY 1) SELECT CASE WHEN n > 1 THEN community_id || '_s' || c.id ELSE community_id::VARCHAR END AS id, c.id AS part, round(100.0::DOUBLE * (1 + c.id % 2) / total, 6) AS pop FROM cell c JOIN t USING (community_id)")
def apportion_parts(spark, d):
    c = cells(spark, d)
    wide = geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmin") + SCALE * (1 + F.col("id") % 2), F.col("ymax"))
    n = c.groupBy("community_id").agg(F.count(F.lit(1)).alias("n_parts"))
    parts = c.select(F.col("community_id"), F.col("id").alias("part"), wide.alias("hull"), "holes").join(n, "community_id")
    parts = parts.select(F.col("community_id").cast("string").alias("id"), "part", "hull", "holes", "n_parts", F.lit(100.0).alias("pop"))
    return merge.apportion(parts, ["pop"]).select("id", "part", r6("pop").alias("pop"))


@_query(f"WITH {CELL} SELECT count(*) AS n, sum(id % 7 + 1)::DOUBLE AS pop FROM cell")
def absorbed_population(spark, d):
    c = cells(spark, d).select(F.col("id").cast("string").alias("id"), "hull", "holes", "cx", "cy", "xmin", "xmax", "ymin", "ymax", F.col("pop").cast("double").alias("pop"))
    q = SCALE // 4
    inner = c.select(F.concat("id", F.lit("i")).alias("id"), geo.box_ring(F.col("xmin") + q, F.col("ymin") + q, F.col("xmax") - q, F.col("ymax") - q).alias("hull"), "holes", "cx", "cy", (F.col("xmin") + q).alias("xmin"), (F.col("xmax") - q).alias("xmax"), (F.col("ymin") + q).alias("ymin"), (F.col("ymax") - q).alias("ymax"), (F.col("pop") / 2).alias("pop"))
    outer = c.withColumn("holes", F.array(geo.box_ring(F.col("xmin") + q, F.col("ymin") + q, F.col("xmax") - q, F.col("ymax") - q))).withColumn("pop", F.col("pop") / 2)
    return merge.absorb(outer.unionByName(inner), ["pop"]).agg(F.count(F.lit(1)).alias("n"), F.sum("pop").alias("pop"))


# ---- plans: invariants in place of values -------------------------------------------------------------


def _nodes(spark, d):
    """The islands of the land as states, whatever their size."""
    nodes, e = land(spark, d), edges(spark, d)
    rows = nodes.join(graph.components(nodes, e).withColumnRenamed("component", "state"), "id")
    rows = rows.select("state", F.col("id").alias("node_id"), "pop", "area", "cx", "cy", "hull")
    return make.with_neighbours(rows, e), e


@_query(f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, {_REACH} SELECT component AS state, count(*) AS nodes, least(2, count(*))::BIGINT AS communities FROM c GROUP BY 1")
def contraction_invariants(spark, d):
    nodes, _ = _nodes(spark, d)
    return make.initial_plans(nodes, 2).groupBy("state").agg(F.count_distinct("node_id").alias("nodes"), F.count_distinct("community_id").alias("communities"))


#: Every node once, as many communities as asked for (two, where there are two nodes), each in one piece, and the measure no worse than before.
_KEPT = f"WITH RECURSIVE {CELL}, {LAND}, {EDGE}, {_REACH} SELECT component AS state, count(*) AS nodes, least(2, count(*))::BIGINT AS communities, least(2, count(*))::BIGINT AS pieces, true AS no_worse FROM c GROUP BY 1"
#: Also: none of all exchanges is better.
_BEST = _KEPT.replace("true AS no_worse", "true AS no_worse, 0::BIGINT AS open")
#: Also: the tolerance is met where the plan says so, and only there.
_TOLD = _KEPT.replace("true AS no_worse", "true AS no_worse, true AS told")


def _population(members):
    return community.population(members, by="own").select("own", F.col("pop").cast("double").alias("m"))


#: By method the score that must not fall: a mean is told by a sum, as the number of communities stays. Generating and balancing promise the range of populations.
_SCORES = {
    "steepest": plan_checks.by_parts(plan_checks.compactness, F.sum), "compactness": plan_checks.by_parts(plan_checks.compactness, F.min), "anneal": plan_checks.by_parts(plan_checks.population_stdev, lambda m: -F.sum(m)),
    "spread": plan_checks.by_parts(plan_checks.population_stdev, lambda m: -F.sum(m)), "population": plan_checks.by_parts(_population, lambda m: F.min(m) - F.max(m)), "generate": plan_checks.by_parts(_population, lambda m: F.min(m) - F.max(m)),
}


def _refined(spark, d, method, **options):
    """What a refined plan keeps and has reached."""
    score = _SCORES[method]
    nodes, e = _nodes(spark, d)
    nodes, e = cut(nodes, "states"), cut(e, "edges")
    start = cut(make.initial_plans(nodes, 2).select("state", "node_id", "community_id"), "start")
    if method == "generate":
        plan = make.generate_communities(nodes, 2, **options)
    else:
        plan = make.refine(nodes.join(start, ["state", "node_id"]), method, **options)
    plan = cut(plan.select("state", "node_id", "community_id", "status"), "plan")

    def scored(of):
        rows = nodes.join(of.select("state", "node_id", "community_id"), ["state", "node_id"]).withColumn("own", F.concat_ws(":", "state", "community_id"))
        return score(rows.withColumn("x", F.col("state"))).withColumnRenamed("x", "state")

    ends = plan.select(F.col("node_id").alias("id"), F.concat_ws(":", "state", "community_id").alias("own"))
    inner = e.join(ends.select(F.col("id").alias("src"), F.col("own").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("own").alias("b")), "dst").where("a = b").select("src", "dst")
    pieces = graph.components(ends, inner).join(plan.select(F.col("node_id").alias("id"), "state"), "id").groupBy("state").agg(F.count_distinct("component").alias("pieces"))
    rows = plan.groupBy("state").agg(F.count_distinct("node_id").alias("nodes"), F.count_distinct("community_id").alias("communities"))
    better = scored(plan).join(scored(start).withColumnRenamed("score", "before"), "state").select("state", (F.col("score") >= F.col("before") - 1e-9).alias("no_worse"))
    out = rows.join(pieces, "state").join(better, "state")
    if method in ("steepest", "spread"):
        out = out.join(plan_checks.open_exchanges(nodes, e, plan, score).select("state", "open"), "state")
    if method in ("population", "generate"):
        pops = plan.join(nodes.select("state", "node_id", "pop"), ["state", "node_id"]).groupBy("state", "community_id", "status").agg(F.sum("pop").alias("pop"))
        near = F.max(F.abs(F.col("pop") - F.col("mean")) / F.col("mean")) <= options.get("percent", 1.0) / 200
        means = pops.groupBy("state").agg(F.avg("pop").alias("mean"))
        told = pops.join(means, "state").groupBy("state").agg((near == (F.first("status") == "met")).alias("told"))
        out = out.join(told, "state")
    return out


@_query(_BEST)
def refine_steepest(spark, d):
    return _refined(spark, d, "steepest", measure="quick_compactness")


@_query(_KEPT)
def refine_annealing(spark, d):
    return _refined(spark, d, "anneal", measure="population_stdev")


@_query(_KEPT)
def refine_compactness(spark, d):
    return _refined(spark, d, "compactness")


@_query(_TOLD)
def refine_population(spark, d):
    return _refined(spark, d, "population", percent=5.0)


@_query(_BEST)
def refine_spread(spark, d):
    return _refined(spark, d, "spread", measure="population_stdev")


@_query(_TOLD)
def generate_communities(spark, d):
    return _refined(spark, d, "generate")


# ---- equality, editing, drawing ----------------------------------------------------------------------


@_query(f"WITH {CELL} SELECT id, id % 3 <> 0 AS ring, id % 3 <> 0 AS polygon FROM cell")
def equal_shapes(spark, d):
    c = cells(spark, d)
    moved = F.when(F.col("id") % 3 == 0, geo.affine(F.col("hull"), F.lit(1), F.lit(1.0), F.lit(1), F.lit(0.0))).otherwise(geo.affine(F.col("hull"), F.lit(1), F.lit(0.0), F.lit(1), F.lit(0.0)))
    own = geo.affine(F.col("hull"), F.lit(1), F.lit(0.0), F.lit(1), F.lit(0.0))
    shape = lambda r: F.struct(r.alias("hull"), F.col("holes").alias("holes"))
    return c.select("id", geo.equal(own, moved).alias("ring"), geo.equal(shape(own), shape(moved)).alias("polygon"))


@_query(f"WITH {CELL}, {LAND} SELECT a.id AS a, b.id AS b, abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1 AS one FROM land a JOIN land b ON a.id < b.id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1")
def union_test(spark, d):
    a = land(spark, d).select(F.col("id").alias("a"), F.col("hull").alias("ring"), "xmin", "xmax", "ymin", "ymax")
    b = land(spark, d).select(F.col("id").alias("b"), "hull", "xmin", "xmax", "ymin", "ymax")
    return spatial.box_join(a, b).where("a < b").select("a", "b", geo.union_is_one(F.col("ring"), F.col("hull")).alias("one"))


@_query(f"WITH {CELL} SELECT id, 2 AS rings, 2::DOUBLE * {SCALE} * {SCALE} AS area, 0 AS touches FROM cell")
def split_touching_rings(spark, d):
    """A cell and the one diagonally above it as one ring that touches itself in their common corner."""
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    x2, y2 = x1 + SCALE, y1 + SCALE
    eight = F.array(*[geo.point(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1), (x0, y1))])
    rings = F.col("rings")
    total = F.aggregate(rings, F.lit(0.0), lambda t, r: t + geo.area(r))
    left = F.aggregate(rings, F.lit(0), lambda t, r: t + F.size(geo.repeated_vertices(r)))
    return cells(spark, d).select("id", geo.simple_rings(eight).alias("rings")).select("id", F.size(rings).alias("rings"), total.alias("area"), left.alias("touches"))


@_query(f"WITH {CELL} SELECT id AS node_id, CASE WHEN id = 2 THEN 99 ELSE gx // 3 END AS community_id FROM cell WHERE id <> 1")
def precinct_moves(spark, d):
    a = assignment(spark, d)
    return community.with_precinct(community.without_precinct(a, 1, 0), 2, 99)


@_query(f"WITH {PV}, {PRE}, {TV}, m AS (SELECT community_id, party, avg(votes::DOUBLE / total) AS mean FROM tv GROUP BY ALL), l AS (SELECT k.community_id, p.ordinal, p.party, coalesce(m.mean, 0) AS mean FROM (SELECT DISTINCT community_id FROM m) k CROSS JOIN (VALUES (1, 'dem'), (2, 'rep'), (3, 'green')) p(ordinal, party) LEFT JOIN m USING (community_id, party)) SELECT community_id, ordinal, party, round(mean, 6) AS mean FROM l UNION ALL SELECT community_id, 0, 'other', round(1 - sum(mean), 6) FROM l GROUP BY 1")
def ordered_parties(spark, d):
    means = community.party_means(_total_votes(spark, d))
    return community.ordered_parties(means, ["dem", "rep", "green"]).withColumn("mean", r6("mean"))


@_query(f"WITH {_PT}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, least(800::DOUBLE / (max(x) - min(x)), 600::DOUBLE / (max(y) - min(y))) AS s FROM pt) SELECT vec_id, round((x - x0) * s + (800 - (x1 - x0) * s) / 2, 6) AS x, round(600 - ((y - y0) * s + (600 - (y1 - y0) * s) / 2), 6) AS y FROM pt, b")
def canvas_points(spark, d):
    return drawing.fit_to_canvas(points(spark, d).select("vec_id", "x", "y"), 800, 600).select("vec_id", r6("x").alias("x"), r6("y").alias("y"))


@_query("WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS t FROM embeddings) SELECT vec_id, trunc(255 * least(1, 1 + greatest(least(t, 1), -1)))::INT AS red, trunc(255 * least(1, 1 - greatest(least(t, 1), -1)))::INT AS blue, rpad(repeat('=', floor(greatest(least(t, 1), 0) * 30)::INT), 30, ' ') AS bar, round(10 + 30 * t, 6) AS mixed FROM x")
def lean_colours(spark, d):
    t = F.col("embedding")[0].cast("double")
    rows = drawing.coloured_by_lean(_table(spark, d, "embeddings"), t)
    return rows.select("vec_id", F.col("colour.r").alias("red"), F.col("colour.b").alias("blue"), text.progress_bar(t).alias("bar"), r6(colour.lerp(F.lit(10.0), F.lit(40.0), t)).alias("mixed"))


@_query(f"WITH {CELL} SELECT id, (id % 7 + 1) * pow({SCALE}, 2) AS area, 4 * (3 + id % 5)::DOUBLE AS hull, 'M ' || xmin || ' ' || ymin AS start FROM cell")
def shape_rows(spark, d):
    """Areas of multipolygons, perimeters with holes, and SVG paths of the cells."""
    c = cells(spark, d)
    part = F.struct("hull", "holes")
    many = F.transform(F.sequence(F.lit(1), F.col("pop").cast("int")), lambda _: part)
    side = (3 + F.col("id") % 5) / 2.0
    box = lambda r: geo.box_ring(-r, -r, r, r)
    ring = geo.polygon_perimeter(box(side / 2), F.array(box(side / 2)))
    rows = drawing.map_rows(c, F.col("hull"), F.lit("grey"), id=F.col("id"), area=geo.multipolygon_area(many), hull=ring)
    return rows.select("id", "area", "hull", F.substring_index(F.regexp_replace("path", r"\.0", ""), " L ", 1).alias("start"))


@_query("SELECT vec_id, 3 + vec_id % 6 AS n, round((3 + vec_id % 6) * 2 * sin(pi() / (3 + vec_id % 6)), 6) AS length, round((3 + vec_id % 6) / 2.0::DOUBLE * sin(2 * pi() / (3 + vec_id % 6)), 6) AS area, true AS holds FROM embeddings")
def regular_rings(spark, d):
    n = (3 + F.col("vec_id") % 6).cast("int")
    ring = geo.regular_ring(n, F.lit(1.0))
    big = geo.box_ring(F.lit(-2.0), F.lit(-2.0), F.lit(2.0), F.lit(2.0))
    return _table(spark, d, "embeddings").select("vec_id", F.size(ring).cast("long").alias("n"), r6(geo.perimeter(ring)).alias("length"), r6(geo.area(ring)).alias("area"), geo.first_inside(ring, big).alias("holds"))


@_query(f"WITH {CELL}, m AS (SELECT community_id, avg(xmin + {SCALE // 2}) AS mx, avg(ymin + {SCALE // 2}) AS my, count(*) * {SCALE}::DOUBLE * {SCALE} AS area, sum(id % 7 + 1)::BIGINT AS pop FROM cell GROUP BY 1), k AS (SELECT any_value(area) / nullif(pi() * max((xmin + {SCALE // 2} - mx) ** 2 + (ymin + {SCALE // 2} - my) ** 2), 0) AS c FROM cell JOIN m USING (community_id) GROUP BY community_id), i AS (SELECT sum(pop)::BIGINT // count(*) AS ideal FROM m), r AS (SELECT 1 - abs(1 - pop::DOUBLE / ideal) AS r FROM m, i) SELECT round(((SELECT avg(c) FROM k) + avg(CASE WHEN r >= 0.99 THEN 1.0::DOUBLE ELSE r END)) / 2, 6) AS metric, (SELECT sum(area) FROM m) AS area FROM r")
def scalarized_metric(spark, d):
    c = cells(spark, d)
    metric = community.scalarized(community.quick_compactness(c), community.population(c))
    return metric.select(r6("metric").alias("metric")).join(community.areas(c).agg(F.sum("area").alias("area")))  # one row each


# ---- files --------------------------------------------------------------------------------------------


@_query(f"WITH {PV} SELECT id, party, votes FROM pv WHERE party IN ('dem', 'rep', 'green')")
def delimited_source(spark, d):
    """An election table written as tab-separated text, its source kind told by suffix, read under a key map."""
    wide = _wide(spark, d, ("dem", "rep", "green"))
    name = shared_path(spark, "votes") + ".tab"
    line = F.concat_ws("\t", F.concat(F.lit('"'), "id", F.lit('"')), *[F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise("none") for c in ("dem", "rep", "green")])
    head = spark.range(1).select(F.lit("id\tD08\tR08\tG08").alias("line"))
    writers.write_text(head.union(wide.select(line)), name)
    assert tables.reader_for(name) == ("tab", "none")
    keys = tables.parse_keys('{"ELE": "id", "DEM": "D08", "REP": "R08", "GRE": "G08"}')
    rows = tables.read_delimited(spark, name).where(F.col("cells")[0] != "id")
    cells_ = rows.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(("id", "D08", "R08", "G08"))])
    return tables.votes_long(cells_, keys["ELE"], tables.party_columns(keys)).select(F.col("id").cast("long").alias("id"), "party", "votes")


@_query(f"WITH {CELL}, k AS (SELECT DISTINCT gy FROM cell), n AS (SELECT gy, row_number() OVER (ORDER BY gy) - 1 AS p FROM k) SELECT id, p AS community_id, CASE WHEN gy % 3 = 1 THEN NULL ELSE gy + 0.5::DOUBLE END AS absolute, CASE WHEN gy % 3 = 1 THEN NULL ELSE gy * 2.0::DOUBLE END AS collapsed, CASE WHEN gy % 3 = 1 THEN NULL ELSE gy::DOUBLE END AS dem FROM cell JOIN n USING (gy)")
def quantified_plan(spark, d):
    """Scores written as the three lines of a score file, some of them no numbers, read and put to a plan by position."""
    c = cells(spark, d).withColumn("gy", F.expr("id div 10"))
    s = c.select("gy").distinct()
    odd = F.col("gy") % 3 == 1
    scores = s.select(F.col("gy").alias("district_id"), F.when(odd, "x").otherwise((F.col("gy") + 0.5).cast("string")).alias("absolute"), (F.col("gy") * 2.0).alias("collapsed"), F.create_map(F.lit("DEM"), F.col("gy").cast("double")).alias("parties"))
    table = tables.quantification_table(writers.quantification_text(scores))
    first = s.select("gy", (F.rank().over(_window("gy")) - 1).alias("community_id"))  # one row per line of cells
    plan = c.drop("community_id").join(first, "gy").select("id", "community_id")
    return tables.quantified_plan(plan, table).select("id", F.col("community_id").cast("long").alias("community_id"), "absolute", "collapsed", F.col("parties")["DEM"].alias("dem"))


@_query(f"WITH {CELL} SELECT id, 2 AS parts, 2::DOUBLE * {SCALE} * {SCALE} - {SCALE // 2}::DOUBLE * {SCALE // 2} AS area, (id % 7 + 1)::DOUBLE AS pop FROM cell")
def geojson_source(spark, d):
    """Cells with a hole and a second part written as GeoJSON features and read again."""
    q = SCALE // 4
    c = cells(spark, d)
    hole = geo.box_ring(F.col("xmin") + q, F.col("ymin") + q, F.col("xmax") - q, F.col("ymax") - q)
    away = geo.box_ring(F.col("xmin") + 100 * SCALE, F.col("ymin"), F.col("xmax") + 100 * SCALE, F.col("ymax"))
    shapes_ = F.array(F.struct(F.col("hull").alias("hull"), F.array(hole).alias("holes")), F.struct(away.alias("hull"), F.col("holes").alias("holes")))
    f = writers.multipolygon_feature(shapes_, F.struct(F.col("id").cast("string").alias("GEOID"), F.col("pop").cast("string").alias("POP100")))
    name = shared_path(spark, "precincts") + ".json"
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), f, F.lit("]}"))
    writers.write_text(c.select(whole), name)
    # one collection per line and file part: lines are files of their own to a JSON reader
    rows = geojson.read_precincts(spark, name, {"GEO": "GEOID", "POP": "POP100"}, lines=True)
    area = geo.polygon_area(F.col("hull"), F.col("holes"))
    return rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("parts"), F.sum(area).alias("area"), F.max("pop").alias("pop"))


@_query(f"WITH {CELL}, {LAND}, {EDGE} SELECT src, dst, a.community_id FROM edge JOIN cell a ON a.id = src")
def state_files(spark, d):
    """States written and read again, and a graph from its node and edge lists."""
    name = shared_path(spark, "state")
    writers.write_state(cells(spark, d).select("id", "community_id", F.col("community_id").alias("state")), name)
    back = spark.read.parquet(name)
    e = graph.light_copy(edges(spark, d))
    texts = e.groupBy("src").agg(F.to_json(F.collect_list(F.array("src", "dst"))).alias("edges")).withColumn("nodes", F.to_json(F.array("src")))
    nodes, pairs = tables.read_graph(F.col("nodes"), F.col("edges"))
    read = texts.select(nodes[0].alias("id"), F.explode(pairs).alias("p")).select("id", F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))
    return graph.precincts_of(read, back.select("id", "community_id").withColumnRenamed("id", "own").withColumn("id", F.col("own"))).join(read, "id").select("src", "dst", "community_id").distinct()


@_query(f"WITH {CELL} SELECT id, round((xmin / {SCALE}::DOUBLE - a.x0) / (a.x1 - a.x0), 9) AS x, round((ymin / {SCALE}::DOUBLE - a.y0) / (a.y1 - a.y0), 9) AS y FROM cell, (SELECT min(gx) AS x0, max(gx) + 1 AS x1, min(gy) AS y0, max(gy) + 1 AS y1 FROM cell) a")
def fitted_rings(spark, d):
    """Rings stretched to the unit box."""
    c = cells(spark, d)
    unit = spark.range(1).select(F.lit(0.0).alias("xmin"), F.lit(1.0).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("ymax"))
    out = merge.fit_to_box(c.select("id", "hull", "xmin", "xmax", "ymin", "ymax"), unit)
    return out.select("id", F.round(F.col("hull")[0].x, 9).alias("x"), F.round(F.col("hull")[0].y, 9).alias("y"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
