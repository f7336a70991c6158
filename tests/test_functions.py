"""Column functions, sources, operators and kernels on small inline fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import colour, geometry as geo, text, votes as vt
from wardline.operators import community, fairness, graph, merge, shapes, spatial
from wardline.plans import kernels, make
from wardline.schema import POLYGON, RING
from wardline.sources import geojson, tables, writers


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4))


@pytest.fixture(scope="module")
def shapes_df(spark):
    return spark.createDataFrame([(1, SQUARE), (2, ring((4, 0), (8, 0), (8, 4), (4, 4))), (3, ring((8, 4), (9, 4), (9, 5), (8, 5)))], f"id long, hull {RING}")


def test_numbers_and_text(spark):
    df = spark.createDataFrame([("12",), ("+3.",), ("-4.5",), ("7.x",), ("NA",), ("",), (None,), ("1e3",)], "s string")
    got = df.select(text.is_number(F.col("s")), text.to_number(F.col("s"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False, False, False, False]
    assert [r[1] for r in got] == [12, 3, -4.5, 7, 0, 0, 0, 1000]
    r = one(spark, a=text.split(F.lit("a||b|"), "|"), k=text.composite_key(F.lit("'5"), F.lit("x'")), z=text.zero_padded(F.lit(7)), w=text.zero_padded(F.lit(1234)), b=text.progress_bar(F.lit(0.5), 4))
    assert r.a == ["a", "", "b", ""] and r.k == "5x" and r.z == "007" and r.w == "1234" and r.b == "==  "


def test_votes(spark):
    r = one(spark, tie=vt.lean(F.lit(1), F.lit(1)), none=vt.lean(F.lit(0), F.lit(0)), ctie=vt.community_lean(F.lit(1), F.lit(1)), res=vt.residual(F.lit(3), F.lit(5)), raw=vt.residual(F.lit(3), F.lit(5), clamp=False), s=vt.share(F.lit(1), F.lit(0)))
    assert (r.tie, r.none, r.ctie, r.res, r.raw, r.s) == (0.5, -1.0, -0.5, 0, -2, None)
    with pytest.raises(Exception, match="negative population"):
        one(spark, p=vt.checked_population(F.lit(-3)))
    with pytest.raises(Exception, match="outside"):
        one(spark, p=vt.collapse(F.lit(2.0), F.lit(0.5)))


def test_ring_measures(shapes_df):
    h = F.col("hull")
    r = shapes_df.where("id = 1").select(geo.signed_area(h), geo.perimeter(h), geo.centroid(h), F.size(geo.segments(geo.closed(h))), geo.signed_area(F.reverse(h))).first()
    assert (r[0], r[1], r[2].x, r[2].y, r[3], r[4]) == (16, 16, 2, 2, 4, -16)


def test_distance_is_squared_where_it_says_so(spark):
    args = [F.lit(float(v)) for v in (0, 0, 4, 4)]
    r = one(spark, d=geo.distance(*args), q=geo.squared_distance(*args))
    assert r.d == pytest.approx(4 * math.sqrt(2)) and r.q == 32


def test_point_in_ring(spark, shapes_df):
    pts = spark.createDataFrame([(1, 1), (0, 2), (4, 4), (5, 1), (2, 0), (-1, 4)], "x int, y int")
    got = pts.join(shapes_df.where("id = 1")).select(geo.point_in_ring(F.col("x"), F.col("y"), F.col("hull"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, True, False]


def test_regular_rings_approach_the_circle(spark):
    r = one(spark, a=geo.area(geo.regular_ring(F.lit(44), F.lit(1000.0))))
    assert 0.99 < r.a / (math.pi * 1e6) < 1


def test_rook_adjacency_needs_a_line(shapes_df):
    assert [tuple(r) for r in spatial.rook_adjacency(shapes_df).collect()] == [(1, 2)]
    assert [tuple(r) for r in spatial.rook_adjacency(shapes_df, collinear=True).collect()] == [(1, 2)]


def test_collinear_overlap_without_shared_ends(spark):
    df = spark.createDataFrame([(1, SQUARE), (2, ring((4, 1), (6, 1), (6, 3), (4, 3)))], f"id long, hull {RING}")
    assert spatial.rook_adjacency(df).count() == 0
    assert [tuple(r) for r in spatial.rook_adjacency(df, collinear=True).collect()] == [(1, 2)]


def test_overlap_area_of_general_shapes():
    sq = [np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)]
    assert spatial.overlap_area(sq, [np.array([(2, 2), (6, 2), (6, 6), (2, 6)], float)]) == pytest.approx(4)
    holed = [*sq, np.array([(1, 1), (3, 1), (3, 3), (1, 3)], float)]
    assert spatial.overlap_area(holed, sq) == pytest.approx(12)
    star = [np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)]
    assert spatial.overlap_area(star, sq) == pytest.approx(10)
    rng = np.random.default_rng(0)
    a, b = rng.random((7, 2)), rng.random((3, 2))
    order = np.argsort(np.arctan2(*(a - a.mean(0)).T))
    p = rng.random((200_000, 2))

    def inside(r):
        q = np.roll(r, -1, axis=0)
        hit = (r[:, 1] > p[:, 1:]) != (q[:, 1] > p[:, 1:])
        return (hit & (p[:, :1] < r[:, 0] + (p[:, 1:] - r[:, 1]) * (q[:, 0] - r[:, 0]) / (q[:, 1] - r[:, 1]))).sum(1) % 2 == 1

    assert spatial.overlap_area([a[order]], [b]) == pytest.approx((inside(a[order]) & inside(b)).mean(), abs=0.01)


def test_dissolve_merges_and_keeps_holes(spark):
    cells = [(1, ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    got = shapes.dissolve(spark.createDataFrame(cells, f"community_id int, hull {RING}")).collect()
    areas = sorted(sum(p.x * q.y - q.x * p.y for p, q in zip(r.ring, r.ring[1:] + r.ring[:1])) / 2 for r in got)
    assert areas == [-1, 9] and sorted(r.is_hull for r in got) == [False, True]


def test_smallest_circle_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 30):
        p = rng.normal(size=(n, 2)) * 10 + 1e6
        x, y, r = shapes.smallest_circle(p)
        assert np.hypot(*(p - (x, y)).T).max() <= r * (1 + 1e-6) + 1e-6
        best = 0 if n == 1 else min((c for c in _circles(p) if np.hypot(*(p - c[:2]).T).max() <= c[2] * (1 + 1e-7) + 1e-7), key=lambda c: c[2])[2]
        assert r == pytest.approx(best, rel=1e-6)


def _circles(p):
    for i in range(len(p)):
        for j in range(i):
            c = (p[i] + p[j]) / 2
            yield (*c, np.hypot(*(p[i] - c)))
            for k in range(j):
                u, v = p[j] - p[i], p[k] - p[i]
                d = 2 * (u[0] * v[1] - u[1] * v[0])
                o = np.array([v[1] * (u @ u) - u[1] * (v @ v), u[0] * (v @ v) - v[0] * (u @ u)]) / d
                yield (*(p[i] + o), np.hypot(*o))


def test_reock_of_a_square(spark):
    df = spark.createDataFrame([(1, SQUARE, 16.0)], f"community_id int, hull {RING}, area double")
    assert shapes.reock(df).first().reock == pytest.approx(2 / math.pi)


def test_graph_operators(spark):
    nodes = spark.createDataFrame([(0, [0]), (1, [1])], "id long, attrs array<long>")
    edge = spatial.edges_both_ways(spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert graph.contract(edge, 0, 1, 2).count() == 0
    assert [tuple(r) for r in graph.contract_nodes(nodes, 0, 1, 2).collect()] == [(2, [0, 1])]
    assert graph.component_count(graph.components(nodes, edge.limit(0))).first().components == 2
    assert graph.component_count(graph.components(nodes, edge)).first().connected


@pytest.mark.parametrize("few", [0, graph.FEW])
def test_components_by_turns_and_in_one_task(spark, few):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    nodes = spark.createDataFrame([(i,) for i in range(300)], "id long")
    edges = spatial.edges_both_ways(spark.createDataFrame(pairs, "src long, dst long"))
    want = list(range(300))
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.id: r.component for r in graph.components(nodes, edges, few=few).collect()} == dict(enumerate(want))


def nearest_by_brute_force(rows):
    best = {}
    for a, of, ax, ay in rows:
        for b, other, bx, by in rows:
            if of != other and None not in (ax, ay, bx, by):
                found = ((ax - bx) * (ax - bx) + (ay - by) * (ay - by), min(a, b), max(a, b))
                best[of] = min(best.get(of, found), found)
    return best


def scattered(kind, rng):
    if kind == "far clusters":
        return [(i, i % 2, float(x + 1000 * (i % 2)), float(y)) for i, (x, y) in enumerate(rng.normal(0, 30, (300, 2)))]
    if kind == "ties":
        return [(i, i // 60, float(i // 20), float(i % 20)) for i in range(240)]
    if kind == "repeated":
        return [(i, int(rng.integers(4)), float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 3, (200, 2)))]
    if kind == "mixed sizes":
        return [(i, 0 if i < 200 else i, float(x), float(y)) for i, (x, y) in enumerate(rng.lognormal(3, 2, (240, 2)))] + [(999, 5, None, 1.0)]
    return [(i, 0, float(i), 0.0) for i in range(5)] if kind == "one component" else []


@pytest.mark.parametrize("pairs", [0, graph.PAIRS])
@pytest.mark.parametrize("kind", ["far clusters", "ties", "repeated", "mixed sizes", "one component", "none"])
def test_nearest_components_against_brute_force(spark, monkeypatch, kind, pairs):
    rows = scattered(kind, np.random.default_rng(8))
    want = nearest_by_brute_force(rows)
    points = spark.createDataFrame(rows, "id long, component long, cx double, cy double")
    monkeypatch.setattr(graph, "_DEPTH", 30 if pairs else 14)
    got = {r.component: (r.d2, r.a, r.b) for r in graph.nearest_other(points, pairs=pairs).collect()}
    assert got == want
    assert [(r.d2, r.a, r.b) for r in graph.closest_pairs(points, pairs=pairs).collect()] == ([min(want.values())] if want else [])


@pytest.mark.parametrize("cell", [None, 0.5, 500.0])
def test_boxes_of_all_sizes_meet_once(spark, cell):
    rng = np.random.default_rng(4)

    def boxes(n, sizes):
        low = rng.uniform(-100, 100, (n, 2))
        side = rng.lognormal(0, sizes, (n, 2))
        return [(i, float(x), float(x + w), float(y), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(low, side))]

    for a, b in ((boxes(150, 2), boxes(150, 2)), (boxes(200, 0), [(0, -200.0, 200.0, -200.0, 200.0), (1, 5.0, 5.0, 5.0, 5.0)])):
        for one, two in ((a, b), (b, a)):
            left = spark.createDataFrame([*one, (-1, None, None, None, None)], "a long, xmin double, xmax double, ymin double, ymax double")
            right = spark.createDataFrame(two, "b long, xmin double, xmax double, ymin double, ymax double")
            got = sorted((r.a, r.b) for r in spatial.box_join(left, right, cell).collect())
            assert got == sorted((i[0], j[0]) for i in one for j in two if i[1] <= j[2] and j[1] <= i[2] and i[3] <= j[4] and j[3] <= i[4])


def grid(n=10):
    near = {i: set() for i in range(n * n)}
    for i in near:
        for j in ([i + 1] if i % n != n - 1 else []) + ([i + n] if i // n != n - 1 else []):
            near[i].add(j)
            near[j].add(i)
    square = lambda i: np.array([(i % n, i // n), (i % n + 1, i // n), (i % n + 1, i // n + 1), (i % n, i // n + 1)], float)
    return kernels.State(near, {i: 1.0 + i % 3 for i in near}, dict.fromkeys(near, 1.0), {i: (i % n + 0.5, i // n + 0.5) for i in near}, {i: square(i) for i in near}, {i: (0.1 * (i % 5), 0.5) for i in near})


def check(plan, k):
    assert len(plan.members) == k and sorted(plan.of) == list(range(100))
    assert all(plan.connected(m) and m for m in plan.members.values())


def test_contraction_and_refiners_keep_plans_valid():
    state = grid()
    assert sum(map(len, state.near.values())) == 360
    start = kernels.random_contraction(state, 2, 1)
    assert start == kernels.random_contraction(state, 2, 1)
    for k in (2, 5):
        plan = kernels.Plan(state, kernels.random_contraction(state, k, 3))
        check(plan, k)
        before = kernels.average(plan, kernels.quick_compactness)
        better = kernels.improve_compactness(plan.copy(), patience=3)
        check(better, k)
        assert kernels.average(better, kernels.quick_compactness) >= before
        even = kernels.improve_population(plan.copy(), 5.0)
        check(even, k)
        ideal = sum(state.pop.values()) / k
        off = lambda p: max(abs(kernels.population(p, c) - ideal) for c in p.members)  # noqa: B023, E731
        assert off(even) <= off(plan)
        for measure in (kernels.population_stdev, kernels.partisanship_stdev):
            lower = kernels.improve_spread(plan.copy(), measure)
            check(lower, k)
            assert kernels.average(lower, measure) <= kernels.average(plan, measure) + 1e-9
        up = kernels.steepest(plan.copy(), kernels.reock, rounds=3)
        check(up, k)
        assert kernels.average(up, kernels.reock) >= kernels.average(plan, kernels.reock)
        cool = kernels.anneal(plan.copy(), kernels.population_stdev, epochs=200)
        check(cool, k)
        assert kernels.average(cool, kernels.population_stdev) <= kernels.average(plan, kernels.population_stdev) + 1e-9
    check(kernels.generate(state, 4, rounds=2, percent=5.0), 4)


def test_plans_in_parallel(spark):
    state = grid()
    rows = [(s, i, sorted(state.near[i]), state.pop[i]) for s in ("a", "b") for i in state.near]
    df = spark.createDataFrame(rows, "state string, node_id long, near array<long>, pop double")
    got = make.initial_plans(df, 3, [0, 1])
    assert got.count() == 400 and got.groupBy("state", "seed").agg(F.count_distinct("community_id").alias("n")).where("n = 3").count() == 4


def test_fairness_by_hand(spark):
    v = spark.createDataFrame([(1, "dem", 75), (1, "rep", 25), (2, "dem", 60), (2, "rep", 40), (3, "dem", 43), (3, "rep", 57), (4, "dem", 48), (4, "rep", 52)], "district int, party string, votes long")
    dem, rep = (75 - 25) + (60 - 40) + 43 + 48, 25 + 40 + (57 - 43) + (52 - 48)
    assert fairness.efficiency_gap(v).first().gap == pytest.approx(abs(2 * max(dem, rep) - dem - rep) / 400)
    assert {r.party: r.seats for r in fairness.mock_election(v).collect()} == {"dem": 2, "rep": 2}
    d = fairness.declination(v).first()
    theta_r, theta_d = math.atan((0.5 - (0.43 + 0.48) / 2) / 1), math.atan(((0.75 + 0.6) / 2 - 0.5) / 1)
    assert (d.n_rep, d.n_dem) == (2, 2) and d.declination == pytest.approx(2 * (theta_r - theta_d) / math.pi)
    assert fairness.declination(v.where("district < 3")).first().declination is None
    xs = np.linspace(0, 1, 200_001)
    f = np.searchsorted(sorted(1 - s for s in (0.75, 0.6, 0.43, 0.48)), xs, side="right") / 4
    assert fairness.votes_to_seats_area(v).first().area == pytest.approx(np.abs(f - xs).mean(), abs=1e-4)
    assert fairness.votes_to_seats_curve(v).count() == 10


def test_tied_seat_goes_to_the_later_party(spark):
    v = spark.createDataFrame([(1, "dem", 5), (1, "rep", 5), (1, "other", 1)], "district int, party string, votes long")
    assert {r.party: r.seats for r in fairness.mock_election(v).collect()} == {"dem": 0, "rep": 1, "other": 0}


def test_geojson_and_sinks(spark, tmp_path):
    sq = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    features = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": sq}, "properties": {"G": "a", "P": 10, "D": "NA"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[sq[0]], [[[10, 0], [12, 0], [12, 2], [10, 2]]]]}, "properties": {"G": "b", "P": 20, "D": 5}},
    ]
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    p = geojson.read_precincts(spark, f"file://{path}", {"GEO": "G", "POP": "P", "DEM": "D"}).orderBy("id", "part")
    rows = p.collect()
    assert [(r.id, r.part, r.n_parts, r.pop, r.dem) for r in rows] == [("a", 0, 1, 10, None), ("b", 0, 2, 20, 5), ("b", 1, 2, 20, 5)]
    dealt = {r.id: (r.pop, r.dem) for r in merge.apportion(p, ["pop", "dem"]).collect()}
    assert dealt == {"a": (10, 0), "b_s0": (16, 4), "b_s1": (4, 1)}
    text_ = json.loads(writers.feature_collection(p.where("part = 0")).first().text)
    assert [len(f["geometry"]["coordinates"]) for f in text_["features"]] == [2, 1]
    assert geojson.read_districts(spark, f"file://{path}").count() == 3
    bad = spark.createDataFrame([("Point", "[0, 0]")], "k string, c string").select(geojson.parts(F.col("k"), F.col("c")))
    with pytest.raises(Exception, match="invalid geojson"):
        bad.collect()
    writers.write_state(p.withColumn("state", F.lit("vt")), f"file://{tmp_path}/state")
    assert spark.read.parquet(f"file://{tmp_path}/state").count() == 3


def test_tables(spark, tmp_path):
    (tmp_path / "v.tab").write_text('id\tD\tR\n"1"\t5\t7.9\n2\tx\t3\n"1"\t6\t1\n')
    t = tables.read_table(spark, f"file://{tmp_path}/v.tab")
    got = {(r.id, r.party): r.votes for r in tables.votes_long(t, "id", {"dem": "D", "rep": "R"}).collect()}
    assert got == {("1", "dem"): 6, ("1", "rep"): 1, ("2", "rep"): 3}
    assert tables.read_delimited(spark, f"file://{tmp_path}/v.tab").first().cells == ["id", "D", "R"]
    assert tables.reader_for("a.tab", "b.json") == ("tab", "json") and tables.reader_for("a.json") == ("json", "none")
    with pytest.raises(ValueError):
        tables.reader_for("a.xls")
    with pytest.raises(ValueError):
        tables.parse_keys('{"WAT": "x"}')
    plan = spark.createDataFrame([("[['a', 'b'], ['c']]",)], "text string")
    a = tables.plan_assignment(plan)
    assert sorted(map(tuple, a.collect())) == [("a", 0), ("b", 0), ("c", 1)]
    assert writers.plan_text(a).first().text == "[['a', 'b'], ['c']]"
    q = spark.createDataFrame([(0, 0.5, 0.1, {"DEM": 0.4, "REP": 0.6}), (1, 0.25, 0.2, {"DEM": 1.0})], "district_id int, absolute double, collapsed double, parties map<string, double>")
    back = tables.quantification_table(writers.quantification_text(q)).orderBy("community_id").collect()
    assert [(r.absolute, r.collapsed, r.parties) for r in back] == [(0.5, 0.1, {"DEM": 0.4, "REP": 0.6}), (0.25, 0.2, {"DEM": 1.0})]
    two = a.withColumn("state", F.lit("x")).union(a.withColumn("state", F.lit("y")).where("precinct_id <> 'b'"))
    texts = writers.plan_text(two, ["state"])
    assert {r.state: r.text for r in texts.collect()} == {"x": "[['a', 'b'], ['c']]", "y": "[['a'], ['c']]"}
    assert sorted(map(tuple, tables.plan_assignment(texts, by=["state"]).collect())) == sorted((r.state, r.precinct_id, r.community_id) for r in two.collect())
    by_state = writers.quantification_text(q.withColumn("state", F.concat(F.lit("s"), "district_id")), ["state"])
    assert {r.state: r.text for r in by_state.collect()} == {"s0": '0.5\n0.1\n["DEM":0.4,"REP":0.6]', "s1": '0.25\n0.2\n["DEM":1.0]'}
    m = writers.append_measures(spark.range(1), F.lit(0.1), F.lit(0.2), F.lit(0.3))
    assert writers.append_measures(m, F.lit(9), F.lit(9), F.lit(9)).first().DECLINATION == 0.2


def test_absorb_and_fit(spark):
    hole = ring((1, 1), (3, 1), (3, 3), (1, 3))
    df = spark.createDataFrame([("out", SQUARE, [hole], 10.0), ("in", hole, [], 2.0)], f"id string, hull {RING}, holes array<{RING}>, pop double")
    c = geo.centroid(F.col("hull"))
    df = geo.with_box(df, "hull").withColumns({"cx": c.x, "cy": c.y})
    for rule in ("centroid_in_hole", "vertices_in_hull"):
        assert [(r.id, r.pop, r.holes) for r in merge.absorb(df, ["pop"], rule).collect()] == [("out", 12.0, [])]
    target = spark.createDataFrame([(0, 8, 0, 2)], "xmin int, xmax int, ymin int, ymax int")
    r = merge.fit_to_box(df.where("id = 'out'"), target).first()
    assert max(p.x for p in r.hull) == 8 and max(p.y for p in r.hull) == 2


def test_colours(spark):
    r = one(spark, red=colour.hsl_to_rgb(F.lit(0.0), F.lit(1.0), F.lit(0.5)), lean=colour.lean_colour(F.lit(0.0)), h=colour.hues(F.lit(3)), p=colour.svg_path(F.array(geo.point(F.lit(1), F.lit(2)))), m=colour.mix_rgb(colour.rgb(F.lit(0), F.lit(0), F.lit(0)), colour.rgb(F.lit(10), F.lit(20), F.lit(30)), F.lit(0.5)))
    assert tuple(r.red) == (255, 0, 0) and tuple(r.lean) == (255, 0, 255) and r.h == [310, 70, 190] and r.p == "M 1 2 Z" and tuple(r.m) == (5, 10, 15)


def test_population_measures(spark):
    df = spark.createDataFrame([(1, 100), (2, 102), (3, 98)], "community_id int, pop long")
    assert community.within_tolerance(df, 4).first().complete and not community.within_tolerance(df, 3).first().complete
    assert community.worst(df).first().community_id == 2
    assert community.distance_from_population(df).first().closeness == pytest.approx((1 + 0.98 + 0.98) / 3)


def test_islands_are_linked(spark):
    rows = [(i, float(i), 0.0) for i in range(5)] + [(10 + i, 20.0 + i, 0.0) for i in range(3)] + [(50, 100.0, 1.0)]
    nodes = spark.createDataFrame(rows, "id long, cx double, cy double")
    edge = spatial.edges_both_ways(spark.createDataFrame([(i, i + 1) for i in range(4)] + [(10, 11), (11, 12)], "src long, dst long"))
    linked = graph.link_islands(nodes, edge)
    new = {tuple(sorted(r)) for r in linked.collect()} - {tuple(sorted(r)) for r in edge.collect()}
    assert new == {(4, 10), (12, 50)}
    numbers = graph.renumber_by_x(nodes)
    assert [r.node_id for r in numbers.orderBy("id").collect()] == list(range(9))
    assert graph.renumber_edges(linked, numbers).count() == linked.count()


def test_polygon_type_is_readable(spark):
    df = spark.createDataFrame([((SQUARE, []),)], f"p {POLYGON}")
    assert df.select(geo.polygon_area(F.col("p.hull"), F.col("p.holes")), geo.multipolygon_perimeter(F.array("p"))).first()[:] == (16, 16)


def test_exchanges_go_on_until_none_improves():
    square = lambda plan, c: float(len(plan.members[c]) ** 2)

    def path(n):
        return kernels.Plan(kernels.State({i: {i - 1, i + 1} & set(range(n)) for i in range(n)}), {i: int(i > 0) for i in range(n)})

    for plan in (kernels.steepest(path(2100), square, maximize=False), kernels.improve_spread(path(500), square)):
        a, b = map(len, plan.members.values())
        assert a == b


def test_refining_queries_run_at_full_length(monkeypatch):
    from wardline import driver_queries as dq

    seen = {}
    monkeypatch.setattr(dq, "_refined", lambda spark, d, method, **options: seen.update({method: options}))
    monkeypatch.setattr(dq, "_nodes", lambda spark, d: (None, None))
    monkeypatch.setattr(dq.make, "generate_communities", lambda nodes, k, **options: seen.update(generate=options))
    for name in ("refine_steepest", "refine_annealing", "refine_compactness", "refine_spread", "generate_communities"):
        dq.queries()[name](None, "")
    assert not {"rounds", "epochs", "patience"} & {o for options in seen.values() for o in options} and len(seen) == 5


def _nested(spark, n):
    rows = []
    for i in range(n):
        ring = lambda a: [(float(a), float(a)), (100.0 - a, float(a)), (100.0 - a, 100.0 - a), (float(a), 100.0 - a)]
        holes = [ring(10 * i + 6)] if i < n - 1 else []
        rows.append((f"p{i}", ring(10 * i), holes, 50.0, 50.0, 10.0 * i, 100.0 - 10 * i, 10.0 * i, 100.0 - 10 * i, float(2**i)))
    ring = "array<struct<x: double, y: double>>"
    return spark.createDataFrame(rows, f"id string, hull {ring}, holes array<{ring}>, cx double, cy double, xmin double, xmax double, ymin double, ymax double, pop double")


def test_absorb_of_four_nested_precincts(spark):
    df = _nested(spark, 4)
    for rule in ("centroid_in_hole", "vertices_in_hull"):
        assert [(r.id, r.pop) for r in merge.absorb(df, ["pop"], rule).collect()] == [("p0", 15.0)]
    twice = df.where("id = 'p3'").union(df.where("id = 'p3'").selectExpr("'q3' id", "hull", "holes", "cx", "cy", "xmin", "xmax", "ymin", "ymax", "pop"))
    assert [(r.id, r.pop) for r in merge.absorb(twice, ["pop"], "vertices_in_hull").collect()] == [("p3", 16.0)]


def test_scores_keep_their_positions(spark):
    from wardline.sources import tables

    df = spark.createDataFrame([("0.1\tx\t0.3\n1\t2\t3\n[\"DEM\":1]\t[\"DEM\":2]\t[\"DEM\":3]",)], "text string")
    assert sorted(map(tuple, tables.quantification_rows(df).collect())) == [(0, 0.1, 1.0), (2, 0.3, 3.0)]
    assert {r.community_id: r.parties for r in tables.quantification_table(df).collect()} == {0: {"DEM": 1.0}, 2: {"DEM": 3.0}}


def test_shape_and_plan_errors(spark):
    from wardline.errors import PrecinctNotInGroup
    from wardline.functions import geometry as g
    from wardline.operators import community

    a = spark.createDataFrame([(1, 0), (2, 0)], "node_id long, community_id int")
    assert sorted(map(tuple, community.with_precinct(a, 2, 5).collect())) == [(1, 0), (2, 5)]
    with pytest.raises(PrecinctNotInGroup):
        community.without_precinct(a, 1, 7)
    ring = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)],)], "r array<struct<x: double, y: double>>")
    with pytest.raises(Exception, match="not closed"):
        ring.select(g.checked_closed(F.col("r"))).collect()
    with pytest.raises(Exception, match="several parts"):
        ring.select(g.only_part(F.array("r", "r"))).collect()
