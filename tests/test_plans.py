"""Plans under moves: contiguity, border sets, measures of whole plans, ends of refinement, contraction in rounds."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.plans import contraction, kernels, make


def grid(n, rng=None, holes=0.0):
    cells = [i for i in range(n * n) if not rng or rng.random() >= holes]
    held = set(cells)
    near = {i: {j for j in (i - 1 if i % n else -1, i + 1 if i % n < n - 1 else -1, i - n, i + n) if j in held} for i in cells}
    return kernels.State(near, {i: 1.0 + i % 3 for i in cells}, dict.fromkeys(cells, 1.0), {i: (i % n + 0.5, i // n + 0.5) for i in cells}, shares={i: (0.1 * (i % 5), None if i % 7 == 0 else 0.5) for i in cells}, votes={i: (i % 5 + 1.0, (i * 7) % 6 + 1.0) for i in cells})


def whole(plan):
    return all(plan.connected(m) and m for m in plan.members.values())


@pytest.mark.parametrize("seen", [0, 6, 400])
@pytest.mark.parametrize("seed", range(6))
def test_moves_are_those_of_a_search(seed, seen, monkeypatch):
    monkeypatch.setattr(kernels.Plan, "_SEEN", seen)
    rng = random.Random(seed)
    n = 40
    near = {i: set() for i in range(n)}
    for i in range(1, n):
        for j in {rng.randrange(i), *([rng.randrange(n)] if rng.random() < 0.7 else [])} - {i}:
            near[i].add(j)
            near[j].add(i)
    state = kernels.State(near)
    plan = kernels.Plan(state, kernels.random_contraction(state, 4, seed))
    for _ in range(300):
        pairs = sorted({(a, plan.of[b]) for a in near for b in near[a] if plan.of[a] != plan.of[b]})
        assert plan.border() == pairs
        for node, to in pairs:
            own = plan.members[plan.of[node]]
            assert plan.may_move(node, to) == (len(own) > 1 and plan.connected(own - {node}))
        for c, nodes in plan.members.items():
            assert plan.cuts(c) == {x for x in nodes if not plan.connected(nodes - {x})}
            plan._cuts.clear()
        plan.move(*pairs[rng.randrange(len(pairs))])
    assert whole(plan)


def test_a_community_in_pieces_stays_as_it_is_or_mends():
    state = kernels.State({i: {i - 1, i + 1} & set(range(7)) for i in range(7)})
    plan = kernels.Plan(state, {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1})
    assert plan.may_move(0, 1) and not plan.may_move(3, 1)
    assert plan.move(0, 1) and plan.may_move(3, 1)


def test_draws_are_even_at_225_nodes():
    state = grid(15)
    plan = kernels.Plan(state, {i: i % 15 // 5 for i in state.near})
    ways = [p for p in plan.border() if plan.may_move(*p)]
    rng, n = random.Random(1), 200 * len(ways)
    seen = Counter(kernels._possible(plan, rng) for _ in range(n))
    assert set(seen) == set(ways)
    chi = sum((seen[w] - 200) ** 2 / 200 for w in ways)
    assert chi < len(ways) - 1 + 4 * (2 * (len(ways) - 1)) ** 0.5


def test_no_exchange_at_all():
    state = kernels.State({0: {1}, 1: {0}}, {0: 1, 1: 5})
    plan = kernels.Plan(state, {0: 0, 1: 1})
    assert kernels.anneal(plan, kernels.population_stdev).of == {0: 0, 1: 1}
    state.centre.update({0: (0, 0), 1: (1, 0)})
    assert kernels.improve_population(plan.copy()).status == kernels.STUCK


def better(plan, measure, sign):
    now = measure(plan)
    for node, to in plan.border():
        own = plan.of[node]
        if plan.may_move(node, to):
            other = kernels.Plan(plan.state, plan.of | {node: to})
            if sign * (measure(other) - now) > 1e-9:
                yield node, own, to


@pytest.mark.parametrize("measure,sign", [(kernels.least_compact, 1), (kernels.efficiency_gap, -1), (kernels.population_range, -1), (kernels.PlanMeasure.of(kernels.partisanship_stdev), -1)])
def test_steepest_on_measures_of_the_plan(measure, sign):
    state = grid(8)
    start = kernels.Plan(state, kernels.random_contraction(state, 4, 2))
    first = next(better(start, measure, sign), None)
    end = kernels.steepest(start.copy(), measure, maximize=sign > 0)
    assert whole(end) and not list(better(end, measure, sign))
    assert sign * (measure(end) - measure(start)) > 0 or first is None


def test_sums_are_those_of_the_members():
    state = grid(6)
    plan = kernels.Plan(state, kernels.random_contraction(state, 3, 1))
    for c, nodes in plan.members.items():
        pops = [state.pop[n] for n in nodes]
        assert kernels.population(plan, c) == sum(pops) and kernels.population_stdev(plan, c) == pytest.approx(np.std(pops))
        columns = [[v for v in col if v is not None] for col in zip(*(state.shares[n] for n in nodes))]
        assert kernels.partisanship_stdev(plan, c) == pytest.approx(np.mean([np.std(v) if v else 0.0 for v in columns]), abs=1e-7)
    for measure in (kernels.population, kernels.population_stdev, kernels.quick_compactness):
        parts = kernels.Parts(plan, measure)
        for node, to in plan.border():
            other = kernels.Plan(state, plan.of | {node: to})
            if plan.may_move(node, to):
                for c, v in parts.after(node, to).items():
                    assert v == pytest.approx(measure(other, c), abs=1e-9)


def test_weights_give_near_ones_and_take_far_ones_first():
    rng = random.Random(3)
    draws = Counter(kernels._drawn({1: 1.0, 2: 3.0, 3: 0.0}, rng)[0] for _ in range(4_000))
    assert draws[3] == 0 and 2_800 < draws[2] < 3_200
    state = grid(9)
    start = kernels.Plan(state, kernels.random_contraction(state, 3, 5))
    plans = {far: kernels.improve_population(start.copy(), 2.0, far_first=far) for far in (False, True)}
    assert plans[False].of != plans[True].of and all(whole(p) and p.status for p in plans.values())


@pytest.mark.parametrize("percent,ends", [(5.0, {kernels.MET}), (1e-9, {kernels.SEEN, kernels.STUCK})])
def test_balancing_tells_how_it_ended(percent, ends):
    state = grid(4)
    state.pop = {i: 1.0 for i in state.near} if percent > 1 else {i: 1.0 + i % 2 * 0.37 + i * 0.001 for i in state.near}
    plan = kernels.improve_population(kernels.Plan(state, kernels.random_contraction(state, 2, 4)), percent)
    off = max(abs(kernels.population(plan, c) - sum(state.pop.values()) / 2) for c in plan.members)
    assert plan.status in ends and whole(plan)
    assert (plan.status == kernels.MET) == (off <= sum(state.pop.values()) / 2 * percent / 200)
    odd = grid(9)
    odd.pop = {i: 1 + i * 0.0137 for i in odd.near}  # no three parts are equal
    tired = kernels.improve_population(kernels.Plan(odd, kernels.random_contraction(odd, 3, 1)), 1e-9, patience=3)
    assert tired.status in (kernels.TIRED, kernels.STUCK)


def test_ten_thousand_nodes():
    state = grid(100)
    start = kernels.Plan(state, {i: min(i % 100 // 7, 9) for i in state.near})
    even = kernels.improve_population(start.copy(), 0.2, patience=50)
    assert whole(even) and even.status == kernels.MET
    cool = kernels.anneal(start.copy(), kernels.population_range, epochs=2_000)
    assert whole(cool) and kernels.population_range(cool) <= kernels.population_range(start)
    up = kernels.steepest(start.copy(), kernels.population_range, maximize=False, rounds=5)
    assert whole(up) and kernels.population_range(up) < kernels.population_range(start)


def test_contraction_in_rounds(spark):
    def lattice(state, n):
        e = [(state * 10_000 + i, state * 10_000 + j) for i in range(n * n) for j in ((i + 1) if i % n < n - 1 else -1, i + n) if 0 <= j < n * n]
        return [(state, state * 10_000 + i) for i in range(n * n)], e

    rows, links = [], []
    for state, n in ((1, 20), (2, 3), (3, 1)):
        a, b = lattice(state, n)
        rows, links = rows + a, links + b
    rows += [(4, 40_000 + i) for i in range(8)]  # eight components
    nodes, edges = spark.createDataFrame(rows, "state int, node_id long"), spark.createDataFrame(links, "src long, dst long")
    out = contraction.communities(nodes, edges, 5, seed=1).persist()
    assert sorted((r.state, r.node_id) for r in out.collect()) == sorted(rows)
    counts = {r.state: r.n for r in out.groupBy("state").agg(F.count_distinct("community_id").alias("n")).collect()}
    assert counts == {1: 5, 2: 5, 3: 1, 4: 8}
    of = {r.node_id: (r.state, r.community_id) for r in out.collect()}
    near = {n: set() for _, n in rows}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    plan = kernels.Plan(kernels.State(near), {n: hash(c) for n, c in of.items()})
    assert whole(plan)
    again = {r.node_id: (r.state, r.community_id) for r in contraction.communities(nodes.repartition(3), edges, 5, seed=1).collect()}
    assert again == of


def test_refined_plans_have_a_status(spark):
    state = grid(4)
    rows = [(1, i, sorted(m), float(state.pop[i]), 1.0, *state.centre[i], i % 4 // 2, list(state.votes[i])) for i, m in state.near.items()]
    nodes = spark.createDataFrame(rows, "state int, node_id long, near array<long>, pop double, area double, cx double, cy double, community_id int, votes array<double>")
    for method, options, want in (("population", {"percent": 50.0}, "met"), ("steepest", {"measure": "efficiency_gap", "maximize": False}, "no better exchange"), ("steepest", {"measure": "least_compact", "rounds": 1}, "rounds over"), ("anneal", {"measure": "population_range", "epochs": 50}, "cooled")):
        out = make.refine(nodes, method, **options).collect()
        assert {r.status for r in out} == {want} and len(out) == 16
    assert {r.status for r in make.generate_communities(nodes.drop("community_id"), 2, percent=50.0).collect()} == {"met"}


@pytest.mark.parametrize("k", [2, 3])
def test_annealing_small_states_works_each_part_out_once(k, monkeypatch):
    state, asked = grid(4), Counter()
    one = kernels.Plan(state, kernels.random_contraction(state, k, 3))

    def uneven(plan, c):
        asked[c, tuple(sorted(plan.members[c]))] += 1
        return kernels.population_stdev(plan, c)

    cool = kernels.anneal(one.copy(), uneven)
    assert set(asked.values()) == {1}
    if k == 2:  # the best of all plans
        sides = [{i for i in state.near if b >> i & 1} for b in range(1, 2**15)]
        plans = [kernels.Plan(state, {i: int(i in s) for i in state.near}) for s in sides if one.connected(s) and one.connected(set(state.near) - s)]
        assert kernels.average(cool, uneven) == pytest.approx(min(kernels.average(p, kernels.population_stdev) for p in plans))
    # the same exchanges as a plan's own, with their scores, also where little is kept
    monkeypatch.setattr(kernels.Met, "PLANS", 5)
    measure = kernels.PlanMeasure.of(kernels.population_stdev)
    met, rng = kernels.Met(one, measure), random.Random(k)
    at = met.first
    for _ in range(30):
        plan = met.plan(at)
        tried = [plan.copy() for _ in plan.border()]
        want = sorted((tuple(sorted(p.of.items())), measure(p)) for p, way in zip(tried, plan.border()) if p.move(*way))
        assert whole(plan) and sorted((tuple(sorted(met.plan(to).of.items())), met.score(to)) for to, _ in met.ways(at)) == [(of, pytest.approx(v)) for of, v in want]
        at = rng.choice(met.ways(at))[0]
    assert len(met._scores) <= 5


def test_states_are_spread_over_tasks(spark):
    state = grid(2)
    nodes = spark.createDataFrame([(s, i, sorted(m)) for s in range(40) for i, m in state.near.items()], "state int, node_id long, near array<long>")
    out = make.initial_plans(nodes, 2).withColumn("task", F.spark_partition_id())
    assert out.count() == 160 and out.select("task").distinct().count() > 8
