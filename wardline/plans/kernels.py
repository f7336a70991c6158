"""Sequential kernels over one state's contiguity graph."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np

from ..operators.shapes import smallest_circle


@dataclass
class State:
    """Precincts of one state: neighbours, and per precinct population, area, centroid, vertices, vote shares and votes."""

    near: dict[int, set[int]]
    pop: dict[int, float] = field(default_factory=dict)
    area: dict[int, float] = field(default_factory=dict)
    centre: dict[int, tuple[float, float]] = field(default_factory=dict)
    vertices: dict[int, np.ndarray] = field(default_factory=dict)
    shares: dict[int, tuple[float | None, ...]] = field(default_factory=dict)
    votes: dict[int, tuple[float, ...]] = field(default_factory=dict)


class Pairs:
    """A set of (node, community) that adds, drops and draws evenly in constant time."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int]] = []
        self.at: dict[tuple[int, int], int] = {}

    def put(self, pair: tuple[int, int], here: bool) -> None:
        if here and pair not in self.at:
            self.at[pair] = len(self.rows)
            self.rows.append(pair)
        elif not here and pair in self.at:
            i, last = self.at.pop(pair), self.rows.pop()
            if last != pair:
                self.rows[i] = last
                self.at[last] = i

    def draw(self, rng: random.Random) -> tuple[int, int]:
        return self.rows[rng.randrange(len(self.rows))]

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(self.rows)


class Plan:
    """An assignment of nodes to communities that moves keep total, disjoint and contiguous.

    A move changes what it touches: the counts of neighbours by community of the nodes around it, and with
    them the set of possible exchanges. Whether a node may leave is told by searches from the nodes around it that meet or end nearby
    or, where they do neither, by its community's articulation points, which are kept until the community changes.
    """

    def __init__(self, state: State, of: dict[int, int], status: str = ""):
        self.state, self.of = state, dict(of)
        #: How the refinement that gave this plan ended.
        self.status = status
        self.members: dict[int, set[int]] = {}
        for n, c in self.of.items():
            self.members.setdefault(c, set()).add(n)
        self.touch: dict[int, dict[int, int]] = {}
        self.ways = Pairs()
        for n in sorted(self.of):
            near = self.touch[n] = {}
            for m in sorted(state.near[n]):
                near[self.of[m]] = near.get(self.of[m], 0) + 1
            for c in near:
                self.ways.put((n, c), c != self.of[n])
        self.whole = {c: self.connected(nodes) for c, nodes in self.members.items()}
        self._cuts: dict[int, set[int]] = {}

    def copy(self) -> "Plan":
        """[G29]"""
        return Plan(self.state, self.of)

    def connected(self, nodes: set[int]) -> bool:
        """[G8]"""
        if not nodes:
            return True
        seen, todo = set(), [next(iter(nodes))]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [m for m in self.state.near[n] if m in nodes and m not in seen]
        return len(seen) == len(nodes)

    def cuts(self, c: int) -> set[int]:
        """Articulation points of a contiguous community: nodes without which it falls apart. One depth-first walk by low links."""
        if (held := self._cuts.get(c)) is not None:
            return held
        nodes, near = self.members[c], self.state.near
        root = next(iter(nodes))
        number, low, out, branches = {root: 0}, {root: 0}, set(), 0
        way = [(root, None, iter(near[root]))]
        while way:
            n, came, rest = way[-1]
            for m in rest:
                if m not in nodes or m == came or m == n:
                    continue
                if m in number:
                    low[n] = min(low[n], number[m])
                else:
                    number[m] = low[m] = len(number)
                    way.append((m, n, iter(near[m])))
                    break
            else:
                way.pop()
                if came is None:
                    continue
                low[came] = min(low[came], low[n])
                if came == root:
                    branches += 1
                elif low[n] >= number[came]:
                    out.add(came)
        if branches > 1:
            out.add(root)
        self._cuts[c] = out
        return out

    def may_leave(self, node: int) -> bool:
        """Whether the node's community is in one piece without it, and not empty."""
        own = self.of[node]
        nodes, near = self.members[own], self.state.near
        if len(nodes) < 2:
            return False
        if not self.whole[own]:
            return self.connected(nodes - {node})
        around = [m for m in near[node] if m in nodes and m != node]
        if len(around) < 2 or own in self._cuts:
            return len(around) < 2 or node not in self._cuts[own]
        return self._meet(node, around, nodes)

    #: Nodes that searches from a node's neighbours may see before the community's articulation points are worked out.
    _SEEN = 400

    def _meet(self, node: int, around: list[int], nodes: set[int]) -> bool:
        """Whether searches from each neighbour, in step, all meet without the node; one that ends before has a piece of its own."""
        whose, near = {m: i for i, m in enumerate(around)} | {node: -1}, self.state.near
        todo = [[m] for m in around]
        joined = list(range(len(around)))

        def front(i: int) -> int:
            while joined[i] != i:
                joined[i] = i = joined[joined[i]]
            return i

        left = len(around)
        while len(whose) < self._SEEN:
            for i in [i for i in range(len(around)) if joined[i] == i]:
                if joined[i] != i:
                    continue
                if not todo[i]:
                    return False
                n = todo[i].pop(0)
                for m in near[n]:
                    if m not in nodes or m == node:
                        continue
                    if m not in whose:
                        whose[m] = i
                        todo[front(i)].append(m)
                    elif (other := front(whose[m])) != (own := front(i)):
                        joined[other] = own
                        todo[own] += todo[other]
                        left -= 1
                        if left == 1:
                            return True
        return node not in self.cuts(self.of[node])

    def may_move(self, node: int, to: int) -> bool:
        return self.of[node] != to and self.touch[node].get(to, 0) > 0 and self.may_leave(node)

    def move(self, node: int, to: int) -> bool:
        """[G15, G16, G17, G18] Give a node to a community next to it, unless its own would vanish or fall apart."""
        if not self.may_move(node, to):
            return False
        own = self.of[node]
        self.members[own].discard(node)
        self.members[to].add(node)
        self.of[node] = to
        self._cuts.pop(own, None)
        self._cuts.pop(to, None)
        self.whole[own] = True
        self.ways.put((node, to), False)
        self.ways.put((node, own), self.touch[node].get(own, 0) > 0)
        for m in sorted(self.state.near[node]):
            near = self.touch[m]
            near[own] -= 1
            near[to] = near.get(to, 0) + 1
            if not near[own]:
                del near[own]
                self.ways.put((m, own), False)
            self.ways.put((m, to), self.of[m] != to)
        return True

    def border(self) -> list[tuple[int, int]]:
        """[J15] (node, foreign community next to it), in order."""
        return sorted(self.ways)

    def giveable(self, c: int) -> dict[int, int]:
        """[J16]"""
        return {n: self.of[max(o)] for n in sorted(self.members[c]) if (o := [m for m in self.state.near[n] if self.of[m] != c])}

    def takeable(self, c: int) -> dict[int, int]:
        """[J17]"""
        return {m: self.of[m] for n in sorted(self.members[c]) for m in sorted(self.state.near[n]) if self.of[m] != c}


#: [U1] A measure of one community.
Measure = Callable[[Plan, int], float]


class Sums:
    """A measure of one community that follows from sums over its nodes: trying a move needs no walk through its members."""

    def __init__(self, row: Callable[[State, int], Iterable[float]], value: Callable[[np.ndarray], object]):
        self.row, self.value = row, value

    def total(self, plan: Plan, c: int) -> np.ndarray:
        return np.array([self.row(plan.state, n) for n in sorted(plan.members[c])], float).sum(axis=0)

    def __call__(self, plan: Plan, c: int) -> object:
        return self.value(self.total(plan, c))


class Parts:
    """What a measure gives for each community of a plan, and would give after a move."""

    #: Moves after which a community's sums are taken anew, so that no rounding adds up.
    ANEW = 256

    def __init__(self, plan: Plan, measure: Measure | Sums):
        self.plan, self.measure = plan, measure
        self.sums = isinstance(measure, Sums)
        self.totals = {c: measure.total(plan, c) for c in plan.members} if self.sums else {}
        self.moves = dict.fromkeys(plan.members, 0)
        self.of = {c: measure.value(self.totals[c]) if self.sums else measure(plan, c) for c in plan.members}

    def after(self, node: int, to: int) -> dict[int, object]:
        """The communities that a move would change, with their new values; the plan stays as it is."""
        plan, own, measure = self.plan, self.plan.of[node], self.measure
        if self.sums:
            row = np.array(measure.row(plan.state, node), float)
            return {own: measure.value(self.totals[own] - row), to: measure.value(self.totals[to] + row)}
        plan.members[own].discard(node)
        plan.members[to].add(node)
        try:
            return {own: measure(plan, own), to: measure(plan, to)}
        finally:
            plan.members[to].discard(node)
            plan.members[own].add(node)

    def settle(self, node: int, own: int, to: int) -> None:
        """After a node has moved: both communities' values."""
        row = np.array(self.measure.row(self.plan.state, node), float) if self.sums else None
        for c, sign in ((own, -1), (to, 1)):
            if self.sums:
                self.moves[c] += 1
                self.totals[c] = self.totals[c] + sign * row if self.moves[c] % self.ANEW else self.measure.total(self.plan, c)
                self.of[c] = self.measure.value(self.totals[c])
            else:
                self.of[c] = self.measure(self.plan, c)


@dataclass(frozen=True)
class PlanMeasure:
    """[U2] A measure of a whole plan from what each community adds to it; a move changes two of these parts."""

    part: Measure | Sums
    whole: Callable[[list], float]

    @classmethod
    def of(cls, measure: "PlanMeasure | Measure | Sums") -> "PlanMeasure":
        """[A5] Measures of one community count by their mean."""
        return measure if isinstance(measure, PlanMeasure) else cls(measure, lambda values: math.fsum(values) / len(values))

    def __call__(self, plan: Plan) -> float:
        return self.whole([self.part(plan, c) for c in plan.members])


class Met:
    """Plans of a small state, each a tuple of its communities' members as bits of one number, with what has been found out about them.

    Few nodes make few plans, so a long search meets the same ones again and again: exchanges, pieces and values are
    worked out once. What is kept is bounded: beyond ``PLANS`` plans all of it goes.
    """

    #: Nodes up to which searches use this, and how many plans are kept.
    NODES, PLANS = 25, 20_000

    def __init__(self, plan: Plan, measure: PlanMeasure):
        self.work, self.measure = plan.copy(), measure
        self.nodes = sorted(plan.of)
        bit = {n: 1 << i for i, n in enumerate(self.nodes)}
        self.node = {b: n for n, b in bit.items()}
        self.near = {b: sum(bit[m] for m in plan.state.near[n] if m != n) for n, b in bit.items()}
        self.order = list(plan.members)
        self.first = tuple(sum(bit[n] for n in plan.members[c]) for c in self.order)
        self.forget()

    def forget(self) -> None:
        self._scores: dict[tuple[int, ...], float] = {}
        self._ways: dict[tuple[int, ...], list[list]] = {}
        self._parts: list[dict[int, object]] = [{} for _ in self.order]
        self._whole: dict[int, bool] = {}
        self._around: dict[int, int] = {}

    def _each(self, members: int) -> Iterator[int]:
        while members:
            low = members & -members
            yield low
            members ^= low

    def whole(self, members: int) -> bool:
        """[G8] Whether nodes are in one piece, and there are any."""
        if (held := self._whole.get(members)) is None:
            near, left, todo = self.near, members, members & -members
            while todo:
                low = todo & -todo
                left &= ~todo
                todo = (todo ^ low) | (near[low] & left)
            held = self._whole[members] = bool(members) and not left
        return held

    def around(self, members: int) -> int:
        """All neighbours of these nodes."""
        if (held := self._around.get(members)) is None:
            held = 0
            for b in self._each(members):
                held |= self.near[b]
            self._around[members] = held
        return held

    def part(self, i: int, members: int) -> object:
        """The measure of the i-th community, were these its members."""
        held = self._parts[i]
        if members not in held:
            c, work = self.order[i], self.work
            own, work.members[c] = work.members[c], {self.node[b] for b in self._each(members)}
            held[members] = self.measure.part(work, c)
            work.members[c] = own
        return held[members]

    def score(self, at: tuple[int, ...]) -> float:
        if (held := self._scores.get(at)) is None:
            if len(self._scores) >= self.PLANS:
                self.forget()
            held = self._scores[at] = self.measure.whole([self.part(i, members) for i, members in enumerate(at)])
        return held

    def ways(self, at: tuple[int, ...]) -> list[list]:
        """[plan, its score or None as long as nobody has asked] of what each exchange that keeps the plan contiguous makes of it."""
        if (held := self._ways.get(at)) is None:
            held = []
            for j, to in enumerate(at):
                around = self.around(to)
                for i, own in enumerate(at):
                    for b in self._each(own & around if i != j else 0):
                        if self.whole(own ^ b):
                            moved = list(at)
                            moved[i], moved[j] = own ^ b, to | b
                            held.append([tuple(moved), self._scores.get(tuple(moved))])
            self._ways[at] = held
        return held

    def plan(self, at: tuple[int, ...]) -> Plan:
        of = {self.node[b]: c for c, members in zip(self.order, at) for b in self._each(members)}
        return Plan(self.work.state, {n: of[n] for n in self.nodes})


def _spread_of(total: np.ndarray) -> float:
    n, one, two = total
    return math.sqrt(max(0.0, two / n - (one / n) ** 2)) if n else 0.0


def _shares_row(state: State, node: int) -> list[float]:
    return [x for s in state.shares[node] for x in ((0.0, 0.0, 0.0) if s is None else (1.0, s, s * s))]


population = Sums(lambda state, n: (state.pop[n],), lambda t: float(t[0]))
population_stdev = Sums(lambda state, n: (1.0, state.pop[n], state.pop[n] ** 2), _spread_of)
partisanship_stdev = Sums(_shares_row, lambda t: float(np.mean([_spread_of(p) for p in t.reshape(-1, 3)])) if len(t) else 0.0)
party_votes = Sums(lambda state, n: state.votes[n], lambda t: t)


def reock(plan: Plan, c: int) -> float:
    """[M16]"""
    points = np.vstack([plan.state.vertices[n] for n in sorted(plan.members[c])])
    _, _, r = smallest_circle(points)
    return sum(plan.state.area[n] for n in sorted(plan.members[c])) / (math.pi * r * r) if r > 0 else 0.0


def quick_compactness(plan: Plan, c: int) -> float:
    """[M19]"""
    p = np.array([plan.state.centre[n] for n in sorted(plan.members[c])], float)
    d2 = ((p - p.mean(axis=0)) ** 2).sum(axis=1).max()
    return sum(plan.state.area[n] for n in sorted(plan.members[c])) / (math.pi * d2) if d2 > 0 else 0.0


def _gap(votes: list[np.ndarray]) -> float:
    """[A25] Efficiency gap: votes that elect nobody, of the party that wastes most against all others', by all votes."""
    v = np.array(votes)
    top = v.max(axis=1, keepdims=True)
    second = np.sort(v, axis=1)[:, -2:-1] if v.shape[1] > 1 else np.zeros_like(top)
    wasted = np.where(v == top, v - second, v).sum(axis=0)
    return float(abs(2 * wasted.max() - wasted.sum()) / v.sum()) if v.sum() else 0.0


def average(plan: Plan, measure: Measure | Sums) -> float:
    """[A5]"""
    return PlanMeasure.of(measure)(plan)


least_compact = PlanMeasure(quick_compactness, min)
population_range = PlanMeasure(population, lambda v: max(v) - min(v))
efficiency_gap = PlanMeasure(party_votes, _gap)


def random_contraction(state: State, k: int, seed: int = 0, tries: int = 100) -> dict[int, int]:
    """[G13, G14, O7, O8, O10, O11] k contiguous communities: edges are contracted one at a time, the one of up to
    ``tries`` random ones that makes the smallest new node. With more components than k, one community per component."""
    rng = random.Random(seed)
    group = {n: n for n in state.near}
    inside = {n: [n] for n in state.near}
    ways = {n: set(m) - {n} for n, m in state.near.items()}
    edges = sorted({(min(a, b), max(a, b)) for a, m in state.near.items() for b in m if a != b})
    while len(inside) > k and edges:
        best = None
        for _ in range(min(tries, len(edges))):
            i = rng.randrange(len(edges))
            a, b = group[edges[i][0]], group[edges[i][1]]
            if a == b:  # inside one node by now
                edges[i] = edges[-1]
                edges.pop()
                if not edges:
                    break
                continue
            size = len(inside[a]) + len(inside[b])
            if best is None or size < best[0]:
                best = (size, a, b)
        if best is None:
            continue
        _, a, b = best
        for n in inside[b]:
            group[n] = a
        inside[a] += inside.pop(b)
        ways[a] = (ways[a] | ways.pop(b)) - {a, b}
    order = {g: i for i, g in enumerate(sorted(inside, key=lambda g: min(inside[g])))}
    return {n: order[g] for n, g in group.items()}


def _rounding(*scores: float) -> float:
    """Differences of sums of these scores that are no more than this may come from rounding alone."""
    return 1e-12 * max(1.0, *map(abs, scores))


def steepest(plan: Plan, measure: PlanMeasure | Measure | Sums, maximize: bool = True, rounds: int | None = None) -> Plan:
    """[G21, U2] The best strictly improving exchange of all, again and again until there is none, or
    ``rounds`` times. What rounding can make of the measures is no improvement.

    The measure is one of the whole plan; one of single communities counts by its mean. What an exchange would make of
    its two communities is worked out once for as long as both stay as they are.
    """
    measure, sign = PlanMeasure.of(measure), 1 if maximize else -1
    parts, known = Parts(plan, measure.part), {}
    score = measure.whole(list(parts.of.values()))
    for _ in count() if rounds is None else range(rounds):
        best = (0.0, None)
        for pair in plan.border():
            if pair not in known:
                known[pair] = parts.after(*pair) if plan.may_move(*pair) else None
            if known[pair]:
                now = measure.whole(list((parts.of | known[pair]).values()))
                if sign * (now - score) > max(best[0], _rounding(score, now)):
                    best = (sign * (now - score), pair)
        if best[1] is None:
            break
        node, to = best[1]
        own = plan.of[node]
        plan.move(node, to)
        parts.settle(node, own, to)
        score = measure.whole(list(parts.of.values()))
        known = {p: v for p, v in known.items() if p[1] not in (own, to) and plan.of[p[0]] not in (own, to)}
    return plan


def anneal(plan: Plan, measure: PlanMeasure | Measure | Sums, seed: int = 0, epochs: int = 40_000, start: float = 30.0, cooling: float = 0.99976) -> Plan:
    """[G22] Minimise the measure (of single communities: its mean): in each epoch one of all possible exchanges,
    drawn evenly; worse ones are kept while start temperature ratios allow. The best plan met.

    Small states walk through plans as ``Met`` keeps them, larger ones change a plan move by move.
    """
    measure, rng = PlanMeasure.of(measure), random.Random(seed)
    if len(plan.of) <= Met.NODES:
        return _anneal_met(Met(plan, measure), rng, epochs, start, cooling)
    parts = Parts(plan, measure.part)
    score = measure.whole(list(parts.of.values()))
    heat, best, least = start, dict(plan.of), score
    for _ in range(epochs):
        pair = _possible(plan, rng)
        if pair is None:
            break
        node, to = pair
        now = measure.whole(list((parts.of | parts.after(node, to)).values()))
        if now < score or heat / start > rng.random():
            own = plan.of[node]
            plan.move(node, to)
            parts.settle(node, own, to)
            score = now
            if score < least:
                best, least = dict(plan.of), score
        heat *= cooling
    return Plan(plan.state, best)


def _anneal_met(met: Met, rng: random.Random, epochs: int, start: float, cooling: float) -> Plan:
    """The same, with each exchange drawn from the list of those that its plan has."""
    best, draw, heat = met.first, rng.random, start
    score = least = met.score(best)
    ways = met.ways(best)
    for _ in range(epochs):
        if not ways:
            break
        way = ways[int(draw() * len(ways))]
        if (now := way[1]) is None:
            now = way[1] = met.score(way[0])
        if now < score or heat / start > draw():
            at, score, ways = way[0], now, met.ways(way[0])
            if score < least:
                best, least = at, score
        heat *= cooling
    return met.plan(best)


def _possible(plan: Plan, rng: random.Random) -> tuple[int, int] | None:
    """An exchange that keeps the plan contiguous, each with the same chance; None if there is none."""
    for _ in range(4 * len(plan.ways)):
        pair = plan.ways.draw(rng)
        if plan.may_move(*pair):
            return pair
    left = [p for p in plan.border() if plan.may_move(*p)]
    return left[rng.randrange(len(left))] if left else None


def improve_compactness(plan: Plan, rounds: int = 10, patience: int = 20) -> Plan:
    """[G23] One community after another, each with a circle of its area about the mean of its centroids as they are at its turn:
    ``rounds`` times it gives border nodes beyond the circle and takes those on or within it.

    The plan whose least compact community is best so far is kept; more than ``patience`` turns without a better one end it.
    """
    least = lambda: min(quick_compactness(plan, c) for c in plan.members)
    best, top, idle, turns = dict(plan.of), least(), 0, count()
    order = sorted(plan.members)
    while idle <= patience:
        c = order[next(turns) % len(order)]
        nodes = plan.members[c]
        middle = np.mean([plan.state.centre[n] for n in sorted(nodes)], axis=0)
        radius = math.sqrt(sum(plan.state.area[n] for n in sorted(nodes)) / math.pi)
        far = lambda n: math.dist(plan.state.centre[n], middle)  # noqa: B023, E731
        for _ in range(rounds):
            moved = sum(plan.move(n, to) for n, to in plan.giveable(c).items() if far(n) > radius)
            moved += sum(plan.move(n, c) for n in plan.takeable(c) if far(n) <= radius)
            if not moved:
                break
        now = least()
        if now > top + 1e-12:
            best, top, idle = dict(plan.of), now, 0
        else:
            idle += 1
    return Plan(plan.state, best)


#: How improve_population ends: all within the tolerance; the worst community cannot give or take; a plan came up again, from which
#: the same draws would follow for ever; or the caller's patience is over.
MET, STUCK, SEEN, TIRED = "met", "cannot move", "plan seen before", "out of patience"


def _drawn(ways: dict[int, float], rng: random.Random) -> list[int]:
    """All nodes in the order of weighted draws without replacement: an exponential race. Nodes of no weight come last."""
    race = {n: (rng.expovariate(1.0) / w if w > 0 else math.inf) for n, w in ways.items()}
    return sorted(ways, key=lambda n: (race[n], n))


def improve_population(plan: Plan, percent: float = 1.0, seed: int = 0, far_first: bool = False, patience: int | None = None) -> Plan:
    """[G24, O4, O9] The best balanced plan met; its ``status`` tells how the search ended (MET and so on).

    Until all populations are within half of ``percent`` of the mean, the community that is furthest from it gives
    or takes border nodes until it has crossed the mean. Nodes are drawn by weight without replacement: with d the squared distance from the
    community's centre, giving by max - d and taking by d; ``far_first``: the other way round. What is drawn follows
    from the seed and the plan, so a plan that comes up again ends the search. ``patience``: so many turns without a better plan end it, too.
    """
    ideal = sum(plan.state.pop.values()) / len(plan.members)
    sizes = Parts(plan, population)
    off = lambda c: sizes.of[c] - ideal
    worst = lambda: max(abs(off(c)) for c in plan.members)
    best, least, idle, seen = dict(plan.of), worst(), 0, set()
    while True:
        if all(abs(off(c)) <= ideal * percent / 200 for c in plan.members):
            return Plan(plan.state, plan.of, MET)
        mark = hash(tuple(sorted(plan.of.items())))
        if mark in seen:
            return Plan(plan.state, best, SEEN)
        if patience is not None and idle > patience:
            return Plan(plan.state, best, TIRED)
        seen.add(mark)
        rng = random.Random(f"{seed}:{mark}")
        c = max(sorted(plan.members), key=lambda c: abs(off(c)))
        give = off(c) > 0
        while off(c) > 0 if give else off(c) < 0:
            middle = np.mean([plan.state.centre[n] for n in sorted(plan.members[c])], axis=0)
            ways = plan.giveable(c) if give else {n: c for n in plan.takeable(c)}
            d = {n: math.dist(plan.state.centre[n], middle) ** 2 for n in ways}
            top, moved = max(d.values(), default=0.0), False
            for n in _drawn({n: (top - d[n] if give != far_first else d[n]) for n in ways}, rng):
                own = plan.of[n]
                if plan.move(n, ways[n]):
                    sizes.settle(n, own, ways[n])
                    moved = True
                    if not (off(c) > 0 if give else off(c) < 0):
                        break
            if not moved:
                return Plan(plan.state, best, STUCK)
        if (now := worst()) < least:
            best, least, idle = dict(plan.of), now, 0
        else:
            idle += 1


def improve_spread(plan: Plan, measure: Measure | Sums, rounds: int | None = None) -> Plan:
    """[G25, G26, O5] Greedy exchanges of the community with the largest measure that lower the mean measure, until
    none does, or ``rounds`` times."""
    parts = Parts(plan, measure)
    for _ in count() if rounds is None else range(rounds):
        changed = False
        for c in sorted(parts.of, key=lambda c: -parts.of[c]):
            for node, to in [*plan.giveable(c).items(), *((n, c) for n in plan.takeable(c))]:
                own = plan.of[node]
                if plan.may_move(node, to):
                    before, after = (parts.of[own], parts.of[to]), tuple(parts.after(node, to).values())
                    if sum(after) < sum(before) - _rounding(*before):
                        plan.move(node, to)
                        parts.settle(node, own, to)
                        changed = True
            if changed:
                break
        if not changed:
            break
    return plan


def generate(state: State, k: int, seed: int = 0, rounds: int = 30, percent: float = 1.0, patience: int | None = None) -> Plan:
    """[G27] Contraction, then rounds of compactness and population refinement until they change nothing.

    The best balanced of the rounds' plans and of the start; its ``status`` is that of the last balancing, or MET where
    an earlier round met the tolerance.
    """
    plan = Plan(state, random_contraction(state, k, seed))
    best, status = dict(plan.of), MET
    for r in range(rounds):
        before = dict(plan.of)
        plan = improve_population(improve_compactness(plan), percent, seed + r, patience=patience)
        status = plan.status
        if _imbalance(plan) <= _imbalance(Plan(state, best)):
            best = dict(plan.of)
        if plan.of == before:
            break
    mean = sum(state.pop.values()) / k
    return Plan(state, best, MET if status == MET or _imbalance(Plan(state, best)) <= mean * percent / 200 else status)


def _imbalance(plan: Plan) -> float:
    ideal = sum(plan.state.pop.values()) / len(plan.members)
    return max(abs(population(plan, c) - ideal) for c in plan.members)
