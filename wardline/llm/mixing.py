"""Mixing sources to target weights by min-cost flow over membership patterns. [DataFrame functions; where sources overlap, the flow runs on pattern totals]"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, own_prefix, repeated

#: Patterns of overlapping sources that are gathered on the driver, at most; more raise an error rather than being cut.
#: Also the rows up to which a table of patterns or sources is broadcast; beyond, it is joined by exchange.
MAX_PATTERNS = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) with ``target``: water filling, ``share`` times all sizes by weight, none above ``most`` times its size.

    Sources in code-point order, null last, weigh ``weights`` in turn. What a stopped source leaves is shared again by
    weight until none is above: the level rises from pass to pass over the sources' table, in a few passes, as every one
    stops a source at least. Sources of size 0 get 0. Places in the order are counted by ranges, so no task sees all sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "sources")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int"))
    rows = ranged.join(F.broadcast(parts.select("part", before.alias("before"))), "part")  # a row per range
    rows = rows.select("source", "source_size", weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    rows = materialise(rows, "weighed")
    total, weight = rows.agg(share * F.sum("source_size").cast("double"), F.sum("w")).first()
    stop, level = -1, 0.0
    while total is not None:
        under = F.col("cap") / F.col("w") < F.lit(level)
        n, used, gone = rows.agg(F.count_if(under), F.sum(F.when(under, F.col("cap"))), F.sum(F.when(under, F.col("w")))).first()
        if n == stop:
            break
        stop = n
        if weight - (gone or 0.0) <= 0:
            level = float("inf")
            break
        level = (total - (used or 0.0)) / (weight - (gone or 0.0))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def min_cost_flow(capacity: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Tokens that each pattern sends to each source: flow[pattern][source].

    The network: start -> pattern (one arc per repetition, each of the pattern's capacity, repetition r
    costs r: convex) -> its sources -> end (quota). Successive shortest paths; path costs only rise, so
    cheap first copies are used up before second ones. It meets all quotas that the network can carry.
    """
    n_p, n_s = len(capacity), len(quota)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, cap: int, c: int) -> int:
        for x, y, k, d in ((a, b, cap, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(k)
            cost.append(d)
        return len(to) - 2

    links = []
    for p in range(n_p):
        for r in range(repeats):
            arc(start, p, capacity[p], r)
        links.append({s: arc(p, n_p + s, repeats * capacity[p], 0) for s in member[p]})
    for s in range(n_s):
        arc(n_p + s, end, quota[s], 0)
    while True:
        far = [None] * len(graph)
        via = [-1] * len(graph)
        far[start], queue, queued = 0, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                if room[e] > 0 and (far[to[e]] is None or far[a] + cost[e] < far[to[e]]):
                    far[to[e]], via[to[e]] = far[a] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if far[end] is None:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [{s: room[e ^ 1] for s, e in own.items() if room[e ^ 1]} for own in links]


def route(capacity: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """min_cost_flow() over each connected part of the network by itself.

    Parts share no arc but those at start and end, which are a pattern's or a source's own, so their optima add
    up to the whole network's; a path search then walks one part only, and sources without overlap cost next to nothing.
    """
    above = list(range(len(quota)))

    def root(s: int) -> int:
        while above[s] != s:
            above[s] = s = above[above[s]]
        return s

    for own in member:
        for s in own[1:]:
            above[root(s)] = root(own[0])
    parts = defaultdict(list)
    for p, own in enumerate(member):
        if own:
            parts[root(own[0])].append(p)
    out: list[dict[int, int]] = [{} for _ in capacity]
    for part in parts.values():
        used = sorted({s for p in part for s in member[p]})
        at = {s: i for i, s in enumerate(used)}
        flow = min_cost_flow([capacity[p] for p in part], [[at[s] for s in member[p]] for p in part], [quota[s] for s in used], repeats)
        for p, sent in zip(part, flow):
            out[p] = {used[i]: n for i, n in sent.items()}
    return out


def seeded_order(seed: int, *cols: Column) -> Column:
    """A fixed pseudo-random order: md5 of the seed and the columns' text, as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with what is planned for their pattern: a broadcast where there are few patterns, else a join that may be split."""
    return rows.join(F.broadcast(plan) if few else plan, "pattern")


def select_tokens(rows: DataFrame, wanted: DataFrame, seed: int, few: bool) -> DataFrame:
    """(doc_id, pattern, size, rows, base, extra) of ``rows`` (doc_id, pattern, size): ``rows`` of them are alike,
    each is taken ``base`` times, and ``extra`` of them once more.

    ``wanted``: (pattern, tokens, total), the tokens that each pattern sends on, and its size. Every document of a pattern is taken
    tokens // total times; the rest goes to documents in seeded order until it is met as nearly as whole
    documents allow. The place where the order stops is found by adding up bins of the order's leading
    digits, twice, so no pattern is ever sorted as a whole: only one in 16 million of its documents are.
    """
    keyed = rows.groupBy("doc_id", "pattern", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("u", seeded_order(seed, F.col("doc_id"), F.col("size")))
    for i in (0, 1):
        keyed = keyed.withColumn(f"bin{i}", F.conv(F.substring("u", 1 + 3 * i, 3), 16, 10).cast("int"))
    some = F.col("total") > 0
    plan = wanted.select("pattern", F.when(some, F.expr("tokens div total")).otherwise(0).alias("base"), F.when(some, F.col("tokens") % F.col("total")).otherwise(0).alias("rest"))
    tokens = F.sum(F.col("size") * F.col("rows")).alias("n")

    def stop(bins: DataFrame, i: int) -> DataFrame:
        """Per pattern the bin in which the order stops, and what lies before it: 4,096 bins at most are put in order."""
        at = F.col("start") + F.sum("n").over(Window.partitionBy("pattern").orderBy(f"bin{i}")) - F.col("n")
        found = bins.withColumn("at", at).where("0 < rest and at <= rest and rest < at + n")
        return materialise(found.select("pattern", F.col(f"bin{i}").alias(f"end{i}"), F.col("at").alias(f"at{i}")), "stops")

    zero = F.lit(0).cast("long")
    first = stop(keyed.groupBy("pattern", "bin0").agg(tokens).join(plan, "pattern").withColumn("start", zero), 0)
    inner = _with_plan(keyed, first, few).where("bin0 = end0").groupBy("pattern", "bin1", "at0").agg(tokens)
    second = stop(inner.join(plan, "pattern").withColumn("start", F.col("at0")), 1)
    plan = plan.join(first.drop("at0"), "pattern", "left").join(second, "pattern", "left")
    plan = plan.select("pattern", "base", "rest", F.coalesce("end0", F.lit(-1)).alias("end0"), F.coalesce("end1", F.lit(-1)).alias("end1"), F.coalesce("at1", zero).alias("before"))
    placed = _with_plan(keyed, plan, few)
    edge = (F.col("bin0") == F.col("end0")) & (F.col("bin1") == F.col("end1"))
    early = (F.col("bin0") < F.col("end0")) | ((F.col("bin0") == F.col("end0")) & (F.col("bin1") < F.col("end1")))
    clear = placed.where(~edge).withColumn("extra", F.when(early, F.col("rows")).otherwise(F.lit(0).cast("long")))
    w = Window.partitionBy("pattern").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("before") + F.sum(F.col("size") * F.col("rows")).over(w) - F.col("size") * F.col("rows")
    # the k-th of equal rows (from 0) begins at ``at`` + k sizes and is taken where its middle is within the rest
    fit = F.floor((F.col("rest") - at - F.col("size") / 2) / F.nullif(F.col("size"), F.lit(0))) + 1
    fit = F.when(F.col("size") == 0, F.when(at <= F.col("rest"), F.col("rows")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("rows"), fit)))
    rest = placed.where(edge).withColumn("extra", fit.cast("long"))
    return clear.unionByName(rest).select("doc_id", "pattern", "size", "rows", "base", "extra")


def _overlapping(patterns: DataFrame, per: DataFrame, shared: DataFrame, repeats: int) -> tuple[DataFrame, DataFrame]:
    """(pattern, tokens) and (source, flow) of the parts of the network whose sources overlap: these run through the flow on the driver."""
    key = told(F.col("source"))
    mine = patterns.select("pattern", "members", "n", F.explode("members").alias("source")).join(shared.select(key.alias("k")), key == F.col("k"), "left_semi")
    found = mine.select("pattern", "members", "n").distinct().limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of sources that overlap; merge small sources first")
    found.sort(key=lambda r: [(x is None, (x or "").encode()) for x in r.members])
    quota = {r.source: r.quota for r in per.join(shared.select(key.alias("k")), key == F.col("k"), "left_semi").select("source", F.round("target").cast("long").alias("quota")).collect()}
    names = sorted(quota, key=lambda x: (x is None, (x or "").encode()))
    at = {x: i for i, x in enumerate(names)}
    flow = route([r.n for r in found], [[at[x] for x in r.members] for r in found], [quota[x] for x in names], repeats)
    spark, got = patterns.sparkSession, Counter()
    for f in flow:
        got.update(f)
    tokens = spark.createDataFrame([(r.pattern, sum(f.values())) for r, f in zip(found, flow)], "pattern long, tokens long")
    return tokens, spark.createDataFrame([(x, got[i]) for x, i in at.items()], "source string, flow long")


def told(c: Column) -> Column:
    """A value as text that tells null from everything else, for joins."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def mix(docs: DataFrame, sources: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Choose how often each document is taken so that sources come near their targets.

    ``sources``: array column of the sources that a document belongs to (one or several; null entries
    are a source of their own). Returns (per kind of document: doc_id, pattern, size, rows, base, extra, members,
    where ``rows`` documents are alike, each is taken ``base`` times and ``extra`` of them once more; per source: source,
    source_size, target, flow). Sources in code-point order, null last, weigh ``weights`` in turn and
    share ``share`` times all sizes; none gets more than ``repeats`` times its size. A document counts
    to each source it belongs to, and is taken at most ``repeats`` times. Documents without words are
    taken as often as the rest of their pattern at least is. Same input and seed: same choice, however
    rows are partitioned. A document without sources (null or empty array) forms a pattern that no source draws on.

    A source that overlaps with none is one arc of the network by itself: its flow is its target, and nothing of
    it reaches the driver. Only patterns of sources that share documents do, MAX_PATTERNS at most.
    """
    members = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    rows = materialise(docs.select("doc_id", members.alias("members"), word_count(F.col("text")).alias("size")), "sizes")
    name = F.coalesce(F.to_json("members", {"ignoreNullFields": "false"}), F.lit(""))
    patterns = rows.groupBy("members").agg(F.sum("size").alias("n")).withColumn("pattern", F.monotonically_increasing_id())
    patterns = materialise(patterns, "patterns")
    few = patterns.count() <= MAX_PATTERNS
    each = patterns.select("pattern", "n", F.size("members").alias("k"), F.explode("members").alias("source"))
    per = materialise(source_targets(each.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, repeats), "targets")
    shared = materialise(each.where("k > 1").select("source").distinct(), "shared")
    alone = each.where("k = 1").withColumn("own", told(F.col("source")))
    alone = alone.join(shared.select(told(F.col("source")).alias("own")), "own", "left_anti")
    aim = per.select(told(F.col("source")).alias("own"), F.round("target").cast("long").alias("tokens"))
    tokens = alone.join(aim, "own").select("pattern", "source", "tokens")
    flow = tokens.select("source", F.col("tokens").alias("flow"))
    tokens = tokens.select("pattern", "tokens")
    if not shared.isEmpty():
        more, got = _overlapping(patterns, per, shared, repeats)
        tokens, flow = tokens.union(more), flow.union(got)
    wanted = patterns.join(tokens, "pattern", "left").select("pattern", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.col("n").alias("total"))
    names = patterns.select(name.alias("m"), "pattern")
    named = rows.withColumn("m", name).join(F.broadcast(names) if few else names, "m").select("doc_id", "pattern", "size")
    chosen = select_tokens(named, materialise(wanted, "wanted"), seed, few)
    flow = flow.select(told(F.col("source")).alias("own"), "flow")
    per = per.withColumn("own", told(F.col("source"))).join(flow, "own").drop("own")
    return _with_plan(chosen, patterns.select("pattern", "members"), few), per.select("source", "source_size", "target", "flow")


def _by_source(docs: DataFrame, seed: int) -> DataFrame:
    chosen, per = mix(docs, F.array("source"), seed=seed)
    per = materialise(per, "per-source")
    per = F.broadcast(per) if per.count() <= MAX_PATTERNS else per
    own = per.withColumn("own", told(F.col("source")))
    return chosen.withColumn("own", told(F.col("members")[0])).join(own, "own").drop("own", "members")


def mix_by_source(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken: mixing where each document has the one source it names.

    One row per input row: repeated rows are documents of their own. Null texts have size 0, a null source is
    a source; an empty table gives no rows, a source without words a target of 0. Extra columns are not read.
    """
    each = repeated(_by_source(docs, seed), F.col("rows"), "nth")
    reps = F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * reps).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: every document with all its columns, as many times as it is taken, twice at most.

    Of rows that share doc_id, size and source and of which only some are taken once more, those whose text
    comes first are: one such group per source at most. An empty table gives no rows; nulls as in mix_by_source.
    """
    columns, own = docs.columns, own_prefix(docs.columns)
    names = [f"{own}{c}" for c in ("id", "size", "source")]
    base, extra, some_of, nth = (f"{own}{c}" for c in ("base", "extra", "some", "nth"))
    chosen = _by_source(docs, seed).select(
        told(F.col("doc_id")).alias(names[0]), F.col("size").alias(names[1]), told(F.col("source")).alias(names[2]),
        (F.col("base") + (F.col("extra") == F.col("rows")).cast("long")).alias(base),
        F.when(F.col("extra") < F.col("rows"), F.col("extra")).otherwise(0).alias(extra),
    )
    chosen = chosen.where(f"{base} > 0 or {extra} > 0")
    rows = docs.withColumns(dict(zip(names, (told(F.col("doc_id")), word_count(F.col("text")), told(F.col("source")))))).join(chosen, names)
    whole = rows.where(F.col(extra) == 0).withColumn(nth, F.lit(1))
    some = rows.where(F.col(extra) > 0).withColumn(nth, F.row_number().over(Window.partitionBy(*names).orderBy("text")))
    reps = F.col(base) + (F.col(nth) <= F.col(extra)).cast("long")
    return repeated(whole.unionByName(some).withColumn(some_of, reps), F.col(some_of), f"{own}copy").select(*[F.col(f"`{c}`") for c in columns])
