"""Plans for many states at once: one group per state and seed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

_OUT = "state {kind}, seed int, node_id long, community_id int, status string"
#: Measures of one community, which count by their mean, and of whole plans.
_MEASURES: dict[str, object] = {n: getattr(kernels, n) for n in ("population", "population_stdev", "partisanship_stdev", "reock", "quick_compactness", "least_compact", "population_range", "efficiency_gap")}


def _state(pdf: pd.DataFrame) -> kernels.State:
    ids = pdf.node_id.tolist()
    has = set(pdf.columns)
    column = lambda c: dict(zip(ids, pdf[c])) if c in has else {}
    held = set(ids)
    out = kernels.State({n: {int(m) for m in near if m in held} for n, near in zip(ids, pdf.near)}, column("pop"), column("area"))
    if {"cx", "cy"} <= has:
        out.centre = {n: (x, y) for n, x, y in zip(ids, pdf.cx, pdf.cy)}
    if "hull" in has:
        out.vertices = {n: np.array([(p["x"], p["y"]) for p in h], float) for n, h in zip(ids, pdf.hull)}
    if "shares" in has:
        out.shares = {n: tuple(s) for n, s in zip(ids, pdf.shares)}
    if "votes" in has:
        out.votes = {n: tuple(v) for n, v in zip(ids, pdf.votes)}
    return out


def with_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``near``, their neighbours' ids: degrees of contiguity graphs are small."""
    near = edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("near"))
    return nodes.join(near, "node_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))


def _per_state(nodes: DataFrame, seeds: list[int], work: Callable[[kernels.State, pd.DataFrame, int], tuple[dict[int, int], str]]) -> DataFrame:
    kind = nodes.schema["state"].dataType.simpleString()
    # few rows make long work: a fixed number of partitions is not coalesced by their size
    spark = nodes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    many = nodes.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).repartition(n, "state", "seed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        seed = int(pdf.seed.iloc[0])
        of, status = work(_state(pdf), pdf, seed)
        return pd.DataFrame({"state": pdf.state.iloc[0], "seed": seed, "node_id": list(of), "community_id": list(of.values()), "status": status})

    return many.groupBy("state", "seed").applyInPandas(run, _OUT.format(kind=kind))


def initial_plans(nodes: DataFrame, k: int, seeds: list[int] = [0]) -> DataFrame:  # noqa: B006
    """[G13, G14] (state, seed, node_id, community_id, status): contiguous partitions into k by random contraction.

    ``nodes``: state, node_id, near. One state is one task, as in every refinement: moves depend on each
    other; states and seeds run side by side. ``contraction.communities`` does graphs that are larger than one task.
    """
    return _per_state(nodes, seeds, lambda state, _, seed: (kernels.random_contraction(state, k, seed), "contracted"))


def refine(nodes: DataFrame, method: str, measure: str = "quick_compactness", seeds: list[int] = [0], **options) -> DataFrame:  # noqa: B006
    """[G21-G26, U2] Refined plans and how each ended; ``nodes`` also has community_id and what the measure reads.

    ``method``: steepest, anneal, compactness, population or spread; ``measure`` names one of the kernels, of single
    communities or (least_compact, population_range, efficiency_gap) of the plan. efficiency_gap reads ``votes``, an array by party.
    """
    fn = _MEASURES[measure]

    def work(state: kernels.State, pdf: pd.DataFrame, seed: int) -> tuple[dict[int, int], str]:
        plan, status = kernels.Plan(state, {n: int(c) for n, c in zip(pdf.node_id, pdf.community_id)}), "no better exchange"
        if method == "steepest":
            plan = kernels.steepest(plan, fn, **options)
        elif method == "anneal":
            plan, status = kernels.anneal(plan, fn, seed, **options), "cooled"
        elif method == "compactness":
            plan, status = kernels.improve_compactness(plan, **options), kernels.TIRED
        elif method == "population":
            plan = kernels.improve_population(plan, seed=seed, **options)
            status = plan.status
        elif method == "spread":
            plan = kernels.improve_spread(plan, fn, **options)
        else:
            raise ValueError(f"unknown method: {method}")
        return plan.of, "rounds over" if options.get("rounds") is not None and method in ("steepest", "spread") else status

    return _per_state(nodes, seeds, work)


def generate_communities(nodes: DataFrame, k: int, seeds: list[int] = [0], rounds: int = 30, percent: float = 1.0, patience: int | None = None) -> DataFrame:  # noqa: B006
    """[G27] Plans from scratch: contraction, then rounds of compactness and population refinement; ``status`` is that of the last balancing."""

    def work(state: kernels.State, _: pd.DataFrame, seed: int) -> tuple[dict[int, int], str]:
        plan = kernels.generate(state, k, seed, rounds, percent, patience)
        return plan.of, plan.status

    return _per_state(nodes, seeds, work)
