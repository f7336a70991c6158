"""What can be told of refined plans without the kernels that made them: all exchanges tried, each as a plan of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import community, graph
from .session import cut

#: (x, score) of plans from their members (x, own and what is measured); more is better.
Score = Callable[[DataFrame], DataFrame]


def by_parts(part: Callable[[DataFrame], DataFrame], whole) -> Score:
    """A score from ``part``, (own, m) per community, and an aggregate of m."""
    return lambda members: members.select("x", "own").distinct().join(part(members), "own").groupBy("x").agg(whole(F.col("m")).alias("score"))


def compactness(members: DataFrame) -> DataFrame:
    return community.quick_compactness(members, by="own").select("own", F.coalesce("compactness", F.lit(0.0)).alias("m"))


def population_stdev(members: DataFrame) -> DataFrame:
    return community.population_deviation(members, by="own").select("own", F.col("stdev").alias("m"))


def efficiency_gap(members: DataFrame) -> DataFrame:
    """The gap of each plan, negative. ``members``: x, own, votes."""
    v = members.select("x", "own", F.posexplode("votes").alias("party", "v")).groupBy("x", "own", "party").agg(F.sum("v").alias("v"))
    top = v.groupBy("x", "own").agg(F.sort_array(F.collect_list("v"), asc=False).alias("s"))  # one value per party
    w = v.join(top, ["x", "own"]).withColumn("w", F.when(F.col("v") == F.col("s")[0], F.col("v") - F.col("s")[1]).otherwise(F.col("v")))
    w = w.groupBy("x", "party").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    return w.groupBy("x").agg((-F.coalesce(F.try_divide(F.abs(2 * F.max("w") - F.sum("w")), F.sum("v")), F.lit(0.0))).alias("score"))


def open_exchanges(nodes: DataFrame, edges: DataFrame, plan: DataFrame, score: Score) -> DataFrame:
    """(state, open, score): how many of all possible exchanges would raise a plan's score, and that score."""
    plan = plan.select("state", "node_id", "community_id")
    found = graph.exchanges(edges, plan.select("node_id", "community_id")).select(F.col("node_id").alias("moved"), "other")
    found = found.join(plan.select("state", F.col("node_id").alias("moved")), "moved")
    found = found.union(plan.select(F.lit(None).cast("long").alias("moved"), F.lit(-1).alias("other"), "state").distinct())
    found = found.withColumn("x", F.concat_ws(":", "state", F.coalesce(F.col("moved").cast("string"), F.lit("-")), "other"))
    trial = found.join(plan, "state").withColumn("community_id", F.when(F.col("node_id") == F.col("moved"), F.col("other")).otherwise(F.col("community_id")))
    trial = trial.withColumn("own", F.concat_ws("/", "x", "community_id")).withColumn("at", F.concat_ws("/", "x", "node_id"))
    trial = cut(trial.select("state", "moved", "x", "node_id", "own", "at"), "trials")
    ends = lambda n: trial.select("x", F.col("node_id").alias(n), F.col("own").alias(f"{n}_own"), F.col("at").alias(f"{n}_at"))
    inner = edges.join(ends("src"), "src").join(ends("dst"), ["x", "dst"]).where("src_own = dst_own").select(F.col("src_at").alias("src"), F.col("dst_at").alias("dst"))
    parts = graph.components(trial.select(F.col("at").alias("id")), inner).join(trial.select(F.col("at").alias("id"), "x"), "id")
    parts = parts.groupBy("x").agg(F.count_distinct("component").alias("pieces"))
    kept = trial.groupBy("x").agg(F.count_distinct("own").alias("n"))
    rows = trial.select("state", "moved", "x").distinct().join(parts, "x").join(kept, "x").join(score(trial.join(nodes.drop("state", "community_id"), "node_id")), "x")
    base = rows.where("moved is null").select("state", F.col("score").alias("before"), F.col("n").alias("whole"))
    better = (F.col("pieces") == F.col("whole")) & (F.col("n") == F.col("whole")) & (F.col("score") > F.col("before") + 1e-9)
    return rows.where("moved is not null").join(base, "state", "right").groupBy("state").agg(F.count_if(better).alias("open"), F.first("before").alias("score"))
