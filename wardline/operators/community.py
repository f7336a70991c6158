"""Measures of communities, as aggregates over assignment and precincts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PrecinctNotInGroup
from ..functions import stats
from ..functions.votes import community_lean, share


def measure(members: DataFrame, *columns: Column, by: str = "community_id") -> DataFrame:
    """[U1, U2, U3, U7, G19, G32] Any aggregates per community; a measure is a Column over its precincts."""
    return members.groupBy(by).agg(*columns)


def population(members: DataFrame, by: str = "community_id") -> DataFrame:
    """[A6, A7, A17] Population per group."""
    return measure(members, F.sum("pop").alias("pop"), by=by)


def total_population(members: DataFrame) -> DataFrame:
    """[A8]"""
    return members.agg(F.sum("pop").alias("pop"))


def population_deviation(members: DataFrame, by: str = "community_id") -> DataFrame:
    """[A18] Population standard deviation of precinct populations per group."""
    return measure(members, stats.deviation(F.col("pop")).alias("stdev"), by=by)


def within_tolerance(populations: DataFrame, percent: float) -> DataFrame:
    """One row: whether every population is within half of ``percent`` of the mean."""
    mean = populations.agg(F.avg("pop").alias("ideal"))
    off = F.abs(F.col("pop") - F.col("ideal")) / F.nullif(F.col("ideal"), F.lit(0))
    return populations.join(F.broadcast(mean)).agg(F.bool_and(off <= percent / 200).alias("complete"))


def worst(populations: DataFrame, by: str = "community_id") -> DataFrame:
    """[O4] One row: the group furthest from the mean; ties to the smaller id."""
    mean = populations.agg(F.avg("pop").alias("ideal"))
    off = F.abs(F.col("pop") - F.col("ideal"))
    return populations.join(F.broadcast(mean)).agg(F.max_by(by, F.struct(off, -F.col(by))).alias(by), F.max(off).alias("off"))


def worst_by(measures: DataFrame, column: str, by: str = "community_id") -> DataFrame:
    """[O5] One row: the group with the largest measure."""
    return measures.agg(F.max_by(by, F.struct(column, -F.col(by))).alias(by), F.max(column).alias(column))


def distance_from_population(populations: DataFrame, threshold: float = 0.99) -> DataFrame:
    """[A13] One row: mean over groups of 1 - |1 - pop / ideal|, counted as 1 from ``threshold`` on; ideal is a whole number."""
    total = populations.agg(F.expr("cast(sum(pop) as bigint) div count(*)").alias("ideal"))
    r = 1 - F.abs(1 - F.try_divide(F.col("pop").cast("double"), F.col("ideal")))
    return populations.join(F.broadcast(total)).agg(F.avg(F.when(r >= threshold, 1.0).otherwise(r)).alias("closeness"))


def partisanship_deviation(votes: DataFrame, by: str = "community_id") -> DataFrame:
    """[A14] Mean over parties (without totals) of the deviation of raw counts per precinct; negative counts are missing."""
    each = votes.where("party <> 'total' and votes >= 0").groupBy(by, "party").agg(stats.deviation(F.col("votes")).alias("d"))
    return each.groupBy(by).agg(F.avg("d").alias("stdev"))


def share_deviation(votes: DataFrame, by: str = "community_id") -> DataFrame:
    """[A15] As above, of shares; ``votes`` has votes and total per precinct and party."""
    each = votes.groupBy(by, "party").agg(stats.deviation(share(F.col("votes"), F.col("total"))).alias("d"))
    return each.groupBy(by).agg(F.avg("d").alias("stdev"))


def party_means(votes: DataFrame, by: str = "community_id") -> DataFrame:
    """[A16] (by, party, mean): unweighted mean of precinct shares."""
    return votes.groupBy(by, "party").agg(F.avg(share(F.col("votes"), F.col("total"))).alias("mean"))


def leans(votes: DataFrame, by: str = "community_id") -> DataFrame:
    """[A19] (by, lean) from long votes."""
    of = lambda p: F.sum(F.when(F.col("party") == p, F.col("votes")).otherwise(0))
    return votes.groupBy(by).agg(of("rep").alias("rep"), of("dem").alias("dem")).select(by, community_lean(F.col("rep"), F.col("dem")).alias("lean"))


def areas(members: DataFrame, by: str = "community_id") -> DataFrame:
    """[A11, A12]"""
    return measure(members, F.sum(F.abs("area")).alias("area"), by=by)


def centroids(members: DataFrame, by: str = "community_id", whole: bool = False) -> DataFrame:
    """[A20, A21, A22] Unweighted mean of centroids; ``whole``: in whole numbers, truncated."""
    mean = (lambda c: F.expr(f"cast(sum({c}) as bigint) div count({c})")) if whole else F.avg
    return measure(members, mean("cx").alias("cx"), mean("cy").alias("cy"), by=by)


def boxes(members: DataFrame, by: str = "community_id") -> DataFrame:
    """[A23] Bounding boxes of groups."""
    return measure(members, F.max("ymax").alias("ymax"), F.min("ymin").alias("ymin"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), by=by)


def quick_compactness(members: DataFrame, by: str = "community_id") -> DataFrame:
    """[M18, M19] Area over that of the circle about the mean centroid that reaches the furthest precinct centroid."""
    c = centroids(members, by).withColumnsRenamed({"cx": "mx", "cy": "my"})
    d2 = F.pow(F.col("cx") - F.col("mx"), 2) + F.pow(F.col("cy") - F.col("my"), 2)
    return members.join(c, by).groupBy(by).agg(F.try_divide(F.sum(F.abs("area")), F.pi() * F.max(d2)).alias("compactness"))


def scalarized(compactness: DataFrame, populations: DataFrame) -> DataFrame:
    """[A29] One row: mean of average compactness and closeness of populations."""
    a, b = compactness.agg(F.avg("compactness").alias("c")), distance_from_population(populations)
    return a.join(b).select(((F.col("c") + F.col("closeness")) / 2).alias("metric"))


def party_totals(votes: DataFrame) -> DataFrame:
    """[A31] (party, votes)"""
    return votes.groupBy("party").agg(F.sum("votes").alias("votes"))


def with_precinct(assignment: DataFrame, node: int, community: int) -> DataFrame:
    """[G20] The assignment with a precinct in a community, wherever it was before."""
    kinds = assignment.schema
    own = assignment.sparkSession.range(1).select(F.lit(node).cast(kinds["node_id"].dataType).alias("node_id"), F.lit(community).cast(kinds["community_id"].dataType).alias("community_id"))
    return assignment.where(F.col("node_id") != node).select("node_id", "community_id").union(own)


def without_precinct(assignment: DataFrame, node: int, community: int) -> DataFrame:
    """[G20, G33] The assignment without a precinct of a community; raises where the community does not hold it."""
    held = (F.col("node_id") == node) & (F.col("community_id") == community)
    if assignment.where(held).isEmpty():
        raise PrecinctNotInGroup(f"{node} is not in {community}")
    return assignment.where(~held)


def ordered_parties(means: DataFrame, parties: Sequence[str], by: str = "community_id") -> DataFrame:
    """[G30] (by, ordinal, party, mean): what the listed parties leave of the whole first, as 'other', then the parties as listed.

    ``means``: by, party, mean, as party_means() gives them; a party that a community lacks has 0.
    """
    order = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(p).alias("party")) for i, p in enumerate(parties)])
    wanted = means.select(by).distinct().withColumn("p", F.explode(order)).select(by, "p.ordinal", "p.party")
    listed = wanted.join(means.select(by, "party", "mean"), [by, "party"], "left").select(by, "ordinal", "party", F.coalesce("mean", F.lit(0.0)).alias("mean"))
    rest = listed.groupBy(by).agg(F.lit(0).alias("ordinal"), F.lit("other").alias("party"), (1 - F.sum("mean")).alias("mean"))
    return rest.unionByName(listed)
