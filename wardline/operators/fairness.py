"""Fairness of district plans, from long votes (district, party, votes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import party_ordinal

_BY = "district"


def district_votes(votes: DataFrame, parties: list[str]) -> DataFrame:
    """[G31] One row per district, one column per party."""
    return votes.groupBy(_BY).pivot("party", parties).agg(F.sum("votes")).fillna(0, parties)


def mock_election(votes: DataFrame) -> DataFrame:
    """[A27] (party, seats, share): seats by most votes, of equal parties the later one; statewide vote shares."""
    v = votes.groupBy(_BY, "party").agg(F.sum("votes").alias("votes"))
    won = v.groupBy(_BY).agg(F.max_by("party", F.struct("votes", party_ordinal(F.col("party")))).alias("party"))
    seats = won.groupBy("party").agg(F.count(F.lit(1)).alias("seats"))
    totals = v.groupBy("party").agg(F.sum("votes").alias("n"))
    whole = totals.agg(F.sum("n").alias("all"))
    return totals.join(seats, "party", "left").join(F.broadcast(whole)).select("party", F.coalesce("seats", F.lit(0)).alias("seats"), F.try_divide(F.col("n").cast("double"), "all").alias("share"))


def efficiency_gap(votes: DataFrame) -> DataFrame:
    """[A25] One row, gap: twice the largest party's wasted votes less all wasted, over all votes.

    A winner wastes what exceeds the runner-up (rounded up), everyone else all votes; parties that tie for
    the first place each count as winners.
    """
    v = votes.groupBy(_BY, "party").agg(F.sum("votes").alias("votes"))
    top = v.groupBy(_BY).agg(F.sort_array(F.collect_list("votes"), asc=False).alias("s"))  # one value per party
    top = top.select(_BY, F.col("s")[0].alias("first"), F.coalesce(F.get("s", F.lit(1)), F.lit(0)).alias("second"))
    wasted = F.when(F.col("votes") == F.col("first"), F.col("votes") - F.ceil("second")).otherwise(F.col("votes"))
    by_party = v.join(top, _BY).groupBy("party").agg(F.sum(wasted).alias("w"), F.sum("votes").alias("n"))
    return by_party.agg(F.try_divide(F.abs(2 * F.max("w") - F.sum("w")).cast("double"), F.sum("n")).alias("gap"))


def declination(votes: DataFrame) -> DataFrame:
    """[A26] One row: n_rep, n_dem, declination, in units of a right angle; null where one side wins all.

    Districts by dem share of the two parties' votes, split at one half; tied districts (share of exactly one
    half) belong to neither side, and lengthen both by half a district.
    """
    of = lambda p: F.sum(F.when(F.col("party") == p, F.col("votes")).otherwise(0))
    s = votes.groupBy(_BY).agg(of("dem").alias("dem"), of("rep").alias("rep")).select(F.try_divide(F.col("dem").cast("double"), F.col("dem") + F.col("rep")).alias("s"))
    sides = s.agg(
        F.count_if(F.expr("s < 0.5")).alias("n_rep"),
        F.count_if(F.expr("s > 0.5")).alias("n_dem"),
        F.avg(F.when(F.col("s") < 0.5, F.col("s"))).alias("low"),
        F.avg(F.when(F.col("s") > 0.5, F.col("s"))).alias("high"),
        F.when(F.count_if(F.expr("s = 0.5")) > 0, 0.5).otherwise(0.0).alias("tie"),
    )
    rep = F.atan((0.5 - F.col("low")) / (F.nullif(F.col("n_rep"), F.lit(0)) / 2 + F.col("tie")))
    dem = F.atan((F.col("high") - 0.5) / (F.nullif(F.col("n_dem"), F.lit(0)) / 2 + F.col("tie")))
    return sides.select("n_rep", "n_dem", (2 * (rep - dem) / F.pi()).alias("declination"))


def _steps(votes: DataFrame, by: str = _BY) -> DataFrame:
    """(x, k, n): places where the seats curve steps up, districts by dem share descending. One row per district."""
    s = votes.groupBy(by).agg(F.sum(F.when(F.col("party") == "dem", F.col("votes")).otherwise(0)).alias("dem"), F.sum("votes").alias("all"))
    s = s.select(by, (1 - F.try_divide(F.col("dem").cast("double"), F.col("all"))).alias("x")).where("x is not null")
    return s.select("x", F.row_number().over(Window.orderBy("x", by)).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def votes_to_seats_curve(votes: DataFrame) -> DataFrame:
    """[W1, R8] (x, y): the step curve's corner points, from (0, 0) to (1, 1)."""
    at = lambda k: F.struct(F.col("x"), (k / F.col("n")).alias("y"))
    steps = _steps(votes).select(F.explode(F.array(at(F.col("k") - 1), at(F.col("k")))).alias("p")).select("p.x", "p.y")
    ends = votes.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    return ends.union(steps)


def votes_to_seats_area(votes: DataFrame) -> DataFrame:
    """[W2] One row, area: integral of |F(x) - x| between the step curve and the diagonal."""
    s = _steps(votes)
    s = s.select("x", "k", "n", F.lead("x", 1, 1.0).over(Window.orderBy("k")).alias("end"))
    h = F.col("k") / F.col("n")
    half = lambda a, b: F.pow(b - a, 2) / 2
    piece = F.when(h <= F.col("x"), half(h, F.col("end")) - half(h, F.col("x"))).when(h >= F.col("end"), half(F.col("x"), h) - half(F.col("end"), h)).otherwise(half(F.col("x"), h) + half(h, F.col("end")))
    return s.agg((F.sum(piece) + F.pow(F.min("x"), 2) / 2).alias("area"))


def quantification(overlaps: DataFrame, members: DataFrame, votes: DataFrame) -> DataFrame:
    """[A30] (district_id, community_id, absolute, rep_share): a district held against the community it shares most people with.

    ``overlaps``: id, mask_id (district), ratio. ``members``: id, community_id, pop. ``votes``: id, party,
    votes. absolute: share of the community's people outside the district; rep_share: the rep share of the
    two large parties' votes out there, one half without votes.
    """
    o = overlaps.select("id", F.col("mask_id").alias("district_id"), "ratio")
    inside = o.join(members, "id").groupBy("district_id", "community_id").agg(F.sum(F.col("pop") * F.col("ratio")).alias("pop"))
    w = Window.partitionBy("district_id").orderBy(F.desc("pop"), "community_id")
    best = inside.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    people = members.groupBy("community_id").agg(F.sum("pop").alias("all"))
    two = votes.where("party in ('dem', 'rep')")
    total = two.join(members.select("id", "community_id"), "id").groupBy("community_id", "party").agg(F.sum("votes").alias("v"))
    held = o.join(members.select("id", "community_id"), "id").join(two, "id").groupBy("district_id", "community_id", "party").agg(F.sum(F.col("votes") * F.col("ratio")).alias("h"))
    rest = best.select("district_id", "community_id").join(total, "community_id").join(held, ["district_id", "community_id", "party"], "left")
    rest = rest.withColumn("out", F.col("v") - F.coalesce("h", F.lit(0.0))).groupBy("district_id").agg(F.sum(F.when(F.col("party") == "rep", F.col("out")).otherwise(0)).alias("rep"), F.sum("out").alias("two"))
    out = best.join(people, "community_id").join(rest, "district_id", "left")
    return out.select("district_id", "community_id", F.coalesce(F.try_divide(F.col("all") - F.col("pop"), F.col("all")), F.lit(0.0)).alias("absolute"), F.coalesce(F.try_divide(F.col("rep"), F.col("two")), F.lit(0.5)).alias("rep_share"))
