"""Random contraction of graphs of any size: rounds over tables of groups and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def communities(nodes: DataFrame, edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """[G13, G14, O7, O8] (state, node_id, community_id): k contiguous communities a state, numbered from 0.

    ``nodes``: state, node_id; ``edges``: src, dst, within states. In every round each group asks for the one next to it
    with which it would make the smallest group, ties by a seeded random key. Groups that ask for each other become one,
    joined by those that asked for one of the two; where that would leave fewer than k, the two only, and of such pairs
    no more than the state has to spare, smallest first. The smallest wish of a state is always mutual, so every round
    contracts, by half or more while there are many groups. With more components than k a state has one community per
    component; no state gets more than it has nodes. States of all sizes go through the same rounds, side by side.
    """
    own = cut(nodes.select("state", F.col("node_id").alias("g")).distinct(), "groups")
    spare = own.groupBy("state").agg((F.count(F.lit(1)) - k).alias("spare"))
    at = own.select("state", F.col("g").alias("a"))
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    one = F.lit(1).cast("long")
    links = cut(pairs.join(at, "a").select("state", "a", "b", one.alias("sa"), one.alias("sb")), "links")
    gone, rounds = None, []
    while True:
        # groups that may still go: what the state had to spare, less those gone
        left = spare if gone is None else spare.join(gone.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", (F.col("spare") - F.coalesce("n", F.lit(0))).alias("spare"))
        wish = F.struct((F.col("sa") + F.col("sb")).alias("size"), F.xxhash64(F.lit(seed), F.lit(len(rounds)), "a", "b").alias("r"), "a", "b").alias("wish")
        ends = F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("sa").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("g"), F.col("sb").alias("own"), F.col("a").alias("other")))).alias("e")
        ask = links.select("state", wish, ends).groupBy("state", "e.g").agg(F.min(F.struct("wish", F.col("e.own").alias("own"), F.col("e.other").alias("other"))).alias("m")).select("state", "g", "m.*")
        ask = cut(ask, "wishes")
        both = ask.groupBy("state", "wish").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("state", "wish")
        paired = ask.join(both, ["state", "wish"]).select("state", "g", "own", F.col("wish.a").alias("to"), "wish", (F.col("g") != F.col("wish.a")).cast("int").alias("goes"))
        paired = cut(paired, "pairs")
        asks = ask.join(paired.select("state", "g"), ["state", "g"], "left_anti")
        asks = asks.join(paired.select("state", F.col("g").alias("other"), "to", F.col("wish").alias("theirs")), ["state", "other"])
        news = paired.withColumn("kind", F.col("goes")).drop("goes").union(asks.select("state", "g", "own", "to", F.col("theirs").alias("wish"), F.lit(2).alias("kind")))
        news = cut(news.join(left.where("spare > 0"), "state"), "news")
        room = news.groupBy("state", "spare").agg(F.count_if(F.col("kind") == 1).alias("pairs"), F.count_if(F.col("kind") > 0).alias("all")).drop("spare")
        news = news.join(room, "state").where("kind < 2 or all <= spare")
        # more pairs than a state can spare: only where fewer than 2k groups are left, so few rows are put in order
        place = F.dense_rank().over(Window.partitionBy("state").orderBy("wish"))
        last = news.where("pairs > spare").withColumn("place", place).where("place <= spare").drop("place")
        news = news.where("pairs <= spare").union(last)
        total = F.sum("own").over(Window.partitionBy("state", "to"))
        news = cut(news.select("state", "g", "to", total.alias("new")), "merges")
        if news.isEmpty():
            break
        done = news.where("g <> to").select("state", "g", "to")
        rounds.append(done)
        gone = done.select("state", "g") if gone is None else gone.union(done.select("state", "g"))
        for end, size in (("a", "sa"), ("b", "sb")):
            links = links.join(news.withColumnRenamed("g", end), ["state", end], "left")
            links = links.withColumns({end: F.coalesce("to", end), size: F.coalesce("new", size)}).drop("to", "new")
        turned = F.col("a") > F.col("b")
        pick = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
        links = links.where("a <> b").select("state", pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("sa", "sb").alias("sa"), pick("sb", "sa").alias("sb"))
        links = cut(links.distinct(), "links")
    # a group's last name, from the last round back to the first: each adds the groups that went in it
    name = own if gone is None else own.join(gone, ["state", "g"], "left_anti")
    order = Window.partitionBy("state").orderBy("g")  # k rows a state, or one a component
    name = cut(name.select("state", "g", (F.row_number().over(order) - 1).cast("int").alias("community_id")), "names")
    for done in reversed(rounds):
        name = name.union(done.join(name.withColumnRenamed("g", "to"), ["state", "to"]).select("state", "g", "community_id"))
        name = cut(name, "names")
    return nodes.select("state", "node_id").join(name.withColumnRenamed("g", "node_id"), ["state", "node_id"])
