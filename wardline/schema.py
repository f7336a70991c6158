"""Types of the relations, and the party dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"
RING = f"array<{POINT}>"
POLYGON = f"struct<hull: {RING}, holes: array<{RING}>>"

#: Parties in their order, which decides ties between seats. Fixed values.
PARTIES = ("other", "dem", "rep", "green", "lib", "reform", "ind", "const")
#: Coordinates are scaled by this much and truncated.
SCALE = 1 << 18


def party_ordinal(party: Column) -> Column:
    """Place of a party in the order; unknown names come last."""
    at = F.array_position(F.array(*[F.lit(p) for p in PARTIES]), party)
    return F.when(at > 0, at - 1).otherwise(len(PARTIES)).cast("int")


def parties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PARTIES)), "ordinal int, party string")


def unused(*frames: DataFrame) -> str:
    """A prefix for helper columns that no column of these begins with."""
    return "_" * (1 + max(len(c) for df in frames for c in df.columns))
