"""Sinks: Parquet states, plan texts, GeoJSON and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area


def write_state(df: DataFrame, path: str) -> None:
    """[K1, K2, S10, S11] A relation as Parquet, by state where it has one; ``spark.read.parquet`` loads it."""
    w = df.write.mode("overwrite")
    (w.partitionBy("state") if "state" in df.columns else w).parquet(path)


def plan_text(assignment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """[K3] (by, text): ``[['a', 'b'], ['c']]``, communities and ids in order. A text is one plan: ``by`` names what tells plans
    (states, seeds) apart, and each is put together by itself; without it there is one row for all."""
    inner = assignment.groupBy(*by, "community_id").agg(F.array_sort(F.collect_list(F.col("precinct_id").cast("string"))).alias("ids"))
    one = inner.select(*by, F.struct("community_id", F.concat(F.lit("['"), F.array_join("ids", "', '"), F.lit("']")).alias("t")).alias("c"))
    texts = F.transform(F.array_sort(F.collect_list("c")), lambda c: c.t)
    return one.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")).alias("text"))


def ring_json(ring: Column) -> Column:
    """[K5] ``[[x,y],...]``"""
    return F.to_json(F.transform(ring, lambda p: F.array(p.x, p.y)))


def polygon_coordinates(hull: Column, holes: Column) -> Column:
    """Nested coordinates of a polygon as JSON text."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.concat(F.array(hull), F.coalesce(holes, F.array())), ring_json), ","), F.lit("]"))


def feature(kind: str, coordinates: Column, properties: Column | None = None) -> Column:
    """[K6, K7] A valid GeoJSON feature."""
    props = F.to_json(properties) if properties is not None else F.lit("{}")
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":'), coordinates, F.lit('},"properties":'), props, F.lit("}"))


def polygon_feature(hull: Column, holes: Column, properties: Column | None = None) -> Column:
    """[K6]"""
    return feature("Polygon", polygon_coordinates(hull, holes), properties)


def multipolygon_feature(parts: Column, properties: Column | None = None) -> Column:
    """[K7]"""
    inner = F.array_join(F.transform(parts, lambda p: polygon_coordinates(p.hull, p.holes)), ",")
    return feature("MultiPolygon", F.concat(F.lit("["), inner, F.lit("]")), properties)


def feature_collection(df: DataFrame, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """[K4, K8] (by, text): a collection of one feature per precinct, holes included, ordered by key; ``by`` as in plan_text()."""
    f = df.select(*by, F.struct(F.col(key).alias("k"), polygon_feature(F.col("hull"), F.col("holes"), F.struct(F.col(key))).alias("f")).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.f), ",")
    return f.groupBy(*by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), text, F.lit("]}")).alias("text"))


def quantification_text(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """[K9] (by, text): lines of absolute values, collapsed values and party maps; a tab between districts. ``by`` as in plan_text().

    ``scores``: district_id, absolute, collapsed, parties map<string, double>.
    """
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("parties")), lambda e: F.concat(F.lit('"'), e.key, F.lit('":'), e.value.cast("string"))), ",")
    rows = scores.select(*by, F.struct("district_id", F.col("absolute").cast("string").alias("a"), F.col("collapsed").cast("string").alias("c"), F.concat(F.lit("["), pairs, F.lit("]")).alias("p")).alias("s"))
    line = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s[n]), "\t")
    return rows.groupBy(*by).agg(F.concat_ws("\n", line("a"), line("c"), line("p")).alias("text"))


def append_measures(table: DataFrame, efficiency_gap: Column, declination: Column, votes_to_seats: Column) -> DataFrame:
    """[K10] Three further columns, unless the table has them already."""
    new = {"EFFICENCY_GAP": efficiency_gap, "DECLINATION": declination, "VOTES_TO_SEATS": votes_to_seats}
    return table if set(new) & set(table.columns) else table.withColumns(new)


def summary(precincts: DataFrame, parties: list[str]) -> DataFrame:
    """[K13, K14] One row: precincts, population, area (in units before scaling), votes by party, rows with missing data."""
    gone = F.lit(False)
    for p in parties:
        gone = gone | F.col(p).isNull() | (F.col(p) < 0)
    area = F.sum(polygon_area(F.col("hull"), F.col("holes"))) / float(1 << 36) if "hull" in precincts.columns else F.lit(None).cast("double")
    return precincts.agg(F.count(F.lit(1)).alias("precincts"), F.sum("pop").alias("pop"), area.alias("area"), *[F.sum(p).alias(p) for p in parties], F.count_if(gone).alias("missing"))


def write_text(df: DataFrame, path: str) -> None:
    """[K12] One text column as text files."""
    df.write.mode("overwrite").text(path)
