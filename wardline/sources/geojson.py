"""GeoJSON features as rows of polygon parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import closed, point, scaled, scaled_rounded

_RINGS = "array<array<array<double>>>"


def ring(coordinates: Column, scale: str | None = None) -> Column:
    """A ring from [[x, y], ...], closed; ``scale``: None, 'truncate' or 'round' (times 2^18)."""
    one = {None: lambda c: c, "truncate": scaled, "round": scaled_rounded}[scale]
    return closed(F.transform(coordinates, lambda p: point(one(p[0]), one(p[1]))))


def polygon(rings: Column, scale: str | None = None) -> Column:
    """[S3] struct<hull, holes> from nested coordinates."""
    return F.struct(ring(rings[0], scale).alias("hull"), F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: ring(r, scale)).alias("holes"))


def parts(kind: Column, coordinates: Column, scale: str | None = None) -> Column:
    """[S3, S4, S9] array of polygons from a geometry's type and its coordinates as JSON text; other types raise."""
    one = F.array(polygon(F.from_json(coordinates, _RINGS), scale))
    many = F.transform(F.from_json(coordinates, f"array<{_RINGS}>"), lambda p: polygon(p, scale))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(F.raise_error(F.lit("invalid geojson")))


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of one or many collections: path, feature (position), kind, coordinates (JSON text), properties (map).

    A collection is a file, or, with ``lines``, a line: then large files are read in pieces.
    """
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode("features").alias("feature", "f")).select(
        "path", "feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")
    )


def missing(value: Column) -> Column:
    """Whether a property is absent: null, NA, empty or a single space."""
    return value.isNull() | value.isin("NA", "", " ")


def read_precincts(spark: SparkSession, path: str, keys: dict[str, str], scale: str | None = None, lines: bool = False) -> DataFrame:
    """[S5, S6] One row per polygon part: id, part, n_parts, hull, holes, pop and one column per mapped party.

    Missing values are null. ``keys``: role -> property; roles GEO, POP and parties.
    """
    rows = read_features(spark, path, lines).withColumn("parts", parts(F.col("kind"), F.col("coordinates"), scale))
    values = []
    for role, name in keys.items():
        v = F.col("properties")[name]
        if role == "GEO":
            values.append(v.alias("id"))
        elif role != "ELE":
            values.append(F.when(~missing(v), v.try_cast("double")).alias(role.lower()))
    return rows.select(*values, F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "p")).select("*", "p.hull", "p.holes").drop("p")


def read_districts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """[S7] district_id (position in its collection), part, hull, holes; always scaled. ``lines`` as in read_features()."""
    rows = read_features(spark, path, lines).withColumn("parts", parts(F.col("kind"), F.col("coordinates"), "truncate"))
    return rows.select(F.col("feature").alias("district_id"), F.posexplode("parts").alias("part", "p")).select("district_id", "part", "p.hull", "p.holes")


def read_text(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """[S22] Whole files, or their ``lines``, as (path, text)."""
    return spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def combine_shapes(spark: SparkSession, paths: str, lines: bool = False) -> DataFrame:
    """[S21] (state, collection): single shapes gathered into a FeatureCollection by the prefix of their folder's name.

    A shape is a file, or, with ``lines``, a line that is not blank: many small shapes need no file each.
    """
    rows = read_text(spark, paths, lines).select("path", F.trim("text").alias("shape"))
    rows = rows.where("shape <> ''") if lines else rows
    folder = F.element_at(F.split("path", "/"), -2)
    rows = rows.withColumn("state", F.regexp_extract(folder, r"^([^0-9]*?)_?[0-9]*$", 1))
    shapes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "shape"))), lambda x: x["shape"]), ",")
    return rows.groupBy("state").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), shapes, F.lit("]}")).alias("collection"))
