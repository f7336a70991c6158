"""Election tables of all states in one scan a format, told apart by file and read under each state's own column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_number, split
from .geojson import missing, read_features

#: Keys of a state's metadata and the party whose column each names. Fixed values.
PARTY_KEYS = {
    "dem_keys": "dem", "rep_keys": "rep", "total_keys": "total", "other_keys": "other", "green_keys": "green",
    "libertarian_keys": "lib", "reform_keys": "reform", "independent_keys": "ind", "constitution_keys": "const",
}
_STATE = "struct<party_data: map<string, array<string>>, ele_id: string, geo_id: string, pop_key: string, non_precinct_ids: array<string>>"


def _names(value: Column) -> Column:
    """One column name or a JSON list of them, as an array; none where absent."""
    many = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(many)


def role_map(spark: SparkSession, path: str) -> DataFrame:
    """[S18] (state, ids, geo_ids, pop_keys, parties, blocked) from a JSON object of states, read by Spark from any store.

    ``parties``: party -> its first column; roles that a state does not name are absent, block lists may be.
    """
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {_STATE}>")).alias("state", "m"))
    named = F.filter(F.map_entries("m.party_data"), lambda e: (F.size(e.value) > 0) & e.key.isin(*PARTY_KEYS))
    party = F.create_map(*[F.lit(x) for pair in PARTY_KEYS.items() for x in pair])
    parties = F.map_from_entries(F.transform(named, lambda e: F.struct(party[e.key], e.value[0])))
    blocked = F.coalesce("m.non_precinct_ids", F.array().cast("array<string>"))
    return rows.select("state", _names(F.col("m.ele_id")).alias("ids"), _names(F.col("m.geo_id")).alias("geo_ids"), _names(F.col("m.pop_key")).alias("pop_keys"), parties.alias("parties"), blocked.alias("blocked"))


def _file(path: Column, suffix: str) -> Column:
    """The part of a path, a file or a folder of part files, that ends with the suffix."""
    return F.regexp_extract(path, rf"([^/]+\.{suffix})(?:/[^/]*)?$", 1)


def _tab(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, names, cells) of all lines; a file's first line names its columns."""
    lines = spark.read.text(f"{path}/*.tab")
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = lines.select(_file(meta("file_path"), "tab").alias("file"), meta("file_path").alias("part"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    heads = lines.where("block = 0").groupBy("file", "part").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first"))
    # lines keep the order of a file within a scan; a header may be repeated in each part of a file
    rows = lines.join(heads, ["file", "part"]).where("block > 0 or at <> first")
    clean = lambda c: F.transform(split(c, "\t"), lambda x: F.regexp_replace(x, "^\"(.*)\"$", "$1"))
    return rows.select("file", "at", clean(F.col("head")).alias("names"), clean(F.col("value")).alias("cells"))


def _json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    rows = read_features(spark, f"{path}/*.json", lines)
    return rows.select(_file(F.col("path"), "json").alias("file"), F.monotonically_increasing_id().alias("at"), F.map_keys("properties").alias("names"), F.map_values("properties").alias("cells"))


def read_elections(spark: SparkSession, path: str, files: DataFrame, roles: DataFrame, lines: bool = False) -> DataFrame:
    """[S1, S2, S5, S8, S20] (state, id, party, votes) of all election tables below ``path``, each format scanned once.

    ``files``: (file, state), the manifest: which ``.tab`` or ``.json`` (a file, or a folder of parts) is which
    state's; others are left out. ``roles``: as role_map() gives them. Ids of several columns are joined; those that hold a blocked
    token are water. Cells that are no numbers, missing columns and absent properties give no row; of rows that repeat an id the
    last one of its file counts. ``lines``: JSON collections stand one to a line.
    """
    rows = _tab(spark, path).union(_json(spark, path, lines)).join(files, "file").join(roles, "state")
    cell = lambda name: F.get("cells", (F.array_position("names", name) - 1).cast("int"))
    held = lambda name: F.array_position("names", name) > 0
    rows = rows.withColumn("id", F.array_join(F.transform(F.filter("ids", held), cell), ""))
    rows = rows.where((F.size("ids") > 0) & ~F.exists("blocked", lambda b: F.contains(F.col("id"), b)))
    votes = rows.select("state", "id", "at", "names", "cells", F.explode("parties").alias("party", "name"))
    votes = votes.where(held(F.col("name"))).select("state", "id", "at", "party", cell(F.col("name")).alias("cell"))
    votes = votes.where(~missing(F.col("cell")) & is_number(F.col("cell")))
    return votes.groupBy("state", "id", "party").agg(F.max_by(F.col("cell").try_cast("double").cast("long"), "at").alias("votes"))
