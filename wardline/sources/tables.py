"""Delimited election tables, plan texts, key maps and metadata."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_number, split

#: Column roles that a key map may name. Fixed values.
ROLES = ("GEO", "ELE", "POP", "DEM", "REP", "LIB", "REF", "GRE", "IND", "OTH", "TOT")
_PARTY_OF_ROLE = {"DEM": "dem", "REP": "rep", "LIB": "lib", "REF": "reform", "GRE": "green", "IND": "ind", "OTH": "other", "TOT": "total"}


def read_delimited(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """[S1] Lines as arrays of cells, without quoting; the last cell stays even if empty."""
    return spark.read.text(path).select(split(F.col("value"), delimiter).alias("cells"))


def read_table(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """A delimited file with a header; all columns are text, double quotes around cells go."""
    return spark.read.csv(path, sep=delimiter, header=True, quote='"', inferSchema=False)


def votes_long(table: DataFrame, id_column: str, parties: dict[str, str], order: Column | None = None) -> DataFrame:
    """[S2] (id, party, votes): cells that are numbers, truncated; of rows repeating an id the last one counts.

    ``parties``: party -> column. ``order``: what makes a row later; row position by default.
    """
    order = F.monotonically_increasing_id() if order is None else order
    clean = lambda c: F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit(""))
    wide = table.select(clean(id_column).alias("id"), order.alias("__at"), *[clean(c).alias(p) for p, c in parties.items()])
    long = wide.unpivot(["id", "__at"], list(parties), "party", "cell").where(is_number(F.col("cell")))
    return long.groupBy("id", "party").agg(F.max_by(F.col("cell").try_cast("double").cast("long"), "__at").alias("votes"))


def parse_keys(text: str) -> dict[str, str]:
    """[S19] Role -> column from a JSON object; unknown roles are refused."""
    keys = json.loads(text)
    if unknown := set(keys) - set(ROLES):
        raise ValueError(f"unknown roles: {sorted(unknown)}")
    return keys


def party_columns(keys: dict[str, str]) -> dict[str, str]:
    """Party -> column of a key map."""
    return {_PARTY_OF_ROLE[r]: c for r, c in keys.items() if r in _PARTY_OF_ROLE}


def reader_for(election: str, population: str | None = None) -> tuple[str, str]:
    """[S8] Kinds of the two sources by suffix: json, tab or none; others are refused."""

    def kind(path: str | None) -> str:
        if not path or path == "none":
            return "none"
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix in ("json", "geojson"):
            return "json"
        if suffix in ("tab", "tsv"):
            return "tab"
        raise ValueError(f"unknown source: {path}")

    return kind(election), kind(population)


def parse_plan(text: Column) -> Column:
    """[S12, S15] array<array<string>> from ``[['a', 'b'], ['c']]``; parsed as JSON, never evaluated."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<array<string>>")


def plan_assignment(plans: DataFrame, precincts: DataFrame | None = None, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """[S12, S15] (by, precinct_id, community_id) of plan texts; ids that no precinct has are left out."""
    out = plans.select(*by, F.posexplode(parse_plan(F.col(text))).alias("community_id", "ids")).select(*by, "community_id", F.explode("ids").alias("precinct_id"))
    if precincts is not None:
        out = out.join(precincts.select(F.col("precinct_id")).distinct(), "precinct_id", "left_semi")
    return out.select(*by, "precinct_id", "community_id")


def quantification_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """[S14] (community_id, absolute, collapsed) from the first two tab-separated lines; ids are positions, cells that
    are no numbers have no row."""
    lines = F.split(F.col(text), "\n")
    cells = lambda i: F.transform(F.split(F.get(lines, F.lit(i)), "\t"), lambda c: F.trim(c).try_cast("double"))
    both = F.arrays_zip(cells(0).alias("absolute"), cells(1).alias("collapsed"))
    return texts.select(F.posexplode(both).alias("community_id", "v")).select("community_id", "v.absolute", "v.collapsed").where("absolute is not null")


def quantified_plan(assignment: DataFrame, quantified: DataFrame) -> DataFrame:
    """[S13] A plan with the scores of its communities, by position."""
    return assignment.join(quantified, "community_id", "left")


def quantification_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """[S16] As S14, with ``parties`` map<string, double> from the third line's ``["DEM":x,...]`` cells."""
    lines = F.split(F.col(text), "\n")
    cell = F.regexp_replace(F.regexp_replace(F.col("cell"), r"^\s*\[", "{"), r"\]\s*$", "}")
    maps = texts.select(F.posexplode(F.split(F.get(lines, F.lit(2)), "\t")).alias("community_id", "cell")).select("community_id", F.from_json(cell, "map<string, double>").alias("parties"))
    return quantification_rows(texts, text).join(maps, "community_id", "left")


def read_graph(nodes: Column, edges: Column) -> tuple[Column, Column]:
    """[S17] Node and edge lists from two JSON arrays."""
    return F.from_json(nodes, "array<long>"), F.from_json(edges, "array<array<long>>")
