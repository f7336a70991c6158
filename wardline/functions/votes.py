"""Votes of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def residual(total: Column, *known: Column, clamp: bool = True, least: float | None = None) -> Column:
    """Votes for nobody named: total less the known parties.

    ``clamp``: never below 0. ``least``: raise where it falls below this.
    """
    rest = total
    for k in known:
        rest = rest - F.coalesce(k, F.lit(0))
    if least is not None:
        rest = F.when(rest < least, F.raise_error(F.lit("residual votes below the allowed minimum")).cast("double")).otherwise(rest)
    return F.greatest(rest, F.lit(0)) if clamp else rest


def share(votes: Column, total: Column) -> Column:
    """Share of the total; null without votes."""
    return F.try_divide(votes.cast("double"), total)


def lean(rep: Column, dem: Column) -> Column:
    """A precinct's lean: share r of rep in rep + dem (0 without votes); r below one half counts as r - 1."""
    r = F.coalesce(F.try_divide(rep.cast("double"), rep + dem), F.lit(0.0))
    return F.when(r < 0.5, r - 1).otherwise(r)


def community_lean(rep: Column, dem: Column) -> Column:
    """[A19] A community's lean from its sums: r above one half, else -(1 - r); a tie leans -0.5."""
    r = F.coalesce(F.try_divide(rep.cast("double"), rep + dem), F.lit(0.0))
    return F.when(r > 0.5, r).otherwise(-(1 - r))


def checked_population(*parts: Column) -> Column:
    """[F8] Sum of the population columns; raises if it is negative."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return F.when(total < 0, F.raise_error(F.lit("negative population")).cast("double")).otherwise(total.cast("double"))


def collapse(absolute: Column, partisan: Column) -> Column:
    """[M21] absolute * 2 (0.5 - partisan); both must lie in [0, 1]."""
    fine = absolute.between(0, 1) & partisan.between(0, 1)
    return F.when(fine, absolute * 2 * (0.5 - partisan)).otherwise(F.raise_error(F.lit("values outside [0, 1]")).cast("double"))


def two_number_score(absolute: Column, rep: Column) -> tuple[Column, Column]:
    """[A28] State score g = mean of the absolute row, and its partisan side 2 (0.5 - mean rep) g."""
    g = F.avg(absolute)
    return g, 2 * (0.5 - F.avg(rep)) * g
