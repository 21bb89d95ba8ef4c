"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsengine.schema import SEASONS


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d, or the default where d is zero."""
    return F.coalesce(F.try_divide(n, d), F.lit(default))


def clip(c: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; a missing value counts as low."""
    return F.greatest(F.least(F.coalesce(c, F.lit(low)), F.lit(high)), F.lit(low))


def display(c: Column, digits: int) -> Column:
    """Round for export, in decimal, so that noise below 1e-9 never decides a half."""
    exact = F.round(c.try_cast("decimal(28,9)"), digits).cast("double")
    return F.coalesce(exact, F.round(c, digits))


def banded(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """First label whose condition holds."""
    head, *rest = rules
    out = F.when(head[0], head[1])
    for condition, label in rest:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def codes(rules: list[tuple[Column, Column | str]]) -> Column:
    """Array of the texts whose condition holds, in rule order."""
    return F.array_compact(
        F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in rules])
    )


def season_of(month: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in sorted(SEASONS.items()) for v in pair])
    return F.try_element_at(table, month)


def snake_case(c: Column) -> Column:
    """Lower, strip, and turn blanks, dashes and dots into underscores."""
    return F.regexp_replace(F.trim(F.lower(c)), "[ .-]", "_")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
