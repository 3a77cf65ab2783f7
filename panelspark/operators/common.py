"""Argument normalisers and the missing-value rule shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What a function that takes one column name or several accepts.
Names = str | Sequence[str]


def listed(names: Names | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing, as NULL does: float and double columns get NULL for it."""
    floating = {f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(floating) if floating else df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) and f.name not in exclude]


def present(names: Sequence[str]) -> Column:
    """Whether all of the keys are there."""
    out = F.lit(True)
    for name in names:
        out = out & col(name).isNotNull()
    return out


def by(names: Sequence[str]):
    """A window over the groups; without names over everything."""
    return Window.partitionBy(*(col(n) for n in names)) if names else Window.partitionBy(F.lit(0))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = True) -> DataFrame:
    """left with right's other columns, where all keys are equal; with null_safe NULL equals NULL.

    Right's keys get names of their own first, so both sides may come from one frame.
    """
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, other in names.items():
        same = same & (col(k).eqNullSafe(F.col(other)) if null_safe else col(k) == F.col(other))
    return left.join(right, same, how).drop(*names.values())
