"""Quantile portfolios, their averages, and long-short differences."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, join_keys, listed, nan_to_null, numeric_columns
from .transform import averages


def portfolio(df: DataFrame, groupvar: str, ngroups: int = 10, cutoffs: Sequence[float] | None = None, quant_cutoffs: Sequence[float] | None = None, byvars: str | Sequence[str] | None = None, cutdf: DataFrame | None = None, portvar: str = "portfolio", edge: str | None = None) -> DataFrame:
    """Buckets 1, 2, ... of groupvar by quantiles (of each group with byvars) or by hard cutoffs; missing values get 0.

    A value that equals a breakpoint goes to the lower bucket with byvars and to the higher one without, unless edge
    ("lower" or "upper") says otherwise. cutdf gives the rows that breakpoints are taken from; outer buckets are open.
    Infinite values get bucket 0 with byvars, as they have no place among the quantiles of a group.
    """
    if cutoffs is not None and quant_cutoffs is not None:
        raise ValueError("cutoffs and quant_cutoffs exclude each other")
    if (cutoffs is not None or quant_cutoffs is not None) and ngroups not in (10, None, 0):
        raise ValueError("ngroups can't be given with cutoffs")
    if (cutoffs is not None or quant_cutoffs is not None) and cutdf is not None:
        warnings.warn("cutdf isn't used with cutoffs", stacklevel=2)
        cutdf = None
    keys = listed(byvars)
    df = nan_to_null(df)
    x = col(groupvar).cast("double")
    if cutoffs is not None:
        if keys:
            warnings.warn("hard cutoffs hold for all groups", stacklevel=2)
        keys = []
    grouped = bool(keys)
    edge = edge or ("lower" if grouped else "upper")
    valid = F.when(F.abs(x) != F.lit(float("inf")), x) if grouped else x
    cuts = "__cuts"
    if cutoffs is not None:
        df = df.withColumn(cuts, F.array(*(F.lit(float(c)) for c in cutoffs)))
    else:
        shares = list(quant_cutoffs) if quant_cutoffs is not None else [i / ngroups for i in range(1, ngroups)]
        if not shares:
            df = df.withColumn(cuts, F.array().cast("array<double>"))
        elif grouped:
            marks = (df if cutdf is None else nan_to_null(cutdf)).groupBy(*map(col, keys)).agg(F.percentile(valid, shares).alias(cuts))
            df = join_keys(df, marks, keys)
        else:
            # One row of breakpoints for the whole table.
            marks = (df if cutdf is None else nan_to_null(cutdf)).agg(F.percentile(valid, shares).alias(cuts))
            df = df.join(F.broadcast(marks))
    below = (lambda c: x > c) if edge == "lower" else (lambda c: x >= c)
    bucket = 1 + F.size(F.filter(F.col(cuts), below))
    known = valid.isNotNull() & F.col(cuts).isNotNull()
    return df.withColumn(portvar, F.when(known, bucket).otherwise(F.lit(0))).drop(cuts)


def portfolio_averages(df: DataFrame, groupvar: str, avgvars: str | Sequence[str], ngroups: int = 10, byvars: str | Sequence[str] | None = None, cutdf: DataFrame | None = None, wtvar: str | None = None, count: str | bool = False, portvar: str = "portfolio", avgonly: bool = False):
    """averages() by portfolio and byvars; with avgonly=False also the rows with their portfolio."""
    ports = portfolio(df, groupvar, ngroups, byvars=byvars, cutdf=cutdf, portvar=portvar)
    avgs = averages(ports, avgvars, [portvar, *listed(byvars)], wtvar, count)
    return avgs if avgonly else (avgs, ports)


def long_short_portfolio(df: DataFrame, portvar: str, byvars: str | Sequence[str] | None = None, retvars: str | Sequence[str] | None = None, top_minus_bot: bool = True) -> DataFrame:
    """The top portfolio's values less the bottom one's, for each group; a group with one side only gives NULL.

    Without byvars each side must have one row.
    """
    df, keys = nan_to_null(df), listed(byvars)
    names = listed(retvars) or numeric_columns(df, keys)
    marked = df.join(F.broadcast(df.agg(F.max(col(portvar)).alias("__top"), F.min(col(portvar)).alias("__bottom"))))  # one row
    top = marked.filter(col(portvar) == F.col("__top")).select(*(col(k).alias(f"__t{i}") for i, k in enumerate(keys)), *(col(c).alias(f"__x{i}") for i, c in enumerate(names)))
    bottom = marked.filter(col(portvar) == F.col("__bottom")).select(*(col(k).alias(f"__b{i}") for i, k in enumerate(keys)), *(col(c).alias(f"__y{i}") for i, c in enumerate(names)))
    if not keys:
        top, bottom = (side.agg(*(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("byvars are needed: a side has several rows")).cast("double")).otherwise(F.first(c)).alias(c) for c in side.columns)) for side in (top, bottom))
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"__t{i}").eqNullSafe(F.col(f"__b{i}"))
    both = top.join(bottom, same, "full_outer") if keys else top.join(F.broadcast(bottom))
    sign = 1 if top_minus_bot else -1
    return both.select(*(F.coalesce(f"__t{i}", f"__b{i}").alias(k) for i, k in enumerate(keys)), *((sign * (F.col(f"__x{i}") - F.col(f"__y{i}"))).alias(c) for i, c in enumerate(names)))
