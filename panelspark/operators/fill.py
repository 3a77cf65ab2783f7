"""Filling by group and balancing of panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by, col, join_keys, listed, nan_to_null, present

_NUMERIC = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}


def fillna_by_groups(df: DataFrame, byvars: str | Sequence[str], exclude_cols: str | Sequence[str] | None = None, str_vars: str = "first", num_vars: str = "mean", orderby: str | Sequence[str] | None = None) -> DataFrame:
    """Fill each column's missing values with one value of the group: an aggregate, or its first or last valid value.

    Rows with a null key are left out. exclude_cols stay as they are. orderby says what first and last mean.
    """
    df, keys, skipped = nan_to_null(df), listed(byvars), listed(exclude_cols)
    df = df.filter(present(keys))
    order = [col(c) for c in listed(orderby)]
    done = {}
    for field in df.schema:
        c = field.name
        if c in keys or c in skipped:
            continue
        rule = num_vars if isinstance(field.dataType, T.NumericType) else str_vars
        if rule in ("first", "last"):
            place = F.when(col(c).isNotNull(), F.struct(*order)) if order else None
            done[c] = (F.first if rule == "first" else F.last)(col(c), True) if place is None else (F.min_by if rule == "first" else F.max_by)(col(c), place)
        elif rule in _NUMERIC and isinstance(field.dataType, T.NumericType):
            done[c] = _NUMERIC[rule](col(c))
        else:
            raise ValueError(f"unknown fill rule {rule!r} for {c}")
    rest = [c for c in df.columns if c not in keys]
    if done:
        # One value for each group and column, added up before the shuffle and joined back.
        groups = df.groupBy(*map(col, keys)).agg(*(x.alias(f"__fill{i}") for i, x in enumerate(done.values())))
        df = join_keys(df, groups, keys, null_safe=False).withColumns({c: F.coalesce(col(c), F.col(f"__fill{i}")) for i, c in enumerate(done)})
    return df.select(*map(col, keys), *map(col, rest))


def fillna_by_groups_and_keep_one_per_group(df: DataFrame, byvars: str | Sequence[str], exclude_cols: str | Sequence[str] | None = None, str_vars: str = "first", num_vars: str = "mean", orderby: str | Sequence[str] | None = None) -> DataFrame:
    """fillna_by_groups, then the first row of each group by orderby."""
    keys = listed(byvars)
    filled = fillna_by_groups(df, keys, exclude_cols, str_vars, num_vars, orderby)
    place = F.row_number().over(by(keys).orderBy(*([col(c) for c in listed(orderby)] or [F.lit(0)])))
    return filled.withColumn("__place", place).filter("__place = 1").drop("__place")


def _product(domains: Sequence[DataFrame]) -> DataFrame:
    """Every combination of the domains: what a balanced panel consists of."""
    out = domains[0]
    for domain in domains[1:]:
        out = out.crossJoin(domain)
    return out


def add_missing_group_rows(df: DataFrame, group_id_cols: str | Sequence[str], non_group_id_cols: str | Sequence[str], fill_method: str | None = "ffill", fill_limit: int | None = None) -> DataFrame:
    """Every combination of the id columns' values (NULL is one), with the others filled along each group.

    "ffill" takes the last value before, "bfill" the next one after, at most fill_limit rows away; both also fill
    values that were missing before.
    """
    df, groups, others = nan_to_null(df), listed(group_id_cols), listed(non_group_id_cols)
    ids = [*groups, *others]
    whole = _product([df.select(col(c)).distinct() for c in ids])
    joined = join_keys(whole, df, ids)
    if fill_method is None:
        return joined
    if fill_method not in ("ffill", "bfill"):
        raise ValueError("fill_method must be ffill, bfill or None")
    w = by(groups).orderBy(*(col(c).asc_nulls_last() for c in others))
    if fill_method == "ffill":
        w = w.rowsBetween(Window.unboundedPreceding if fill_limit is None else -fill_limit, 0)
    else:
        w = w.rowsBetween(0, Window.unboundedFollowing if fill_limit is None else fill_limit)
    take = F.last if fill_method == "ffill" else F.first
    return joined.withColumns({c: take(col(c), True).over(w) for c in joined.columns if c not in ids})


def drop_missing_group_rows(df: DataFrame, fill_id_cols: str | Sequence[str]) -> DataFrame:
    """Rows where some column other than the ids is there."""
    ids = listed(fill_id_cols)
    return df.dropna(how="all", subset=[c for c in df.columns if c not in ids])


def fill_excluded_rows(df: DataFrame, byvars: Sequence[str | DataFrame], fillvars: str | Sequence[str] | None = None, value=None) -> DataFrame:
    """Every combination of the keys' non-null values; value fills fillvars (all other columns by default).

    A key may be a DataFrame of one column: its values are the key's domain, whether df has them or not.
    """
    df = nan_to_null(df)
    domains, keys = [], []
    for b in [byvars] if isinstance(byvars, (str, DataFrame)) else byvars:
        domain = df.select(col(b)) if isinstance(b, str) else b
        keys.append(domain.columns[0])
        domains.append(domain.filter(col(domain.columns[0]).isNotNull()).distinct())
    out = _product(domains).join(df, keys, "left")
    if value is not None:
        out = out.fillna(value) if isinstance(value, Mapping) else out.fillna(value, subset=listed(fillvars) or [c for c in df.columns if c not in keys])
    return out
