"""Backward as-of joins, aggregates merged back onto rows, positions in groups, functions of unique values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by, col, join_keys, listed, nan_to_null, numeric_columns, present


def left_merge_latest(left: DataFrame, right: DataFrame, on: str | Sequence[str], left_datevar: str = "Date", right_datevar: str = "Date", max_offset=None, backend: str = "pandas", low_memory: bool = False) -> DataFrame:
    """Each left row with all right rows of the latest right date that isn't after the left date.

    max_offset (an interval or number that a date can be reduced by) drops matches that are older. Null keys and dates
    match nothing and keep their row. Other columns that both sides have get _x and _y; the right date gets _y where
    its name is the left date's.

    One window over the union of both sides carries the latest right rows, as an array, to the left rows: one shuffle
    of the left side, and a key's rows never multiply before the match. backend and low_memory are accepted for
    compatibility and change nothing: there is one implementation, whose memory Spark bounds.
    """
    if backend not in ("pandas", "sql"):
        raise ValueError("backend must be pandas or sql")
    on = listed(on)
    left, right = nan_to_null(left), nan_to_null(right)
    shared = (set(left.columns) & set(right.columns)) - set(on)
    rename = lambda c, suffix: c + suffix if c in shared and c not in (left_datevar, right_datevar) else c
    right_date = f"{right_datevar}_y" if right_datevar == left_datevar else right_datevar
    rest = [c for c in right.columns if c not in on]
    keys = [f"__key_{i}" for i in range(len(on))]
    own = F.struct(*(col(c).alias(right_date if c == right_datevar else rename(c, "_y")) for c in rest))
    days = right.filter(present([*on, right_datevar])).groupBy(*(col(k).alias(n) for k, n in zip(on, keys)), col(right_datevar).alias("__date")).agg(F.collect_list(own).alias("__rows"))
    whole = F.struct(*(col(c).alias(rename(c, "_x")) for c in left.columns))
    asked = left.select(*(col(k).alias(n) for k, n in zip(on, keys)), col(left_datevar).alias("__date"), whole.alias("__left"))
    known = present([*keys, "__date"])
    events = asked.filter(known).unionByName(days, allowMissingColumns=True)
    # Rows of one date are peers, so right rows of the left row's own date count.
    upto = by(keys).orderBy("__date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.when(F.col("__rows").isNotNull(), F.struct(F.col("__date").alias("d"), F.col("__rows").alias("rows")))
    found = events.select("__date", "__left", F.last(latest, True).over(upto).alias("__latest")).filter("__left is not null")
    near = F.lit(True) if max_offset is None else F.col("__latest.d") >= F.col("__date") - F.lit(max_offset)
    found = found.select("__left", F.when(near, F.col("__latest.rows")).alias("__rows"))
    found = found.unionByName(asked.filter(~known).select("__left", F.lit(None).cast(days.schema["__rows"].dataType).alias("__rows")))
    return found.select("__left.*", F.explode_outer("__rows").alias("__right")).select(*(col(rename(c, "_x")) for c in left.columns), "__right.*")


def _aggregates(order: Sequence[str]) -> dict[str, Callable[..., Column]]:
    """Each aggregate of a column; order serves first and last."""
    place = F.struct(*map(col, order)) if order else F.lit(0)

    def skew(c: Column) -> Column:
        n = F.count(c)
        return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))

    return {
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
        "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
        "mean": F.avg,
        "median": F.median,
        "min": F.min,
        "max": F.max,
        "count": F.count,
        "size": lambda c: F.count(F.lit(1)),
        "nunique": lambda c: F.count_distinct(c).cast("int"),
        "std": F.stddev_samp,
        "var": F.var_samp,
        "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.nullif(F.count(c), F.lit(0))),
        "skew": skew,
        "quantile": lambda c, q=0.5: F.percentile(c, q),
        "first": lambda c: F.min_by(c, F.when(c.isNotNull(), place)),
        "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place)),
        "mode": lambda c: F.mode(c, True),
        "any": lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
        "all": lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
    }


_OF_ANY_TYPE = ("count", "size", "nunique", "first", "last", "nth", "mode", "min", "max")


def groupby_merge(df: DataFrame, byvars: str | Sequence[str], func: str | Sequence[str], *args, subset: str | Sequence[str] = "all", replace: bool = False, orderby: str | Sequence[str] | None = None) -> DataFrame:
    """A group aggregate on each row as <col>_<func>; rows with a null key keep their row with NULL.

    Several aggregates may be given as a list; one pass then serves all. They are added up before the shuffle, and the
    groups' results joined back. "nth" (by orderby) takes a window. "transform" takes a function of a pandas Series: it
    runs for each group over the rows where all chosen columns are there (null keys are a group of their own), elsewhere
    the result is NULL. "agg" takes one that returns a scalar. A group's rows for such a function are held by one Python
    worker. replace=True overwrites the columns in place.
    """
    keys, order = listed(byvars), listed(orderby)
    df = nan_to_null(df)
    funcs = [func] if isinstance(func, str) else list(func)
    if len(funcs) > 1 and (replace or args):
        raise ValueError("replace and arguments need a single aggregate")
    names = {f: listed(subset) if subset != "all" else [c for c in df.columns if c not in keys] if f in _OF_ANY_TYPE else numeric_columns(df, keys) for f in funcs}
    target = (lambda c, f: c) if replace else (lambda c, f: f"{c}_{f}")
    if func in ("transform", "agg", "apply"):
        return _by_function(df, keys, names[func], args[0], func, lambda c: target(c, func), order)
    known = _aggregates(order)
    if func == "nth":
        w = by(keys).orderBy(*([col(c) for c in order] or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({target(c, func): F.when(present(keys), F.nth_value(col(c), (args[0] if args else 0) + 1).over(w)) for c in names[func]})
    for f in funcs:
        if f not in known:
            raise ValueError(f"unknown aggregate {f!r}; known are {', '.join(sorted(known))}, nth, transform, agg, apply")
    done = {target(c, f): known[f](col(c), *args) for f in funcs for c in names[f]}
    groups = df.filter(present(keys)).groupBy(*map(col, keys)).agg(*(x.alias(f"__new{i}") for i, x in enumerate(done.values())))
    joined = join_keys(df, groups, keys, null_safe=False)
    return joined.withColumns({c: F.col(f"__new{i}") for i, c in enumerate(done)}).drop(*(f"__new{i}" for i in range(len(done))))


def _by_function(df: DataFrame, keys: list[str], names: list[str], func: Callable, kind: str, target: Callable[[str], str], order: list[str]) -> DataFrame:
    kinds = {c: T.DoubleType() if isinstance(df.schema[c].dataType, T.NumericType) else df.schema[c].dataType for c in names}
    if kind == "transform" and any(isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) for t in kinds.values()):
        kinds = {c: T.DoubleType() for c in names}
    fields = [f for f in df.schema.fields if f.name not in {target(c) for c in names}]
    schema = T.StructType([*fields, *(T.StructField(target(c), kinds[c]) for c in names)])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable") if order else group
        whole = group[names].notna().all(axis=1) if kind == "transform" else pd.Series(True, index=group.index)
        results = {}
        for c in names:
            result = func(group.loc[whole, c])
            if kind == "transform":
                column = pd.Series(None, index=group.index, dtype="object")
                column[whole] = list(result)
                results[target(c)] = column
            else:
                results[target(c)] = result if group[keys].notna().all(axis=None) else None
        out = group.assign(**results)
        for c in names:
            if isinstance(kinds[c], T.DoubleType):
                out[target(c)] = pd.to_numeric(out[target(c)])
        return out[[f.name for f in schema.fields]]

    return df.groupBy(*map(col, keys)).applyInPandas(one, schema)


def groupby_index(df: DataFrame, byvars: str | Sequence[str], sortvars: str | Sequence[str] | None = None, ascending: bool = True) -> DataFrame:
    """group_index: each row's position in its group from 0, by sortvars; null keys are a group of their own."""
    order = [col(c) for c in listed(sortvars)] or [F.lit(0)]
    w = by(listed(byvars)).orderBy(*(c.asc_nulls_last() if ascending else c.desc_nulls_last() for c in order))
    return df.withColumn("group_index", (F.row_number().over(w) - 1).cast("long"))


def apply_func_to_unique_and_merge(df: DataFrame, column: str, func: Callable[[pd.Series], pd.Series | pd.DataFrame], result: str | Sequence[str], result_type: str | Sequence[str]) -> DataFrame:
    """df with result = func(column), where func sees each distinct value once, in batches.

    For several result columns func returns a DataFrame, whose columns are taken in order.
    """
    unique = df.select(col(column).alias("__value")).distinct()
    names, types = listed(result), listed(result_type)
    if len(names) != len(types):
        raise ValueError("each result column needs a type")
    schema = T.StructType([*unique.schema.fields, *(f for n, t in zip(names, types) for f in T.StructType.fromDDL(f"`{n}` {t}").fields)])

    def run(batches):
        for batch in batches:
            found = func(batch["__value"])
            columns = [found] if isinstance(found, pd.Series) else [found.iloc[:, k] for k in range(found.shape[1])]
            yield batch.assign(**{n: c for n, c in zip(names, columns, strict=True)})

    found = unique.mapInPandas(run, schema)
    return join_keys(df, found.withColumnRenamed("__value", column), [column])
