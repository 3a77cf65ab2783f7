"""Winsorizing, averages, changes, running products, wide tables and row selection."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by, col, join_keys, listed, nan_to_null, numeric_columns, present

#: Ranges that a table without groups is cut into.
BUCKETS = 200


def winsorize(df: DataFrame, pct: float | tuple[float, float], subset: str | Sequence[str] | None = None, byvars: str | Sequence[str] | None = None, bot: bool = True, top: bool = True) -> DataFrame:
    """Clip columns to their quantiles, whole or by group; pct is one share or (bottom, top).

    The top is clipped first, and the bottom quantile is that of the clipped column. NULL stays NULL.
    """
    low, high = (pct, pct) if isinstance(pct, (int, float)) else pct
    df, keys = nan_to_null(df), listed(byvars)
    names = listed(subset) or numeric_columns(df, keys)
    order = df.columns
    df = df.withColumns({c: col(c).cast("double") for c in names})
    for wanted, share, clip in ((top, 1 - high, F.least), (bot, low, F.greatest)):
        if wanted:
            limits = [F.percentile(col(c), share).alias(f"__limit{i}") for i, c in enumerate(names)]
            # Counts of values are added up before the shuffle; the limits are one row for each group.
            df = join_keys(df, df.groupBy(*map(col, keys)).agg(*limits), keys) if keys else df.join(F.broadcast(df.agg(*limits)))
            df = df.withColumns({c: F.when(col(c).isNotNull(), clip(col(c), F.col(f"__limit{i}"))) for i, c in enumerate(names)}).select(*map(col, order))
    return df


def averages(df: DataFrame, avgvars: str | Sequence[str], byvars: str | Sequence[str], wtvar: str | None = None, count: str | bool = False) -> DataFrame:
    """Means by group, with wtvar also <col>_wavg, and with count="v" the number of non-null v as v_count.

    The weights of rows without a value count in the denominator. Rows with a null key are left out.
    """
    df, keys, names = nan_to_null(df), listed(byvars), listed(avgvars)
    out = [F.avg(col(c)).alias(c) for c in names]
    if wtvar:
        out += [F.try_divide(F.coalesce(F.sum(col(c) * col(wtvar)), F.lit(0.0)), F.sum(col(wtvar))).alias(f"{c}_wavg") for c in names]
    if count:
        n = F.count(col(count)).cast("double")
        out.append(n.alias(f"{count}_count"))
        if wtvar:
            out.append(F.when(F.sum(col(wtvar)) != 0, n).alias(f"{count}_count_wavg"))
    return df.filter(present(keys)).groupBy(*map(col, keys)).agg(*out)


def var_change_by_groups(df: DataFrame, var: str | Sequence[str], byvars: str | Sequence[str], datevar: str = "Date", numlags: int = 1) -> DataFrame:
    """<v>_change: the value less that numlags distinct (value, key, date) rows before, merged back onto the rows."""
    df, names, keys = nan_to_null(df), listed(var), listed(byvars)
    whole = df.filter(present([*keys, datevar])).select(*map(col, [*keys, datevar, *names])).distinct()
    w = by(keys).orderBy(col(datevar), *map(col, names))
    changed = whole.withColumns({f"{v}_change": col(v) - F.lag(col(v), numlags).over(w) for v in names})
    return join_keys(df, changed, [*keys, datevar, *names])


def cumulate(df: DataFrame, cumvars: str | Sequence[str], method: str, periodvar: str = "Date", byvars: str | Sequence[str] | None = None, time: Sequence[int] | None = None, grossify: bool = False, replace: bool = False) -> DataFrame:
    """Running products cum_<col> within groups and windows of periods.

    "between": the first period is window 0, then each stretch up to the next of `time` (positions, shifted so that the
    first is 0) is a window. "first": the earliest period of the whole table is a window of its own, the rest another.
    A null makes the rest of its window null. grossify adds one before and takes it off after.

    Without byvars the one group is cut into BUCKETS ranges of the period, whose counts and products are carried over
    from range to range in a table of a row for each range and window; periods that are text stay in one range.
    """
    method = method.lower()
    if method == "zero":
        raise NotImplementedError("method zero isn't defined")
    if method not in ("between", "first"):
        raise ValueError("method must be between or first")
    if method == "between" and time is None:
        raise ValueError("method between needs time")
    if time is not None and method != "between":
        warnings.warn("time is ignored unless method is between", stacklevel=2)
    df, names, keys = nan_to_null(df), listed(cumvars), listed(byvars)
    if grossify:
        df = df.withColumns({c: col(c) + 1 for c in names})
    window, bucket, out = "__cumulate_window", "__bucket", df.columns
    df = _in_ranges(df, periodvar, bucket) if not keys else df.withColumn(bucket, F.lit(0))
    if method == "between":
        place = F.row_number().over(by([*keys, bucket]).orderBy(col(periodvar).asc_nulls_last())) - 1
        if not keys:
            sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))
            before = sizes.select(bucket, (F.sum("__n").over(Window.orderBy(bucket)) - F.col("__n")).alias("__before"))
            df = df.join(F.broadcast(before), bucket)  # a row for each range
            place = place + F.col("__before")
        ends = sorted(t - min(time) for t in time)
        later = reduce(lambda a, b: a + b, [(place > F.lit(t)).cast("int") for t in ends if t > 0], F.lit(1))
        df = df.withColumn(window, F.when(place == 0, F.lit(0)).otherwise(later))
    else:
        first = df.agg(F.min(col(periodvar)).alias("__first"))
        # One row: the table's earliest period.
        df = df.join(F.broadcast(first)).withColumn(window, F.when(col(periodvar) == F.col("__first"), 0).otherwise(1)).drop("__first")
    w = by([*keys, window, bucket]).orderBy(col(periodvar).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    nulls = {c: F.count(F.when(col(c).isNull(), 1)) for c in names}
    values = {c: F.product(col(c).cast("double")) for c in names}
    if keys:
        done = {c: F.when(nulls[c].over(w) == 0, values[c].over(w)) for c in names}
    else:
        totals = df.groupBy(window, bucket).agg(*(nulls[c].alias(f"__nulls{i}") for i, c in enumerate(names)), *(F.coalesce(values[c], F.lit(1.0)).alias(f"__value{i}") for i, c in enumerate(names)))
        earlier = Window.partitionBy(window).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.coalesce(f(f"__{n}{i}").over(earlier), F.lit(x)).alias(f"__{n}{i}") for i in range(len(names)) for f, n, x in ((F.sum, "nulls", 0), (F.product, "value", 1.0))]
        df = df.join(F.broadcast(totals.select(window, bucket, *carried)), [window, bucket])
        done = {c: F.when(nulls[c].over(w) + F.col(f"__nulls{i}") == 0, values[c].over(w) * F.col(f"__value{i}")) for i, c in enumerate(names)}
    df = df.withColumns({f"cum_{c}": x for c, x in done.items()}).select(*map(col, out), *(col(f"cum_{c}") for c in names))
    if grossify:
        df = df.withColumns({n: col(n) - 1 for c in names for n in (c, f"cum_{c}")})
    if replace:
        df = df.drop(*names).withColumnsRenamed({f"cum_{c}": c for c in names})
    return df


def _in_ranges(df: DataFrame, name: str, bucket: str) -> DataFrame:
    """df with the range of its approximate quantiles that a column lies in; null is in the last one, after all others."""
    if not isinstance(df.schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(bucket, F.lit(0))
    cuts = df.agg(F.percentile_approx(col(name), [k / BUCKETS for k in range(1, BUCKETS)]).alias("__cuts"))  # one row
    here = F.when(col(name).isNull(), BUCKETS).otherwise(F.size(F.filter("__cuts", lambda c: c < col(name))))
    return df.join(F.broadcast(cuts)).withColumn(bucket, here).drop("__cuts")


def long_to_wide(df: DataFrame, groupvars: str | Sequence[str], values: str | Sequence[str], colindex: str | Sequence[str] | None = None, colindex_only: bool = False, columns: Sequence | None = None, orderby: str | Sequence[str] | None = None) -> DataFrame:
    """One column <value><colindex> for each value and index, joined to the other columns and made distinct.

    Rows that are equal throughout count once. A list of index columns gives names <value>_<first>_<second>. Without
    colindex the index is the position in the group by orderby, or else by the other columns and the values. Two values
    for one cell raise an error. columns gives the index values, else they are looked up, up to as many as Spark pivots
    (spark.sql.pivotMaxValues). colindex_only names the columns by the index alone.
    """
    keys, names, index = listed(groupvars), listed(values), listed(colindex)
    df = df.distinct()
    if colindex_only and len(names) > 1:
        raise ValueError("colindex_only needs a single value column")
    at = "__index"
    if index:
        texts = [F.coalesce(col(c).cast("string"), F.lit("nan")) for c in index]
        df = df.withColumn(at, texts[0] if isinstance(colindex, str) else F.concat(*(x for t in texts for x in (F.lit("_"), t))))
    else:
        order = listed(orderby) or [*(c for c in df.columns if c not in (*keys, *names)), *names]
        df = df.withColumn(at, (F.row_number().over(by(keys).orderBy(*map(col, order))) - 1).cast("string"))
    if columns is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        columns = sorted((r[0] for r in df.select(at).distinct().limit(most + 1).collect()), key=(str if index else int))
        if len(columns) > most:
            raise ValueError(f"more than {most} index values; give columns or raise spark.sql.pivotMaxValues")
    labels = [str(c) for c in columns]
    cells = []
    for v in names:
        for label in labels:
            here = F.col(at) == label
            one = F.when(F.count(F.when(here, 1)) > 1, F.raise_error(F.lit(f"more than one {v} for {label}")).cast(df.schema[v].dataType))
            cells.append(one.otherwise(F.first(F.when(here, col(v)), True)).alias(label if colindex_only else f"{v}{label}"))
    wide = df.groupBy(*map(col, keys)).agg(*cells)
    rest = df.drop(at, *names, *index).distinct()
    if set(rest.columns) == set(keys):
        return wide
    return join_keys(rest, wide, keys)


def select_rows_by_condition_on_columns(df: DataFrame, cols: str | Sequence[str], condition: str | Callable[[Column], Column] = "== 1", logic: str = "or") -> DataFrame:
    """Rows where any ("or") or all ("and") of the columns meet the condition; != keeps rows with NULL."""
    if logic not in ("or", "and"):
        raise ValueError("logic must be or or and")
    tests = []
    for c in listed(cols):
        if callable(condition):
            tests.append(condition(col(c)))
        elif condition.strip().startswith("!="):
            tests.append(~F.expr(f"`{c}` <=> ({condition.strip()[2:]})"))
        else:
            tests.append(F.expr(f"`{c}` {condition}"))
    return df.filter(reduce(lambda a, b: a | b if logic == "or" else a & b, tests))


def formatted_corr_df(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The lower triangle of pairwise-complete correlations as text with two decimals; undefined ones are nan."""
    df = nan_to_null(df)
    names = listed(cols) or numeric_columns(df)
    pairs = {}
    for i, a in enumerate(names):
        for j in range(i + 1):
            x, y = (F.when(col(a).isNotNull() & col(names[j]).isNotNull(), col(c).cast("double")) for c in (a, names[j]))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            pairs[i, j] = F.coalesce(F.format_string("%.2f", r), F.lit("nan")).alias(f"c{i}_{j}")
    row = df.agg(*pairs.values())
    lines = [F.struct(F.lit(a).alias("variable"), *((F.col(f"c{i}_{j}") if j <= i else F.lit("")).alias(b) for j, b in enumerate(names))) for i, a in enumerate(names)]
    return row.select(F.inline(F.array(*lines)))
