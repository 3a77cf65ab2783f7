"""Small frames as text or plots, types, and progress; for the driver only."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import col, datetime_columns

SHOWN = 1000


def to_copy_paste(df: DataFrame, most: int = SHOWN, column_names: bool = True) -> str:
    """An expression that makes the first rows of df again; it is printed and returned.

    Without column_names the columns are named c0, c1, ... Frames have no index, so there is none to keep.
    """
    rows = [tuple(r) for r in df.limit(most).collect()]
    kept = df if column_names else df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    text = f"spark.createDataFrame({rows!r}, {kept.schema.simpleString()[7:-1]!r})"
    print(text)
    return text


def ordinal(n: int) -> str:
    last = "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{last}"


def plot_multi_axis(df: DataFrame, x: str, cols: list[str], spacing: float = 0.1, most: int = 10_000, colored_axes: bool = False, axis_locations_in_legend: bool = True, legend_kwargs: dict | None = None):
    """A line for each column, each with an axis of its own, over at most `most` rows in order of x.

    More rows than that are thinned evenly over the order of x, so that the plot covers all of it. colored_axes gives an
    axis its line's color; legend_kwargs go to the legend.
    """
    if not cols:
        raise ValueError("cols must not be empty")
    import matplotlib.pyplot as plt

    step = max(1, -(-df.count() // most))
    chosen = df.select(col(x), *map(col, cols))
    if step > 1:
        chosen = chosen.withColumn("__part", F.ntile(most).over(Window.orderBy(col(x)))).groupBy("__part").agg(F.min_by(F.struct(*map(col, [x, *cols])), col(x)).alias("r")).select("r.*")
    rows = chosen.orderBy(col(x)).toPandas()
    _, first = plt.subplots()
    axes = [first]
    for k, name in enumerate(cols):
        axis = first if k == 0 else first.twinx()
        if k > 1:
            axis.spines["right"].set_position(("axes", 1 + spacing * (k - 1)))
        side = "left" if k == 0 else "right" if k == 1 else f"right, {ordinal(k)}"
        axis.plot(rows[x], rows[name], color=f"C{k}", label=f"{name} ({side})" if axis_locations_in_legend else name)
        axis.set_ylabel(name, **({"color": f"C{k}"} if colored_axes else {}))
        if colored_axes:
            axis.tick_params(axis="y", colors=f"C{k}")
        axes.append(axis)
    first.legend(handles=[a.lines[0] for a in axes[1:]], **(legend_kwargs or {}))
    return axes[1:]


def df_types_dict(df: DataFrame, remove_dates: bool = True) -> dict[str, str]:
    left_out = datetime_columns(df) if remove_dates else []
    return {n: t for n, t in df.dtypes if n not in left_out}


def optimized_df(df: DataFrame, floats: bool = False) -> DataFrame:
    """Whole numbers in the narrowest type that holds them; floats=True also narrows doubles, with a loss of digits."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    done = {}
    if whole:
        row = df.agg(*(F.min(col(c)).alias(f"a{i}") for i, c in enumerate(whole)), *(F.max(col(c)).alias(f"b{i}") for i, c in enumerate(whole))).first()
        for i, c in enumerate(whole):
            a, b = row[f"a{i}"] or 0, row[f"b{i}"] or 0
            done[c] = col(c).cast(next(t for t, bits in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(1 << bits) <= a and b < 1 << bits))
    if floats:
        done |= {f.name: col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(done) if done else df


def estimate_time(length: int, i: int, start_time: float, output: bool = True) -> datetime.datetime:
    """When a loop over length steps ends that is in step i, counted from 0; start_time is its time.perf_counter() then."""
    left = (time.perf_counter() - start_time) / (i + 1) * (length - i - 1)
    done = datetime.datetime.now() + datetime.timedelta(seconds=left)
    if output:
        print(f"{i + 1} of {length} done, the rest by {done:%Y-%m-%d %H:%M:%S}")
    return done
