"""Dates: SAS dates, parts, shifts by months, years or trading days, and the US trading calendar."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import col

#: Seconds from 1960-01-01 to 1970-01-01.
_SAS_EPOCH = 315_619_200


def convert_sas_date(days: Column) -> Column:
    """Days since 1960-01-01, whole or not, as a timestamp; needs a UTC session."""
    return F.timestamp_seconds(F.round(days.cast("double") * 86_400) - _SAS_EPOCH)


def year_month_from_date(df: DataFrame, date: str = "Date", yearname: str = "Year", monthname: str = "Month") -> DataFrame:
    return df.withColumns({yearname: F.year(col(date)), monthname: F.month(col(date))})


def year_month_from_single_date(date: dt.date) -> tuple[int, int]:
    return date.year, date.month


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month, from its end for n < 0."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7 + 7 * (-n - 1))


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar, from the golden number, the epact and the Sunday letter."""
    golden = year % 19
    century = year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= (epact // 28) * (1 - (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    return dt.date(year, 3, 28) + dt.timedelta(epact - weekday)


def trading_holidays(year: int) -> set[dt.date]:
    """The nine US exchange holidays of a year; those of fixed date move from Saturday to Friday, from Sunday to Monday."""
    moved = lambda d: d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0))
    fixed = {moved(dt.date(year, m, d)) for m, d in ((1, 1), (7, 4), (12, 25))} | {moved(dt.date(year + 1, 1, 1))}
    floating = {_nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}
    return fixed | floating | ({_nth(year, 1, 0, 3)} if year >= 1986 else set())


def trading_calendar(spark: SparkSession, start: dt.date, end: dt.date, holidays: Sequence[dt.date] | None = None) -> DataFrame:
    """(day, is_trading, ordinal) of every day; the ordinal counts the trading days so far."""
    if holidays is None:
        holidays = [d for y in range(start.year, end.year + 1) for d in trading_holidays(y)]
    closed, rows, n, day = set(holidays), [], 0, start
    while day <= end:
        trading = day.weekday() < 5 and day not in closed
        n += trading
        rows.append((day, trading, n))
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "day date, is_trading boolean, ordinal int")


def _bounds(df: DataFrame, datevar: str, before: int, after: int) -> tuple[dt.date, dt.date] | None:
    row = df.agg(F.min(col(datevar).cast("date")).alias("a"), F.max(col(datevar).cast("date")).alias("b")).first()
    return None if row["a"] is None else (row["a"] - dt.timedelta(before), row["b"] + dt.timedelta(after))


def expand_time(df: DataFrame, intermediate_periods: bool = False, datevar: str = "Date", freq: str = "m", time: int | Sequence[int] = (12, 24, 36, 48, 60), newdate: str = "Shift Date", shiftvar: str = "Shift", holidays: Sequence[dt.date] | None = None) -> DataFrame:
    """A copy of each row for each shift, with the date shifted by months (m), years (a) or trading days (d).

    Months and years end at the last day of a shorter month and keep the time of day. intermediate_periods takes every
    shift from the smallest to the largest. The calendar of trading days covers the dates' range and is broadcast.
    """
    time = [time] if isinstance(time, int) else list(time)
    shifts = list(range(min(time), max(time) + 1)) if intermediate_periods else time
    out = df.withColumn(shiftvar, F.explode(F.array(*map(F.lit, shifts))))
    if freq in ("m", "a"):
        unit = "MONTH" if freq == "m" else "YEAR"
        return out.withColumn(newdate, F.timestamp_add(unit, col(shiftvar), col(datevar)))
    if freq != "d":
        raise ValueError("freq must be m, a or d")
    reach = 2 * max(abs(s) for s in shifts) + 20
    bounds = _bounds(df, datevar, reach, reach)
    if bounds is None:
        return out.withColumn(newdate, col(datevar))
    calendar = trading_calendar(df.sparkSession, *bounds, holidays)
    here = F.broadcast(calendar.select(F.col("day").alias("__day"), F.col("is_trading").alias("__open"), F.col("ordinal").alias("__at")))
    there = F.broadcast(calendar.filter("is_trading").select(F.col("ordinal").alias("__to"), F.col("day").alias("__new")))
    at = out.join(here, col(datevar).cast("date") == F.col("__day"), "left")
    step = F.when((col(shiftvar) > 0) | F.col("__open"), col(shiftvar)).otherwise(col(shiftvar) + 1)
    moved = at.withColumn("__goal", F.col("__at") + step).join(there, F.col("__goal") == F.col("__to"), "left")
    seconds = F.to_timestamp(col(datevar)).cast("timestamp_ntz") - F.to_timestamp(col(datevar).cast("date")).cast("timestamp_ntz")
    return moved.withColumn(newdate, F.col("__new").cast("timestamp_ntz") + seconds).drop("__day", "__open", "__at", "__goal", "__to", "__new")


def expand_months(df: DataFrame, datevar: str = "Date", newdatevar: str = "Daily Date", trade_days: bool = True, holidays: Sequence[dt.date] | None = None) -> DataFrame:
    """A copy of each row for each trading (or calendar) day of its month; a null date keeps its row."""
    day = col(datevar).cast("date")
    out = df.withColumn(newdatevar, F.explode_outer(F.sequence(F.trunc(day, "MM"), F.last_day(day))))
    if trade_days:
        bounds = _bounds(df, datevar, 31, 31)
        if bounds is not None:
            calendar = trading_calendar(df.sparkSession, *bounds, holidays)
            closed = F.broadcast(calendar.filter("not is_trading").select(F.col("day").alias("__closed")))
            out = out.join(closed, col(newdatevar) == F.col("__closed"), "left_anti")
    return out.withColumn(newdatevar, col(newdatevar).cast("timestamp_ntz"))
