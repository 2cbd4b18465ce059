"""The 14 date and time operators."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c, check_format, format_column, to_java_parse
from ..plans.context import Context, replace
from ..registry import exists, operator, typed
from ..types import is_datetime, is_string, is_timestamp

moment = typed("column", "date/datetime", is_datetime)


def _field(df: DataFrame, column: str, new_column: str | None, f) -> DataFrame:
    return replace(df, new_column or column, f(c(column)).cast("bigint"))


@operator(exists("column"), moment)
def dt_year(df: DataFrame, ctx: Context, column: str, new_column: str | None = None) -> DataFrame:
    """Year."""
    return _field(df, column, new_column, F.year)


@operator(exists("column"), moment)
def dt_month(df: DataFrame, ctx: Context, column: str, new_column: str | None = None) -> DataFrame:
    """Month."""
    return _field(df, column, new_column, F.month)


@operator(exists("column"), moment)
def dt_day(df: DataFrame, ctx: Context, column: str, new_column: str | None = None) -> DataFrame:
    """Day of the month."""
    return _field(df, column, new_column, F.dayofmonth)


@operator(exists("column"), moment)
def dt_week(df: DataFrame, ctx: Context, column: str, new_column: str | None = None) -> DataFrame:
    """ISO week."""
    return _field(df, column, new_column, F.weekofyear)


@operator(exists("column"), moment)
def dt_quarter(df: DataFrame, ctx: Context, column: str, new_column: str | None = None) -> DataFrame:
    """Quarter."""
    return _field(df, column, new_column, F.quarter)


def _format_params(p: dict[str, Any]) -> dict[str, Any]:
    check_format(p["fmt"])
    return p


@operator(exists("column"), moment, prepare=_format_params)
def dt_year_month(df: DataFrame, ctx: Context, column: str, new_column: str, fmt: str = "%Y-%m") -> DataFrame:
    """Formatted, by default as 2024-05."""
    return replace(df, new_column, format_column(c(column), fmt))


@operator(exists("column"), moment)
def dt_quarter_year(df: DataFrame, ctx: Context, column: str, new_column: str) -> DataFrame:
    """As Q1-2024."""
    x = c(column)
    return replace(df, new_column, F.concat(F.lit("Q"), F.quarter(x).cast("string"), F.lit("-"), F.year(x).cast("string")))


@operator(exists("column"), moment)
def dt_calendar_week(df: DataFrame, ctx: Context, column: str, new_column: str) -> DataFrame:
    """ISO year and week as 2024-W05."""
    return replace(df, new_column, format_column(c(column), "%G-W%V"))


@operator(exists("column"), typed("column", "string", is_string), prepare=lambda p: (to_java_parse(p["fmt"]), p)[1])
def dt_parse(df: DataFrame, ctx: Context, column: str, fmt: str = "%Y-%m-%d", new_column: str | None = None) -> DataFrame:
    """String to date; null where it doesn't follow the format."""
    return replace(df, new_column or column, F.try_to_timestamp(c(column), F.lit(to_java_parse(fmt))).cast("date"))


@operator(exists("column"), moment, prepare=_format_params)
def dt_format(df: DataFrame, ctx: Context, column: str, fmt: str, new_column: str | None = None) -> DataFrame:
    """strftime."""
    return replace(df, new_column or column, format_column(c(column), fmt))


def elapsed_days(a: Column, b: Column, both_dates: bool) -> Column:
    """Whole days from b to a, towards zero."""
    if both_dates:
        return F.datediff(a, b).cast("bigint")
    return F.timestamp_diff("DAY", b.cast("timestamp_ntz"), a.cast("timestamp_ntz")).cast("bigint")


def _dates(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[x].dataType, T.DateType) for x in columns)


@operator(exists("column_a"), exists("column_b"), typed("column_a", "date/datetime", is_datetime), typed("column_b", "date/datetime", is_datetime))
def dt_diff_days(df: DataFrame, ctx: Context, column_a: str, column_b: str, new_column: str) -> DataFrame:
    """a - b in whole elapsed days."""
    return replace(df, new_column, elapsed_days(c(column_a), c(column_b), _dates(df, column_a, column_b)))


@operator(exists("birth_column"), exists("reference_column"), typed("birth_column", "date/datetime", is_datetime), typed("reference_column", "date/datetime", is_datetime))
def dt_age_years(df: DataFrame, ctx: Context, birth_column: str, reference_column: str | None = None, new_column: str = "age") -> DataFrame:
    """floor(days / 365) up to a reference column, or to today."""
    if reference_column is None:
        days = elapsed_days(F.current_date(), c(birth_column).cast("date"), True)
    else:
        days = elapsed_days(c(reference_column), c(birth_column), _dates(df, birth_column, reference_column))
    return replace(df, new_column, F.floor(days / F.lit(365)).cast("bigint"))


# Unit -> (kind, size in microseconds or months).
_UNITS = {"us": ("micros", 1), "ms": ("micros", 10**3), "s": ("micros", 10**6), "m": ("micros", 60 * 10**6), "h": ("micros", 3600 * 10**6), "d": ("micros", 86400 * 10**6), "w": ("micros", 7 * 86400 * 10**6), "mo": ("months", 1), "q": ("months", 3), "y": ("months", 12)}
#: 1970-01-01 was a Thursday; weeks start on Monday.
_WEEK_SHIFT = 3 * 86400 * 10**6


def parse_every(every: str) -> tuple[int, str]:
    m = re.fullmatch(r"(\d+)(us|ms|s|mo|m|h|d|w|q|y)", every)
    if not m or int(m[1]) < 1:
        raise ValueError(f"Unsupported truncation: {every!r}")
    return int(m[1]), m[2]


@operator(exists("column"), moment, prepare=lambda p: (parse_every(p["every"]), p)[1])
def dt_truncate(df: DataFrame, ctx: Context, column: str, every: str, new_column: str | None = None) -> DataFrame:
    """Truncate to 1d, 1w, 1mo, 1q, 1y, 1h, 1m, 1s or a multiple, counted from 1970-01-01 (weeks from a Monday)."""
    n, unit = parse_every(every)
    kind, size = _UNITS[unit]
    x, t = c(column), df.schema[column].dataType
    if kind == "months":
        months = (F.year(x) - 1970) * 12 + F.month(x) - 1
        start = F.floor(months / F.lit(n * size)) * (n * size)
        out = F.add_months(F.lit("1970-01-01").cast("date"), start.cast("int"))
    else:
        shift = _WEEK_SHIFT if unit == "w" else 0
        micros = F.unix_micros(x.cast("timestamp_ntz").cast("timestamp")) + shift
        out = F.timestamp_micros(micros - F.pmod(micros, F.lit(n * size)) - shift).cast("timestamp_ntz")
    return replace(df, new_column or column, out.cast(t if is_timestamp(t) else "date"))


_CLOSED = ("both", "left", "right", "none")


def _between_params(p: dict[str, Any]) -> dict[str, Any]:
    if p["closed"] not in _CLOSED:
        raise ValueError(f"closed must be one of {_CLOSED}")
    return p


@operator(exists("column"), moment, prepare=_between_params)
def dt_is_between(df: DataFrame, ctx: Context, column: str, start: str, end: str, new_column: str, closed: str = "both") -> DataFrame:
    """Whether a moment lies between two dates (both at midnight); null for null."""
    x = c(column)
    low, high = (F.lit(v).cast("timestamp_ntz" if is_timestamp(df.schema[column].dataType) else "date") for v in (start, end))
    above = x >= low if closed in ("both", "left") else x > low
    below = x <= high if closed in ("both", "right") else x < high
    return replace(df, new_column, above & below)
