"""Null- and IEEE-safe building blocks; all of them stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF, NAN = float("inf"), float("nan")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col(quote(name))


def ieee_divide(a: Column, b: Column) -> Column:
    """True division that yields infinities and NaN where ANSI mode would raise."""
    x, y = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, at_zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def ieee_log(x: Column, base: float | None = None) -> Column:
    """Logarithm with log 0 = -inf and NaN below."""
    x = x.cast("double")
    log = F.log10(x) if base == 10 else F.ln(x) if base is None else F.ln(x) / F.lit(math.log(base))
    return F.when(x > 0, log).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def round_half_away(x: Column, decimals: int, dtype: T.DataType) -> Column:
    """Round halves away from zero on the scaled IEEE value; exact types use Spark's own rounding."""
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.round(x, decimals)
    scale = 10.0 ** abs(decimals)
    wide = x.cast("double")
    scaled = wide * scale if decimals >= 0 else wide / scale
    whole = F.signum(scaled) * F.floor(F.abs(scaled) + 0.5).cast("double")
    rounded = whole / scale if decimals >= 0 else whole * scale
    # beyond 2^52 a double has no fraction; infinities and NaN stay
    return F.when(F.isnan(wide) | (F.abs(scaled) >= 2.0**52), wide).otherwise(rounded).cast(dtype)


def strip_blank(x: Column) -> Column:
    """Strip all white space, tabs and line feeds included."""
    return F.regexp_replace(x, r"^(?U)\s+|(?U)\s+$", "")
