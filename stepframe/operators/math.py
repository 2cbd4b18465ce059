"""The 25 math operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c, ieee_divide, ieee_log, round_half_away
from ..plans.context import HIDDEN, Context, replace, with_offsets
from ..registry import Scope, all_exist, as_list, exists, operator, typed
from ..types import is_datetime, is_numeric, is_timestamp

numeric = typed("column", "numeric", is_numeric)
_pair = (exists("column_a"), exists("column_b"), typed("column_a", "numeric", is_numeric), typed("column_b", "numeric", is_numeric))


def literal(value: Any, t: T.DataType) -> Column:
    """A number in the type that arithmetic with a column of type ``t`` calls for."""
    return F.lit(value).cast("bigint") if type(value) is int and isinstance(t, T.IntegralType) and -(2**63) <= value < 2**63 else F.lit(value)


def _in_place(df: DataFrame, column: str, f) -> DataFrame:
    return df.withColumn(column, f(c(column), df.schema[column].dataType))


@operator(exists("column"), numeric, each="column")
def math_add(df: DataFrame, ctx: Context, column: str, value: float) -> DataFrame:
    """Add a number."""
    return _in_place(df, column, lambda x, t: x + literal(value, t))


@operator(exists("column"), numeric, each="column")
def math_subtract(df: DataFrame, ctx: Context, column: str, value: float) -> DataFrame:
    """Subtract a number."""
    return _in_place(df, column, lambda x, t: x - literal(value, t))


@operator(exists("column"), numeric, each="column")
def math_multiply(df: DataFrame, ctx: Context, column: str, value: float) -> DataFrame:
    """Multiply by a number."""
    return _in_place(df, column, lambda x, t: x * literal(value, t))


@operator(exists("column"), numeric, each="column")
def math_divide(df: DataFrame, ctx: Context, column: str, value: float) -> DataFrame:
    """Divide by a number; by zero gives infinity or NaN."""
    return _in_place(df, column, lambda x, t: ieee_divide(x, F.lit(value)))


def clamp(x: Column, low: Any, high: Any, t: T.DataType) -> Column:
    """Null stays null, which greatest() and least() would not do."""
    out = x
    if high is not None:
        out = F.when(x > F.lit(high), literal(high, t)).otherwise(out)
    if low is not None:
        out = F.when(x < F.lit(low), literal(low, t)).otherwise(out)
    return out


@operator(exists("column"), numeric, each="column")
def math_clamp(df: DataFrame, ctx: Context, column: str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Clip to [lower, upper]; either may be left out."""
    return _in_place(df, column, lambda x, t: clamp(x, lower, upper, t))


@operator(*_pair)
def math_add_columns(df: DataFrame, ctx: Context, column_a: str, column_b: str, new_column: str) -> DataFrame:
    """a + b."""
    return replace(df, new_column, c(column_a) + c(column_b))


@operator(*_pair)
def math_subtract_columns(df: DataFrame, ctx: Context, column_a: str, column_b: str, new_column: str) -> DataFrame:
    """a - b."""
    return replace(df, new_column, c(column_a) - c(column_b))


@operator(*_pair)
def math_multiply_columns(df: DataFrame, ctx: Context, column_a: str, column_b: str, new_column: str) -> DataFrame:
    """a * b."""
    return replace(df, new_column, c(column_a) * c(column_b))


@operator(*_pair)
def math_divide_columns(df: DataFrame, ctx: Context, column_a: str, column_b: str, new_column: str) -> DataFrame:
    """a / b; zero divisors give infinity or NaN."""
    return replace(df, new_column, ieee_divide(c(column_a), c(column_b)))


@operator(exists("column"), numeric, each="column")
def math_set_min(df: DataFrame, ctx: Context, column: str, min_value: float) -> DataFrame:
    """Raise smaller values to the minimum."""
    return _in_place(df, column, lambda x, t: clamp(x, min_value, None, t))


@operator(exists("column"), numeric, each="column")
def math_set_max(df: DataFrame, ctx: Context, column: str, max_value: float) -> DataFrame:
    """Lower larger values to the maximum."""
    return _in_place(df, column, lambda x, t: clamp(x, None, max_value, t))


@operator(exists("column"), numeric, each="column")
def math_abs(df: DataFrame, ctx: Context, column: str) -> DataFrame:
    """Absolute value."""
    return df.withColumn(column, F.abs(c(column)))


@operator(exists("column"), numeric, each="column")
def math_round(df: DataFrame, ctx: Context, column: str, decimals: int = 0) -> DataFrame:
    """Round, halves away from zero."""
    return _in_place(df, column, lambda x, t: round_half_away(x, decimals, t))


@operator(exists("column"), exists("total_column"), numeric, typed("total_column", "numeric", is_numeric))
def math_percent_of(df: DataFrame, ctx: Context, column: str, total_column: str, new_column: str, multiply_by: float = 100.0) -> DataFrame:
    """column / total_column * multiply_by."""
    return replace(df, new_column, ieee_divide(c(column), c(total_column)) * F.lit(float(multiply_by)))


def grouped(p: dict[str, Any]) -> Scope:
    return Scope.GROUP if p["group_by"] else Scope.GLOBAL


@operator(exists("column"), numeric, all_exist("group_by", "Group-by columns"), scope=grouped, group="group_by", ordered=True)
def math_cumsum(df: DataFrame, ctx: Context, column: str, new_column: str | None = None, group_by: str | Sequence[str] | None = None) -> DataFrame:
    """Running sum in row order, by group or over all; null where the value is null."""
    x, keys = c(column), [c(g) for g in as_list(group_by)]
    rows = lambda w: w.orderBy(*ctx.order_by()).rowsBetween(Window.unboundedPreceding, 0)
    bucket = None if keys else ctx.buckets(df)
    if bucket is None:
        return replace(df, new_column or column, F.when(x.isNotNull(), F.sum(x).over(rows(Window.partitionBy(*keys)))))
    columns, carry = df.columns, f"{HIDDEN}carry"
    df, name = with_offsets(df, bucket, F.sum(x), carry)
    total = F.coalesce(F.sum(x).over(rows(Window.partitionBy(name))), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
    df = df.withColumn(f"{HIDDEN}out", F.when(x.isNotNull(), total))
    return _reordered(replace(df, new_column or column, F.col(f"{HIDDEN}out")), columns, new_column or column)


_RANKS = ("ordinal", "dense", "min", "max", "average", "random")


def _rank_params(p: dict[str, Any]) -> dict[str, Any]:
    if p["method"] not in _RANKS:
        raise ValueError(f"Unknown rank method: {p['method']}")
    return p


@operator(exists("column"), all_exist("group_by", "Group-by columns"), scope=grouped, group="group_by", ordered=lambda p: p["method"] == "ordinal", prepare=_rank_params)
def math_rank(df: DataFrame, ctx: Context, column: str, new_column: str, method: str = "ordinal", descending: bool = False, group_by: str | Sequence[str] | None = None) -> DataFrame:
    """Rank from 1: ordinal (ties in row order), dense, min, max, average, or random (ties at random); null for null."""
    x, keys, columns, carry = c(column), [c(g) for g in as_list(group_by)], df.columns, f"{HIDDEN}carry"
    bucket = None if keys else ctx.ranges(df, column, descending, nulls_first=False)
    if bucket is not None:
        # ranks within ranges of values, after the rows (or values) of the ranges before
        df, name = with_offsets(df, bucket, F.count_distinct(x) if method == "dense" else F.count(x), carry)
        keys = [F.col(name)]
    by = x.desc_nulls_last() if descending else x.asc_nulls_last()
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    least = F.rank().over(w.orderBy(by))
    if method == "dense":
        rank = F.dense_rank().over(w.orderBy(by))
    elif method == "min":
        rank = least
    elif method == "max":
        rank = least + ties - 1
    elif method == "average":
        rank = least + (ties - 1) / 2.0
    else:
        # ties at random: by a hash of the row, which a recomputation repeats
        rank = F.row_number().over(w.orderBy(by, *(ctx.order_by() if method == "ordinal" else [F.xxhash64(*[c(n) for n in columns])])))
    rank = rank if bucket is None else rank + F.coalesce(F.col(carry), F.lit(0))
    out = replace(df, new_column, F.when(x.isNotNull(), rank.cast("double" if method == "average" else "bigint")))
    return out if bucket is None else _reordered(out, columns, new_column)


def _reordered(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """The columns that were there and the new one, without helpers."""
    shown = [x for x in columns if not x.startswith(HIDDEN)]
    return df.select(*[c(x) for x in [*shown, *([target] if target not in columns else [])]], *[x for x in columns if x.startswith(HIDDEN)])


_AGGREGATES = {"first": None, "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count}


def _agg_params(p: dict[str, Any]) -> dict[str, Any]:
    if p["agg"] not in _AGGREGATES:
        raise ValueError(f"Unknown aggregate: {p['agg']}")
    return p


either = typed("column", "", is_numeric, is_datetime, must="must be numeric or datetime, got {}{}")


@operator(exists("column"), either, all_exist("group_by", "Group-by columns"), scope=grouped, group="group_by", ordered=lambda p: p["agg"] == "first", prepare=_agg_params)
def math_diff_from_agg(df: DataFrame, ctx: Context, column: str, agg: str, new_column: str, group_by: str | Sequence[str] | None = None) -> DataFrame:
    """The value less an aggregate of its group or of all rows; of dates and timestamps a duration."""
    x, keys, t = c(column), as_list(group_by), df.schema[column].dataType
    micros = is_timestamp(t) and agg in ("mean", "median")
    source = F.unix_micros(x.cast("timestamp")) if micros else x
    if keys and agg == "first":
        value = F.first(x).over(Window.partitionBy(*map(c, keys)).orderBy(*ctx.order_by()).rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(f"{HIDDEN}agg", value)
    elif keys:
        # aggregates are combined before the shuffle, and a join of a large group can be split; a window could not
        names = [f"{HIDDEN}k{i}" for i in range(len(keys))]
        groups = df.groupBy(*[c(k).alias(n) for k, n in zip(keys, names)]).agg(_AGGREGATES[agg](source).alias(f"{HIDDEN}agg"))
        same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
        df = df.join(groups, same, "left").drop(*names)
    elif agg == "median":
        df = df.withColumn(f"{HIDDEN}agg", F.lit(ctx.quantiles(df.select(source.alias(column)), f"math_diff_from_agg({column})", column, median=0.5)["median"]).cast("double"))
    else:
        if agg == "first":
            one = df.orderBy(*ctx.order_by()).limit(1).select(x.alias(f"{HIDDEN}agg")) if not ctx.dry else df.select(x.alias(f"{HIDDEN}agg"))
        else:
            one = df.agg(_AGGREGATES[agg](source).alias(f"{HIDDEN}agg"))
        df = df.join(F.broadcast(one), how="left")  # one row
    value = F.col(f"{HIDDEN}agg")
    if micros:
        return replace(df, new_column, F.make_dt_interval(secs=(source - value).cast("decimal(20,6)") / 1_000_000)).drop(f"{HIDDEN}agg")
    return replace(df, new_column, x - value).drop(f"{HIDDEN}agg")


#: Up to this lag the last rows of the ranges are broadcast, as their totals are; beyond it they are joined by a shuffle.
_SHORT_LAG = 16


@operator(exists("column"), either, all_exist("order_by", "Order-by columns"), all_exist("group_by", "Group-by columns"), scope=grouped, group="group_by", ordered=True, prepare=lambda p: p if p["lag"] >= 1 else _at_least_one())
def math_diff_lag(df: DataFrame, ctx: Context, column: str, order_by: str | list[str], new_column: str, group_by: str | Sequence[str] | None = None, lag: int = 1) -> DataFrame:
    """The value less the one ``lag`` rows before, in the given order; without groups rows are sorted so."""
    keys, x = as_list(order_by), c(column)
    if as_list(group_by):
        w = Window.partitionBy(*[c(g) for g in as_list(group_by)]).orderBy(*[c(k).asc_nulls_first() for k in keys], *ctx.order_by())
        return replace(df, new_column, x - F.lag(x, lag).over(w))
    df = ctx.declare(df, [(k, False) for k in keys])
    ctx.sorted = True
    bucket, columns = ctx.buckets(df), df.columns
    if bucket is None:
        return replace(df, new_column, x - F.lag(x, lag).over(Window.orderBy(*ctx.order_by())))
    # within ranges of the order; the first rows of a range look the last rows of the ranges before up by their number
    number, value, key, last = (f"{HIDDEN}{k}" for k in ("number", "value", "key", "last"))
    df, name = with_offsets(df, bucket, F.count(F.lit(1)), f"{HIDDEN}carry")
    w = Window.partitionBy(name).orderBy(*ctx.order_by())
    df = df.withColumn(number, F.row_number().over(w)).withColumn(value, F.lag(x, lag).over(w)).withColumn(last, F.lead(F.lit(1), lag).over(w).isNull())
    place = F.col(number) + F.coalesce(F.col(f"{HIDDEN}carry"), F.lit(0))
    tails = df.where(F.col(last)).select((place + lag).alias(key), x.alias(f"{HIDDEN}tail"))  # at most lag rows a range
    if lag <= _SHORT_LAG:
        tails = F.broadcast(tails)
    # rows that look nothing up have keys of their own, which no tail has: as nulls they would all meet in one task
    df = df.join(tails, F.when(F.col(number) <= lag, place).otherwise(-place) == F.col(key), "left")
    before = F.when(F.col(number) <= lag, F.col(f"{HIDDEN}tail")).otherwise(F.col(value))
    df = df.withColumn(f"{HIDDEN}out", x - before)
    return _reordered(replace(df, new_column, F.col(f"{HIDDEN}out")), columns, new_column)


def _at_least_one() -> dict[str, Any]:
    raise ValueError("lag must be at least 1")


def _derived(*given: str):
    """Global if any of the parameters is to be derived from the data."""
    return lambda p: Scope.GLOBAL if any(p[g] is None for g in given) else Scope.ROW


@operator(exists("column"), numeric, scope=_derived("mean", "std"))
def math_standardize(df: DataFrame, ctx: Context, column: str, mean: float | None = None, std: float | None = None, new_column: str | None = None) -> DataFrame:
    """(c - mean) / std, sample deviation; no or zero deviation gives 0 in every row."""
    x = c(column)
    if mean is None or std is None:
        found = ctx.stats(df, f"math_standardize({column})", mean=F.avg(x), std=F.stddev_samp(x))
        mean, std = (found["mean"] if mean is None else mean), (found["std"] if std is None else std)
    out = F.lit(0.0) if not std or mean is None else (x - F.lit(float(mean))) / F.lit(float(std))
    return replace(df, new_column or column, out)


@operator(exists("column"), numeric, scope=_derived("min_val", "max_val"), prepare=lambda p: p | {"feature_range": list(p["feature_range"])})
def math_minmax(df: DataFrame, ctx: Context, column: str, min_val: float | None = None, max_val: float | None = None, feature_range: Sequence[float] = (0, 1), new_column: str | None = None) -> DataFrame:
    """Scale to feature_range; a constant column becomes its middle in every row."""
    x, (a, b) = c(column), (float(v) for v in feature_range)
    if min_val is None or max_val is None:
        found = ctx.stats(df, f"math_minmax({column})", min=F.min(x), max=F.max(x))
        min_val, max_val = (found["min"] if min_val is None else min_val), (found["max"] if max_val is None else max_val)
    if min_val is None or max_val is None or min_val == max_val:
        return replace(df, new_column or column, F.lit((a + b) / 2))
    return replace(df, new_column or column, F.lit(a) + (x - F.lit(float(min_val))) * F.lit(b - a) / F.lit(float(max_val) - float(min_val)))


@operator(exists("column"), numeric, scope=_derived("median", "iqr"))
def math_robust_scale(df: DataFrame, ctx: Context, column: str, median: float | None = None, iqr: float | None = None, new_column: str | None = None) -> DataFrame:
    """(c - median) / (q75 - q25), quantiles interpolated linearly; no or zero range gives 0."""
    x = c(column)
    if median is None or iqr is None:
        found = ctx.quantiles(df, f"math_robust_scale({column})", column, q25=0.25, median=0.5, q75=0.75)
        if found["median"] is not None:
            median, iqr = (found["median"] if median is None else median), (found["q75"] - found["q25"] if iqr is None else iqr)
    out = F.lit(0.0) if not iqr or median is None else (x - F.lit(float(median))) / F.lit(float(iqr))
    return replace(df, new_column or column, out)


@operator(exists("column"), numeric)
def math_log(df: DataFrame, ctx: Context, column: str, base: float | None = None, offset: float = 0, new_column: str | None = None) -> DataFrame:
    """log(c + offset), natural by default; -inf at 0, NaN below."""
    return replace(df, new_column or column, ieee_log(c(column) + F.lit(offset), base))


@operator(exists("column"), numeric)
def math_sqrt(df: DataFrame, ctx: Context, column: str, new_column: str | None = None) -> DataFrame:
    """Square root; NaN below 0."""
    return replace(df, new_column or column, F.sqrt(c(column)))


@operator(exists("column"), numeric)
def math_power(df: DataFrame, ctx: Context, column: str, exponent: float, new_column: str | None = None) -> DataFrame:
    """c ** exponent as a double."""
    return replace(df, new_column or column, F.pow(c(column), F.lit(float(exponent))))


def _winsorize_scope(p: dict[str, Any]) -> Scope:
    return Scope.GLOBAL if any(p[q] is not None and p[f"{q}_value"] is None for q in ("lower", "upper")) else Scope.ROW


@operator(exists("column"), numeric, scope=_winsorize_scope)
def math_winsorize(df: DataFrame, ctx: Context, column: str, lower: float | None = None, upper: float | None = None, lower_value: float | None = None, upper_value: float | None = None, new_column: str | None = None) -> DataFrame:
    """Clip at quantiles (linear) or at given values, which win."""
    x = c(column)
    asked = {k: q for k, q, v in (("lower", lower, lower_value), ("upper", upper, upper_value)) if q is not None and v is None}
    found = ctx.quantiles(df, f"math_winsorize({column})", column, **asked) if asked else {}
    low, high = found.get("lower", lower_value), found.get("upper", upper_value)
    t = df.schema[column].dataType
    return replace(df, new_column or column, clamp(x.cast("double") if asked else x, low, high, T.DoubleType() if asked else t))
