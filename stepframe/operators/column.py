"""The 14 column operators."""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c
from ..plans.context import HIDDEN, Context, replace
from ..registry import Scope, all_exist, as_list, exists, is_new, operator
from ..types import CANONICAL, canonical


def not_null(columns: Sequence[str]) -> Column:
    """All columns hold a value; NaN is one."""
    cond = F.lit(True)
    for x in columns:
        cond = cond & c(x).isNotNull()
    return cond


@operator(exists("column"), each="column")
def col_drop(df: DataFrame, ctx: Context, column: str) -> DataFrame:
    """Drop a column."""
    return df.drop(c(column))


@operator(exists("column"), is_new("new_name"))
def col_rename(df: DataFrame, ctx: Context, column: str, new_name: str) -> DataFrame:
    """Rename a column in its place."""
    return df.withColumnsRenamed({column: new_name})


@operator(exists("column"), each="column", prepare=lambda p: p | {"dtype": canonical(p["dtype"])})
def col_cast(df: DataFrame, ctx: Context, column: str, dtype: str | type) -> DataFrame:
    """Cast to a canonical type; bad input raises, as do values outside an unsigned range."""
    spark, bounds = CANONICAL[dtype]
    x = c(column).cast(spark)
    if bounds:
        low, high = (F.lit(b).cast(T.DecimalType(20, 0)) for b in bounds)
        wide = c(column).cast(T.DecimalType(38, 0))
        x = F.when(wide.isNull() | wide.between(low, high), x).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {dtype}: "), c(column).cast("string"))))
    return df.withColumn(column, x)


@operator(all_exist("columns"))
def col_reorder(df: DataFrame, ctx: Context, columns: Sequence[str]) -> DataFrame:
    """The listed columns in that order; others are dropped."""
    return ctx.select(df, *columns)


@operator(all_exist("columns"))
def col_select(df: DataFrame, ctx: Context, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns in that order."""
    return ctx.select(df, *columns)


@operator(exists("column"), is_new("new_name"))
def col_duplicate(df: DataFrame, ctx: Context, column: str, new_name: str) -> DataFrame:
    """Copy a column under a new name."""
    return replace(df, new_name, c(column))


_FILLS = ("forward", "backward", "min", "max", "mean", "zero")


def _fill_params(p: dict[str, Any]) -> dict[str, Any]:
    if p["strategy"] is not None and p["strategy"] not in _FILLS:
        raise ValueError(f"Unknown fill strategy: {p['strategy']}")
    if p["strategy"] is None and p["value"] is None:
        raise ValueError("Either value or strategy must be given")
    return p


@operator(
    exists("column"),
    each="column",
    scope=lambda p: Scope.ROW if p["strategy"] in (None, "zero") else Scope.GLOBAL,
    ordered=lambda p: p["strategy"] in ("forward", "backward"),
    prepare=_fill_params,
)
def col_fill_null(df: DataFrame, ctx: Context, column: str, value: Any = None, strategy: str | None = None) -> DataFrame:
    """Fill nulls by a value or by a strategy: forward, backward, min, max, mean or zero."""
    x, t = c(column), df.schema[column].dataType
    if strategy is None:
        return df.withColumn(column, F.coalesce(x, F.lit(value)))
    if strategy == "zero":
        return df.withColumn(column, F.coalesce(x, F.lit(0).cast(t)))
    if strategy in ("min", "max", "mean"):
        found = ctx.stats(df, f"col_fill_null({column})", **{strategy: {"min": F.min, "max": F.max, "mean": F.avg}[strategy](x)})[strategy]
        filler = F.lit(found) if strategy != "mean" else F.lit(found).cast("double")
        return df.withColumn(column, F.coalesce(x, filler if found is not None else F.lit(None).cast(t if strategy != "mean" else "double")))
    back = strategy == "backward"
    bucket = ctx.buckets(df)
    if bucket is None:
        w = Window.orderBy(*ctx.order_by(reverse=back)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(column, F.last(x, ignorenulls=True).over(w))
    # within ranges of the order; what a range starts without comes from the ranges before
    name = f"{HIDDEN}bucket"
    df = df.withColumn(name, bucket)
    w = Window.partitionBy(name).orderBy(*ctx.order_by(reverse=back)).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*[F.col(k.name) for k in ctx.order])
    plain = all(not k.descending and k.nulls_first for k in ctx.order)
    if plain:
        pick = F.min_by if back else F.max_by
        last = df.where(x.isNotNull()).groupBy(name).agg(pick(x, place).alias(f"{HIDDEN}last"))
    else:
        ranked = df.where(x.isNotNull()).withColumn(f"{HIDDEN}rn", F.row_number().over(Window.partitionBy(name).orderBy(*ctx.order_by(reverse=not back))))
        last = ranked.where(F.col(f"{HIDDEN}rn") == 1).select(name, x.alias(f"{HIDDEN}last"))
    every = df.select(name).distinct().join(last, name, "left")  # one row a bucket
    before = Window.orderBy(F.col(name).desc() if back else F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(name, F.last(f"{HIDDEN}last", ignorenulls=True).over(before).alias(f"{HIDDEN}carried"))
    columns = [x for x in df.columns if x != name]
    df = df.withColumn(column, F.last(x, ignorenulls=True).over(w)).join(F.broadcast(carried), name)
    return df.withColumn(column, F.coalesce(c(column), F.col(f"{HIDDEN}carried"))).select(*[c(x) for x in columns])


@operator(all_exist("columns"))
def col_drop_null(df: DataFrame, ctx: Context, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Drop rows with null in any of the columns (of all columns by default)."""
    return df.filter(not_null(as_list(columns) or ctx.visible(df)))


@operator(exists("column"), each="column")
def col_drop_zero(df: DataFrame, ctx: Context, column: str) -> DataFrame:
    """Keep rows whose value is not zero; null rows go as well."""
    return df.filter(c(column) != 0)


def _added(schema: dict[str, T.DataType], p: dict[str, Any]) -> list[str]:
    return [] if p["expr"] is None or not isinstance(p["expr"], str) or p["expr"] in schema else [f"Source column '{p['expr']}' does not exist"]


@operator(is_new("new_column"), _added)
def col_add(df: DataFrame, ctx: Context, new_column: str, expr: str | float | None = None, value: Any = None) -> DataFrame:
    """Add a constant (``value``, or a number as ``expr``), or a copy of the column named ``expr``."""
    if isinstance(expr, str):
        return replace(df, new_column, c(expr))
    constant = value if expr is None else expr
    # Python integers are 64 bits wide, here as in cast targets
    x = F.lit(constant).cast("bigint") if type(constant) is int and -(2**63) <= constant < 2**63 else F.lit(constant)
    return replace(df, new_column, x if constant is not None else F.lit(None).cast("string"))


def _uuid_params(p: dict[str, Any]) -> dict[str, Any]:
    if p["length"] < 1:
        raise ValueError("length must be positive")
    # kept in the step: a lost partition is then computed again with the same ids
    return p | {"seed": random.randrange(2**31) if p["seed"] is None else p["seed"]}


@operator(is_new("column"), prepare=_uuid_params)
def col_add_uuid(df: DataFrame, ctx: Context, column: str, length: int = 16, seed: int | None = None) -> DataFrame:
    """A random alphanumeric id for each row; the step keeps the seed, so that a lost task draws the same ones again."""
    return replace(df, column, F.randstr(F.lit(length), F.lit(seed)))


@operator(all_exist("columns"), is_new("new_column"))
def col_hash(df: DataFrame, ctx: Context, columns: str | Sequence[str], new_column: str, salt: str = "") -> DataFrame:
    """16 hex digits of the SHA-256 of the "|"-joined values (null: empty) and the salt."""
    parts = [F.coalesce(c(x).cast("string"), F.lit("")) for x in as_list(columns)]
    joined = parts[0]
    for x in parts[1:]:
        joined = F.concat(joined, F.lit("|"), x)
    return replace(df, new_column, F.substring(F.sha2(F.concat(joined, F.lit(salt)), 256), 1, 16))


@operator(all_exist("columns"))
def col_coalesce(df: DataFrame, ctx: Context, columns: Sequence[str], new_column: str) -> DataFrame:
    """The first value that is not null."""
    return replace(df, new_column, F.coalesce(*[c(x) for x in columns]))


@operator(is_new("new_column"))
def col_expr(df: DataFrame, ctx: Context, new_column: str, expr: str, dtype: str | None = None) -> DataFrame:
    """A SQL scalar expression; its type is found by analysis, ``dtype`` is only a note."""
    return replace(df, new_column, F.expr(expr))


