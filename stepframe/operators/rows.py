"""The 13 row operators."""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..filters import Filter
from ..functions import c, quote
from ..plans.context import HIDDEN, Context, Key, replace
from ..registry import Schema, Scope, all_exist, as_list, exists, is_new, operator, typed
from ..types import is_list
from .column import not_null


def _filter(p: dict[str, Any]) -> dict[str, Any]:
    return p | {"filter": Filter.from_dict(p["filter"]) if isinstance(p["filter"], dict) else p["filter"]}


def _filter_problems(schema: Schema, p: dict[str, Any]) -> list[str]:
    return p["filter"].problems(schema)


@operator(all_exist("columns"))
def rows_drop_nulls(df: DataFrame, ctx: Context, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Drop rows with null in any of the columns (of all columns by default)."""
    return df.filter(not_null(as_list(columns) or ctx.visible(df)))


def _keep(*allowed: str):
    def prepare(p: dict[str, Any]) -> dict[str, Any]:
        if p["keep"] not in allowed:
            raise ValueError(f"keep must be one of {allowed}, got {p['keep']!r}")
        return p

    return prepare


@operator(all_exist("columns"), scope=lambda p: Scope.GROUP if p["columns"] else Scope.GLOBAL, group="columns", ordered=lambda p: p["keep"] in ("first", "last"), prepare=_keep("first", "last", "any", "none"))
def rows_unique(df: DataFrame, ctx: Context, columns: str | Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """Distinct rows by key (all columns by default): the first, the last, any, or only keys that occur once."""
    keys = as_list(columns) or ctx.visible(df)
    if keep == "any":
        return df.dropDuplicates(keys)
    w, mark = Window.partitionBy(*[c(k) for k in keys]), f"{HIDDEN}mark"
    value = F.count(F.lit(1)).over(w) if keep == "none" else F.row_number().over(w.orderBy(*ctx.order_by(reverse=keep == "last")))
    return df.withColumn(mark, value).filter(F.col(mark) == 1).drop(mark)


@operator(_filter_problems, prepare=_filter)
def rows_filter(df: DataFrame, ctx: Context, filter: Filter) -> DataFrame:
    """Keep the rows that match."""
    return df.filter(filter.column())


@operator(_filter_problems, prepare=_filter)
def rows_drop(df: DataFrame, ctx: Context, filter: Filter) -> DataFrame:
    """Keep NOT filter: rows for which it is unknown (null) go as well."""
    return df.filter(~filter.column())


@operator(all_exist("columns"), exists("sort_by", "Sort column"), scope=Scope.GROUP, group="columns", ordered=True, prepare=_keep("first", "last"))
def rows_deduplicate(df: DataFrame, ctx: Context, columns: str | Sequence[str], sort_by: str, keep: str = "first", descending: bool = False) -> DataFrame:
    """The first or last row of each key in the order of one column (ties: row order); rows are left in that order."""
    df = ctx.declare(df, [(sort_by, descending)])
    ctx.sorted = True
    w, mark = Window.partitionBy(*[c(k) for k in as_list(columns)]).orderBy(*ctx.order_by(reverse=keep == "last")), f"{HIDDEN}mark"
    return df.withColumn(mark, F.row_number().over(w)).filter(F.col(mark) == 1).drop(mark)


@operator(exists("column"), typed("column", "List", is_list))
def rows_explode(df: DataFrame, ctx: Context, column: str) -> DataFrame:
    """One row for each element; an empty or null list gives one row with null."""
    position, value = ctx.fresh(), f"{HIDDEN}value"
    out = df.select(*[c(n) for n in df.columns if n != column], F.posexplode_outer(c(column)).alias(position, value))
    if ctx.order:
        ctx.order = [*ctx.order, Key(position)]
    else:
        out = out.drop(position)
    return out.select(*[F.col(value).alias(column) if n == column else c(n) for n in df.columns], *([position] if ctx.order else []))


@operator(all_exist("id_columns", "ID columns"), all_exist("value_columns", "Value columns"))
def rows_melt(df: DataFrame, ctx: Context, id_columns: Sequence[str], value_columns: Sequence[str], variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long, nulls kept; columns that are not listed go."""
    ids = [*as_list(id_columns), *ctx.hidden(df)]
    values = as_list(value_columns)
    out = df.unpivot([c(x) for x in ids], [c(x) for x in values], variable_name, value_name)
    if ctx.order:
        position = ctx.fresh()
        out = out.withColumn(position, F.array_position(F.array(*[F.lit(v) for v in values]), c(variable_name)))
        ctx.order = [*ctx.order, Key(position)]
    return out


def _sample_params(p: dict[str, Any]) -> dict[str, Any]:
    if (p["n"] is None) == (p["fraction"] is None):
        raise ValueError("Exactly one of n and fraction must be given")
    # a fixed seed in the step makes the plan repeatable
    return p | {"seed": random.randrange(2**31) if p["seed"] is None else p["seed"]}


@operator(scope=Scope.GLOBAL, prepare=_sample_params, barrier=True)
def rows_sample(df: DataFrame, ctx: Context, n: int | None = None, fraction: float | None = None, seed: int | None = None) -> DataFrame:
    """Exactly n rows, or the exact fraction of all: those of least hash of the row and the seed.

    The hash at which the sample ends is found by counting 16 bits of it at a time, so the sample is a filter
    and no task sorts rows. Of equal rows at the very end, the first ones of the first tasks are taken.
    """
    if ctx.dry:
        return df
    shown = ctx.visible(df)
    parts = [F.xxhash64(c(x).isNull(), F.to_json(F.struct(c(x))) if isinstance(df.schema[x].dataType, T.MapType) else c(x)) for x in shown]
    name, place, part, take = (f"{HIDDEN}{k}" for k in ("hash", "place", "part", "take"))
    hashed = df.withColumn(name, F.xxhash64(F.lit(seed), *parts))
    h, held, known, wanted = F.col(name), hashed, None, n
    for shift in (48, 32):
        cell = F.shiftright(h, shift)
        counts = sorted((r.cell, r.n) for r in held.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 65536
        if wanted is None:
            wanted = int(sum(x for _, x in counts) * fraction)
        known, held, wanted, all_in = _border(held, counts, cell, wanted)
        if all_in:
            return df
    counts = sorted((r[0], r[1]) for r in held.groupBy(h).count().collect())  # what shares 32 bits
    last, tied, wanted, _ = _border(held, counts, h, wanted)
    if wanted == 0:
        return hashed.where(h < F.lit(last)).drop(name)
    # some of the rows that share the last hash: so many from each task
    at = F.when(h == F.lit(last), F.monotonically_increasing_id())
    task = F.shiftright(F.monotonically_increasing_id(), 33)
    ends = sorted((r[part], r["n"]) for r in hashed.withColumn(part, task).where(h == F.lit(last)).groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a task
    left, rows = wanted, []
    for p, k in ends:
        rows.append((p, min(left, k)))
        left -= rows[-1][1]
    quota = df.sparkSession.createDataFrame(rows, f"{part} long, {take} long")
    numbered = hashed.where(h <= F.lit(last)).withColumn(part, task)
    ties = numbered.where(h == F.lit(last)).withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(at)))
    ties = ties.join(F.broadcast(quota), part).where(F.col(place) <= F.col(take))
    return numbered.where(h < F.lit(last)).unionByName(ties.drop(place, take)).drop(name, part)


def _border(held: DataFrame, counts: list[tuple[int, int]], cell: Column, wanted: int) -> tuple[int, DataFrame, int, bool]:
    """The cell in which ``wanted`` rows are reached, its rows, how many of them to take; and whether all rows are wanted."""
    before = 0
    for k, n in counts:
        if before + n > wanted:
            return k, held.where(cell == F.lit(k)), wanted - before, False
        before += n
    return 0, held, wanted, True


@operator(scope=Scope.GLOBAL, ordered=True, barrier=True)
def rows_head(df: DataFrame, ctx: Context, n: int = 5) -> DataFrame:
    """The first n rows."""
    ctx.sorted = True
    return df.orderBy(*ctx.order_by()).limit(n)


@operator(scope=Scope.GLOBAL, ordered=True, barrier=True)
def rows_tail(df: DataFrame, ctx: Context, n: int = 5) -> DataFrame:
    """The last n rows, in their order."""
    ctx.sorted = True
    return df.orderBy(*ctx.order_by(reverse=True)).limit(n)


def _sort_params(p: dict[str, Any]) -> dict[str, Any]:
    by, down = as_list(p["by"]), p["descending"]
    down = [bool(down)] * len(by) if isinstance(down, bool) else [bool(x) for x in down]
    if len(down) != len(by):
        raise ValueError("descending must be one flag or one for each column")
    return p | {"by": by, "descending": down}


@operator(all_exist("by"), scope=Scope.GLOBAL, prepare=_sort_params, barrier=True)
def rows_sort(df: DataFrame, ctx: Context, by: str | Sequence[str], descending: bool | Sequence[bool] = False) -> DataFrame:
    """Sort; nulls first in either direction, ties in the order before. The sort itself is done once, at the end."""
    ctx.sorted = True
    return ctx.declare(df, list(zip(by, descending)))


@operator(_filter_problems, is_new("new_column"), prepare=_filter)
def rows_flag(df: DataFrame, ctx: Context, filter: Filter, new_column: str, true_value: Any = True, false_value: Any = False) -> DataFrame:
    """A column that tells whether the row matches; unknown counts as no."""
    return replace(df, new_column, F.when(filter.column(), F.lit(true_value)).otherwise(F.lit(false_value)))


_PIVOT = {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count}


def _pivot_params(p: dict[str, Any]) -> dict[str, Any]:
    if p["aggregate_function"] not in ("first", *_PIVOT):
        raise ValueError(f"Unknown aggregate function: {p['aggregate_function']}")
    return p


@operator(
    all_exist("index", "Index columns"),
    exists("columns", "Pivot column"),
    exists("values", "Values column"),
    scope=Scope.GLOBAL,
    ordered=lambda p: p["aggregate_function"] == "first",
    open_schema=True,
    prepare=_pivot_params,
)
def rows_pivot(df: DataFrame, ctx: Context, index: str | Sequence[str], columns: str, values: str, aggregate_function: str = "first") -> DataFrame:
    """Long to wide; new columns in ascending order of the pivot values, count 0 and else null where nothing is."""
    keys = as_list(index)
    if ctx.dry:
        found: list[Any] = []
    else:
        found = sorted((r[0] for r in df.select(c(columns)).where(c(columns).isNotNull()).distinct().limit(10_001).collect()), key=lambda v: (str(type(v)), v))  # columns of the result
        if len(found) > 10_000:
            raise ValueError("a pivot makes at most 10000 columns")
    x = c(values)
    agg = F.min_by(x, F.struct(*[F.col(k.name) for k in ctx.order])) if aggregate_function == "first" and all(not k.descending and k.nulls_first for k in ctx.order) else None
    if aggregate_function == "first" and agg is None:
        w = Window.partitionBy(*[c(k) for k in keys], c(columns)).orderBy(*ctx.order_by())
        df = df.withColumn(f"{HIDDEN}mark", F.row_number().over(w)).filter(F.col(f"{HIDDEN}mark") == 1)
        agg = F.first(x)
    agg = _PIVOT[aggregate_function](x) if agg is None else agg
    if ctx.dry or not found:
        out = df.select(*[c(k) for k in keys]).distinct()
    else:
        out = df.groupBy(*[c(k) for k in keys]).pivot(quote(columns), found).agg(agg)
        out = out.toDF(*keys, *[_label(v) for v in found])
        if aggregate_function == "count":
            out = out.select(*[c(k) for k in keys], *[F.coalesce(c(n), F.lit(0)).alias(n) for n in out.columns[len(keys) :]])
    ctx.order, ctx.sorted = [], False
    return ctx.declare(out, [(k, False) for k in keys])


def _label(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)
