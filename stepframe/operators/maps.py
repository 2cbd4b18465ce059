"""The 10 mapping and encoding operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c
from ..plans.context import HIDDEN, Context, replace
from ..registry import Schema, Scope, exists, operator, typed
from ..types import is_numeric

#: Entries up to which a mapping is a CASE expression; longer ones are joined.
CASE_LIMIT = 50


def _literal(value: Any) -> Column:
    return F.lit(value).cast("bigint") if type(value) is int and -(2**63) <= value < 2**63 else F.lit(value)


def lookup(df: DataFrame, column: str, pairs: list[tuple[Any, Any]], target: str, otherwise: Column | None) -> DataFrame:
    """First match wins, null matches nothing; ``otherwise`` (or null) where nothing matches.

    Long mappings become a left join with a literal table. It holds exactly the entries that the plan
    itself spells out, so its size has nothing to do with the data and it is broadcast.
    """
    first: dict[Any, Any] = {}
    for k, v in pairs:
        if k is not None:
            first.setdefault(k, v)
    other = F.lit(None) if otherwise is None else otherwise
    if not first:
        return replace(df, target, other)
    if len(first) <= CASE_LIMIT:
        case: Column | None = None
        for k, v in first.items():
            case = F.when(c(column) == F.lit(k), _literal(v)) if case is None else case.when(c(column) == F.lit(k), _literal(v))
        return replace(df, target, case.otherwise(other))
    key, value, hit = f"{HIDDEN}k", f"{HIDDEN}v", f"{HIDDEN}hit"
    table = df.sparkSession.createDataFrame(list(first.items()), _pair_schema(df.schema[column].dataType, list(first.values()), key, value)).withColumn(hit, F.lit(True))
    joined = df.join(F.broadcast(table), c(column) == F.col(key), "left")
    return replace(joined, target, F.when(F.col(hit), F.col(value)).otherwise(other)).drop(key, value, hit)


def _pair_schema(key_type: T.DataType, values: list[Any], key: str, value: str) -> T.StructType:
    kinds = {type(v) for v in values if v is not None}
    types = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    out = types[kinds.pop()] if len(kinds) == 1 and next(iter(kinds)) in types else T.DoubleType() if kinds == {int, float} else T.StringType()
    wide = T.LongType() if isinstance(key_type, T.IntegralType) else key_type
    return T.StructType([T.StructField(key, wide), T.StructField(value, out)])


def _pairs(p: dict[str, Any], name: str) -> dict[str, Any]:
    return p | {name: [tuple(x) for x in p[name]]}


@operator(exists("column"), each="column")
def map_values(df: DataFrame, ctx: Context, column: str, mapping: dict[Any, Any], default: Any = None, keep_unmapped: bool = True) -> DataFrame:
    """Replace values by a dict; what it lacks stays, or becomes the default. An empty dict changes nothing."""
    if not mapping:
        return df
    t = df.schema[column].dataType
    if isinstance(t, T.NumericType):
        # keys of the plain JSON form are strings
        mapping = {(_number(k) if isinstance(k, str) else k): v for k, v in mapping.items()}
    other = c(column) if keep_unmapped else F.lit(default)
    values = [v for v in mapping.values() if v is not None]
    if keep_unmapped and values and all(isinstance(v, str) for v in values):
        other = c(column).cast("string")
    return lookup(df, column, list(mapping.items()), column, other)


def _number(text: str) -> Any:
    try:
        return int(text)
    except ValueError:
        return float(text)


def _bins(p: dict[str, Any]) -> dict[str, Any]:
    bins = [float(b) if not isinstance(b, int) else b for b in p["bins"]]
    if sorted(bins) != bins:
        raise ValueError("bins must ascend")
    if p["labels"] is not None and len(p["labels"]) != len(bins) + 1:
        raise ValueError(f"{len(bins)} bins need {len(bins) + 1} labels")
    return p | {"bins": bins}


def bin_labels(bins: Sequence[float], right: bool) -> list[str]:
    edges = [-math.inf, *bins, math.inf]
    return [f"({a}, {b}]" if right else f"[{a}, {b})" for a, b in zip(edges, edges[1:])]


@operator(exists("column"), typed("column", "numeric", is_numeric), prepare=_bins)
def map_discretize(df: DataFrame, ctx: Context, column: str, bins: Sequence[float], labels: Sequence[str] | None = None, new_column: str | None = None, right: bool = True) -> DataFrame:
    """Labels of intervals between inner edges, the outer ones infinite; right-closed by default; null and NaN give null."""
    x, names = c(column), list(labels) if labels is not None else bin_labels(bins, right)
    case: Column = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(None).cast("string"))
    for edge, name in zip(bins, names):
        case = case.when(x <= F.lit(edge) if right else x < F.lit(edge), F.lit(name))
    return replace(df, new_column or column, case.otherwise(F.lit(names[-1])))


@operator(exists("column"), each="column")
def map_bool_to_int(df: DataFrame, ctx: Context, column: str) -> DataFrame:
    """Boolean to 0 and 1."""
    return df.withColumn(column, c(column).cast("bigint"))


@operator(exists("column"), each="column")
def map_null_to_value(df: DataFrame, ctx: Context, column: str, value: Any) -> DataFrame:
    """Null to a value."""
    return df.withColumn(column, F.coalesce(c(column), F.lit(value)))


@operator(exists("column"), each="column")
def map_value_to_null(df: DataFrame, ctx: Context, column: str, value: Any) -> DataFrame:
    """A value to null; None changes nothing."""
    if value is None:
        return df
    return df.withColumn(column, F.when(c(column) == F.lit(value), F.lit(None)).otherwise(c(column)))


@operator(exists("column"), prepare=lambda p: _pairs(p, "cases"))
def map_case(df: DataFrame, ctx: Context, column: str, cases: Sequence[tuple[Any, Any]], default: Any = None, new_column: str | None = None) -> DataFrame:
    """The value of the first case that equals, else the default."""
    return lookup(df, column, list(cases), new_column or column, _literal(default) if default is not None else None)


@operator(exists("column"), exists("lookup_column"), exists("value_column"), scope=Scope.GLOBAL, ordered=True)
def map_from_column(df: DataFrame, ctx: Context, column: str, lookup_column: str, value_column: str, new_column: str | None = None, default: Any = None) -> DataFrame:
    """Look a value up in the frame's own lookup and value columns; of repeated keys the last row counts."""
    key, value, hit = f"{HIDDEN}k", f"{HIDDEN}v", f"{HIDDEN}hit"
    place = F.struct(*[F.col(k.name) for k in ctx.order])
    plain = all(not k.descending and k.nulls_first for k in ctx.order)
    rows = df.where(c(lookup_column).isNotNull())
    if plain:
        table = rows.groupBy(c(lookup_column).alias(key)).agg(F.max_by(F.struct(c(value_column).alias("v")), place)["v"].alias(value))
    else:
        from pyspark.sql import Window

        w = Window.partitionBy(c(lookup_column)).orderBy(*ctx.order_by(reverse=True))
        table = rows.withColumn(hit, F.row_number().over(w)).where(F.col(hit) == 1).select(c(lookup_column).alias(key), c(value_column).alias(value))
    table = table.withColumn(hit, F.lit(True))
    joined = df.join(table, c(column) == F.col(key), "left")
    return replace(joined, new_column or column, F.when(F.col(hit), F.col(value)).otherwise(F.lit(default))).drop(key, value, hit)


#: Distinct values from which encodings are derived, at most: each is a column or a case of the plan.
MAX_CATEGORIES = 10_000


def categories_of(df: DataFrame, ctx: Context, column: str) -> list[Any]:
    if ctx.dry:
        return []
    rows = df.select(c(column)).where(c(column).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories in '{column}'")
    found = sorted(r[0] for r in rows)
    ctx.derived[f"categories({column})"] = {"categories": found}
    return found


def _category_problems(schema: Schema, p: dict[str, Any]) -> list[str]:
    found = p["categories"]
    out = []
    if found is not None and len(set(found)) != len(found):
        out.append("The categories list names a value more than once")
    drop = p.get("drop")
    if found is not None and drop is not None and drop not in found and drop not in ("first", "last"):
        out.append(f"Drop value '{drop}' not in categories list")
    if "prefix" in p and found is not None:
        out += [f"Column '{n}' already exists" for n in (f"{p['prefix'] or p['column']}_{v}" for v in found) if n in schema and n != p["column"]]
    return out


def _unknown(p: dict[str, Any]) -> dict[str, Any]:
    if p["unknown_value"] not in ("all_zero", "ignore"):
        raise ValueError("unknown_value must be 'all_zero' or 'ignore'")
    return p


_derives = lambda p: p["categories"] is None


@operator(exists("column"), _category_problems, scope=lambda p: Scope.GLOBAL if p["categories"] is None else Scope.ROW, open_schema=_derives, prepare=_unknown)
def map_onehot(
    df: DataFrame, ctx: Context, column: str, categories: list[Any] | None = None, prefix: str | None = None, drop: Any = None, drop_original: bool = True, unknown_value: str = "all_zero"
) -> DataFrame:
    """0/1 columns ``{prefix}_{category}``; ``drop``: a category, or first or last of them; others give zeros, or null with "ignore"."""
    found = categories if categories is not None else categories_of(df, ctx, column)
    if drop is None:
        kept = list(found)
    elif drop in found:  # a category of that name wins over the words first and last
        kept = [v for v in found if v != drop]
    else:
        kept = {"first": found[1:], "last": found[:-1]}.get(drop, list(found))
    x = c(column)
    known = F.coalesce(x.isin(list(found)), F.lit(False)) if found else F.lit(False)
    columns = []
    for v in kept:
        one = F.when(x == F.lit(v), 1).otherwise(0)
        one = F.when(known, one).otherwise(F.lit(None)) if unknown_value == "ignore" else one
        columns.append(one.cast("bigint").alias(f"{prefix or column}_{v}"))
    names = [n for n in df.columns if not n.startswith(HIDDEN) and (n != column or not drop_original or not found)]
    return ctx.select(df, *names, *columns)


def _ordinal(df: DataFrame, ctx: Context, column: str, categories: list[Any] | None, new_column: str | None, drop_original: bool, unknown_value: int) -> DataFrame:
    found = categories if categories is not None else categories_of(df, ctx, column)
    target = new_column or column
    df = lookup(df, column, [(v, i) for i, v in enumerate(found)], target, F.lit(unknown_value).cast("bigint"))
    return df.drop(c(column)) if target != column and drop_original and found else df


@operator(exists("column"), _category_problems, scope=lambda p: Scope.GLOBAL if p["categories"] is None else Scope.ROW)
def map_ordinal(df: DataFrame, ctx: Context, column: str, categories: list[Any] | None = None, new_column: str | None = None, drop_original: bool = True, unknown_value: int = -1) -> DataFrame:
    """Category to its index; unknown and null give unknown_value. A new column takes the place of the source."""
    return _ordinal(df, ctx, column, categories, new_column, drop_original, unknown_value)


@operator(exists("column"), _category_problems, scope=lambda p: Scope.GLOBAL if p["categories"] is None else Scope.ROW)
def map_label(df: DataFrame, ctx: Context, column: str, categories: list[Any] | None = None, new_column: str | None = None, drop_original: bool = True, unknown_value: int = -1) -> DataFrame:
    """The same as map_ordinal."""
    return _ordinal(df, ctx, column, categories, new_column, drop_original, unknown_value)
