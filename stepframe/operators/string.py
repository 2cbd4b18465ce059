"""The 10 string operators."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import c, strip_blank
from ..plans.context import Context, replace
from ..registry import Schema, all_exist, as_list, exists, operator, typed
from ..types import is_string

text = typed("column", "string", is_string)


def java_replacement(replacement: str) -> str:
    """``$1`` and ``${1}`` are groups; any other dollar sign and every backslash stand for themselves."""
    out, at = "", 0
    for m in re.finditer(r"\$\{(\d+)\}|\$(\d+)|\$\$|[$\\]", replacement):
        out += replacement[at : m.start()]
        group = m[1] or m[2]
        out += f"${group}" if group else "\\$" if m[0] in ("$", "$$") else "\\\\"
        at = m.end()
    return out + replacement[at:]


@operator(exists("column"), text, each="column")
def str_replace(df: DataFrame, ctx: Context, column: str, pattern: str, replacement: str, literal: bool = True) -> DataFrame:
    """Replace every occurrence of a literal (default) or of a regular expression."""
    x = c(column)
    if literal:
        return df.withColumn(column, F.replace(x, F.lit(pattern), F.lit(replacement)) if pattern else x)
    return df.withColumn(column, F.regexp_replace(x, pattern, java_replacement(replacement)))


@operator(exists("column"), text, each="column")
def str_slice(df: DataFrame, ctx: Context, column: str, offset: int, length: int | None = None) -> DataFrame:
    """A part from a 0-based offset; negative offsets count from the end."""
    x = c(column)
    n = F.lit(2**31 - 1 - abs(offset)) if length is None else F.lit(length)
    if offset >= 0:
        return df.withColumn(column, F.substring(x, F.lit(offset + 1), n))
    # an offset before the start takes its part of the length with it
    start = F.greatest(F.length(x) + offset, F.lit(0))
    missing = start - (F.length(x) + offset)
    return df.withColumn(column, F.substring(x, start + 1, F.greatest(n - missing, F.lit(0))))


def _truncate_params(p: dict[str, Any]) -> dict[str, Any]:
    if len(p["suffix"]) > p["max_length"]:
        raise ValueError("suffix is longer than max_length")
    return p


@operator(exists("column"), text, each="column", prepare=_truncate_params)
def str_truncate(df: DataFrame, ctx: Context, column: str, max_length: int, suffix: str = "...") -> DataFrame:
    """Cut what is longer than max_length and end it with the suffix."""
    x = c(column)
    cut = F.concat(F.substring(x, 1, max_length - len(suffix)), F.lit(suffix))
    return df.withColumn(column, F.when(F.length(x) > max_length, cut).otherwise(x))


def _split_problems(schema: Schema, p: dict[str, Any]) -> list[str]:
    return [f"Column '{n}' already exists" for n in p["new_columns"] or [] if n in schema and (n != p["column"] or p["keep_original"])]


@operator(exists("column"), text, _split_problems)
def str_split(df: DataFrame, ctx: Context, column: str, separator: str, new_columns: list[str] | None = None, keep_original: bool = False) -> DataFrame:
    """Split at a literal: into rows, or into the given columns (null where there is no such part)."""
    parts = F.split(c(column), "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    if new_columns is None:
        from .rows import rows_explode

        return rows_explode(df.withColumn(column, parts), ctx, column)
    for i, name in enumerate(new_columns):
        df = replace(df, name, F.get(parts, F.lit(i))) if name != column else df
    if column in new_columns:
        return df.withColumn(column, F.get(parts, F.lit(new_columns.index(column))))
    return df if keep_original else df.drop(c(column))


@operator(exists("column"), text, each="column")
def str_lower(df: DataFrame, ctx: Context, column: str) -> DataFrame:
    """Lower case."""
    return df.withColumn(column, F.lower(c(column)))


@operator(exists("column"), text, each="column")
def str_upper(df: DataFrame, ctx: Context, column: str) -> DataFrame:
    """Upper case."""
    return df.withColumn(column, F.upper(c(column)))


@operator(exists("column"), text, each="column")
def str_strip(df: DataFrame, ctx: Context, column: str, chars: str | None = None) -> DataFrame:
    """Strip white space, or the given characters, at both ends."""
    x = c(column)
    return df.withColumn(column, strip_blank(x) if chars is None else F.btrim(x, F.lit(chars)))


def _pad_params(p: dict[str, Any]) -> dict[str, Any]:
    if len(p["fill_char"]) != 1:
        raise ValueError("fill_char must be one character")
    return p


@operator(exists("column"), text, each="column", prepare=_pad_params)
def str_pad(df: DataFrame, ctx: Context, column: str, length: int, fill_char: str = " ", side: str = "left") -> DataFrame:
    """Pad to a length; longer strings stay as they are."""
    x: Column = c(column)
    padded = (F.lpad if side == "left" else F.rpad)(x, length, fill_char)
    return df.withColumn(column, F.when(F.length(x) < length, padded).otherwise(x))


@operator(all_exist("columns"))
def str_concat(df: DataFrame, ctx: Context, columns: Sequence[str], new_column: str, separator: str = "") -> DataFrame:
    """Join the values with a separator; null if any of them is."""
    parts: list[Column] = []
    for name in as_list(columns):
        parts += [*([F.lit(separator)] if parts and separator else []), c(name).cast("string")]
    return replace(df, new_column, F.concat(*parts))


@operator(exists("column"), text)
def str_extract(df: DataFrame, ctx: Context, column: str, pattern: str, group_index: int = 1, new_column: str | None = None) -> DataFrame:
    """A group of the first match; null without a match."""
    x = c(column)
    return replace(df, new_column or column, F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group_index)))
