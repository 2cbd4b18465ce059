"""The join operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import c, quote
from ..plans.context import HIDDEN, Context
from ..registry import Schema, Scope, as_list, operator


def _keys(p: dict[str, Any]) -> tuple[list[str], list[str]]:
    return as_list(p["left_on"]) or as_list(p["on"]), as_list(p["right_on"]) or as_list(p["on"])


def _params(p: dict[str, Any]) -> dict[str, Any]:
    if p["how"] not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', got {p['how']!r}")
    left, right = _keys(p)
    if len(left) != len(right) or not left:
        raise ValueError("as many right as left keys are needed")
    return p


def _left_problems(schema: Schema, p: dict[str, Any]) -> list[str]:
    return [f"Column '{k}' does not exist" for k in _keys(p)[0] if k not in schema]


@operator(_left_problems, scope=Scope.GLOBAL, prepare=_params)
def join(
    df: DataFrame,
    ctx: Context,
    on: str | Sequence[str],
    right_name: str,
    how: str = "inner",
    left_on: str | Sequence[str] | None = None,
    right_on: str | Sequence[str] | None = None,
    suffix: str = "_right",
    select_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join with a named reference table; right columns that clash get the suffix, null keys match nothing."""
    if right_name not in ctx.references:
        raise ValueError(f"Reference '{right_name}' not found. Available: {sorted(ctx.references)}")
    right = ctx.references[right_name]
    left_keys, right_keys = _keys({"on": on, "left_on": left_on, "right_on": right_on})
    missing = [x for x in [*right_keys, *(select_columns or [])] if x not in right.columns]
    if missing:
        raise ValueError(f"Column '{missing[0]}' does not exist in reference '{right_name}'")
    taken = [x for x in (right.columns if select_columns is None else select_columns) if x not in right_keys]
    names = [f"{HIDDEN}k{i}" for i in range(len(right_keys))]
    present = set(ctx.visible(df))
    out = [(x, f"{x}{suffix}" if x in present else x) for x in taken]
    side = right.select(*[c(k).alias(n) for k, n in zip(right_keys, names)], *[c(x).alias(n) for x, n in out])
    cond = reduce(and_, [F.col(f"l.{quote(k)}") == F.col(f"r.{n}") for k, n in zip(left_keys, names)])
    joined = df.alias("l").join(side.alias("r"), cond, how)
    return joined.select(*[F.col(f"l.{quote(x)}") for x in ctx.visible(df)], *[F.col(f"r.{quote(n)}") for _, n in out], *[F.col(f"l.{quote(x)}") for x in ctx.hidden(df)])
