"""The one registry of operators: how each is built, checked, lowered, and which rows it needs together."""

from __future__ import annotations

import enum
import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Schema = dict[str, T.DataType]
Check = Callable[[Schema, dict[str, Any]], list[str]]


class Scope(enum.Enum):
    """Which rows an operator must see together."""

    ROW = "row"
    GROUP = "group"
    GLOBAL = "global"


@dataclass(frozen=True)
class Operator:
    name: str
    lower: Callable[..., DataFrame]
    scope: Callable[[dict[str, Any]], Scope]
    group_param: str | None
    each: str | None
    ordered: Callable[[dict[str, Any]], bool]
    open_schema: Callable[[dict[str, Any]], bool]
    checks: tuple[Check, ...]
    prepare: Callable[[dict[str, Any]], dict[str, Any]] | None
    barrier: bool

    @property
    def signature(self) -> inspect.Signature:
        """The builder's signature: that of the lowering without the frame and the context."""
        return inspect.Signature(list(inspect.signature(self.lower).parameters.values())[2:])

    def bind(self, *args: Any, **kwargs: Any) -> dict[str, Any]:
        bound = self.signature.bind(*args, **kwargs)
        bound.apply_defaults()
        return dict(bound.arguments)

    def problems(self, schema: Schema, params: dict[str, Any]) -> list[str]:
        return [m for check in self.checks for m in check(schema, params)]


REGISTRY: dict[str, Operator] = {}


def _always(value: Any) -> Callable[[dict[str, Any]], Any]:
    return value if callable(value) else lambda params: value


def operator(
    *checks: Check,
    scope: Scope | Callable[[dict[str, Any]], Scope] = Scope.ROW,
    group: str | None = None,
    each: str | None = None,
    ordered: bool | Callable[[dict[str, Any]], bool] = False,
    open_schema: bool | Callable[[dict[str, Any]], bool] = False,
    prepare: Callable[[dict[str, Any]], dict[str, Any]] | None = None,
    barrier: bool = False,
) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a lowering ``f(df, ctx, <parameters>)`` under its name.

    each: the parameter that may be a sequence, one step for each entry. group: the parameter that names
    the group's columns. ordered: whether the result depends on row order. open_schema: whether the
    output columns depend on data. barrier: whether audited counts below it need an action first.
    """

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[f.__name__] = Operator(f.__name__, f, _always(scope), group, each, _always(ordered), _always(open_schema), checks, prepare, barrier)
        return f

    return register


def as_list(value: str | Sequence[str] | None) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def exists(param: str, label: str = "Column") -> Check:
    def check(schema: Schema, params: dict[str, Any]) -> list[str]:
        name = params[param]
        return [] if name is None or name in schema else [f"{label} '{name}' does not exist"]

    return check


def all_exist(param: str, label: str = "Columns") -> Check:
    def check(schema: Schema, params: dict[str, Any]) -> list[str]:
        missing = [x for x in as_list(params[param]) if x not in schema]
        return [f"{label} do not exist: {missing}"] if missing else []

    return check


def is_new(param: str) -> Check:
    def check(schema: Schema, params: dict[str, Any]) -> list[str]:
        return [f"Column '{params[param]}' already exists"] if params[param] in schema else []

    return check


def typed(param: str, expected: str, *tests: Callable[[T.DataType], bool], must: str = "is {}, expected {}") -> Check:
    """The column named by ``param`` passes one of ``tests``; a missing column is reported elsewhere."""

    def check(schema: Schema, params: dict[str, Any]) -> list[str]:
        t = schema.get(params[param])
        return [] if t is None or any(f(t) for f in tests) else [f"Column '{params[param]}' {must.format(t.simpleString(), expected)}"]

    return check
