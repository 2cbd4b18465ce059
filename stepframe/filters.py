"""Serialisable filter expressions: ``(Col("age") >= 18) & Col("name").is_not_null()``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .code import code
from .functions import c
from .types import is_datetime, is_numeric, is_string

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda x, v: x.isNull() if v is None else x == F.lit(v),
    "ne": lambda x, v: x.isNotNull() if v is None else x != F.lit(v),
    "gt": lambda x, v: x > F.lit(v),
    "ge": lambda x, v: x >= F.lit(v),
    "lt": lambda x, v: x < F.lit(v),
    "le": lambda x, v: x <= F.lit(v),
}
#: Type key -> names of its fields besides ``type``.
_FIELDS: dict[str, tuple[str, ...]] = {
    **{k: ("column", "value") for k in _COMPARE},
    "is_in": ("column", "values"),
    "between": ("column", "lower", "upper"),
    "is_null": ("column",),
    "is_not_null": ("column",),
    "str_contains": ("column", "pattern", "literal"),
    "str_starts_with": ("column", "prefix"),
    "str_ends_with": ("column", "suffix"),
    "and": ("left", "right"),
    "or": ("left", "right"),
    "not": ("operand",),
}


class Filter:
    """One node of a filter tree, kept as plain data."""

    __slots__ = ("fields", "type")
    __hash__ = None  # compared by content

    def __init__(self, kind: str, **fields: Any) -> None:
        if kind not in _FIELDS:
            raise ValueError(f"Unknown filter type: {kind}")
        if kind == "str_contains":
            fields.setdefault("literal", True)
        if missing := set(_FIELDS[kind]) - set(fields):
            raise ValueError(f"Filter '{kind}' lacks {sorted(missing)}")
        self.type = kind
        self.fields = {k: list(fields[k]) if k == "values" else fields[k] for k in _FIELDS[kind]}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Filter) and self.to_dict() == other.to_dict()

    def __repr__(self) -> str:
        f = self.fields
        if self.type in ("and", "or"):
            return f"({f['left']!r} {'&' if self.type == 'and' else '|'} {f['right']!r})"
        if self.type == "not":
            return f"~{f['operand']!r}"
        if self.type in _COMPARE:
            sign = {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}[self.type]
            return f"(Col({f['column']!r}) {sign} {code(f['value'])})"
        args = [code(v) if k != "literal" else f"literal={v!r}" for k, v in f.items() if k != "column"]
        return f"Col({f['column']!r}).{self.type}({', '.join(args)})"

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", left=self, right=other)

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", left=self, right=other)

    def __invert__(self) -> Filter:
        return Filter("not", operand=self)

    def __bool__(self) -> bool:
        raise TypeError("combine filters with &, | and ~")

    def to_dict(self) -> dict[str, Any]:
        return {"type": self.type, **{k: v.to_dict() if isinstance(v, Filter) else v for k, v in self.fields.items()}}

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Filter:
        if "type" not in data:
            raise ValueError("Missing 'type' in filter dict")
        fields = {k: Filter.from_dict(v) if k in ("left", "right", "operand") else v for k, v in data.items() if k != "type"}
        return Filter(data["type"], **fields)

    def nodes(self) -> Iterator[Filter]:
        yield self
        for v in self.fields.values():
            if isinstance(v, Filter):
                yield from v.nodes()

    def columns(self) -> set[str]:
        return {n.fields["column"] for n in self.nodes() if "column" in n.fields}

    def column(self) -> Column:
        """The predicate as a Spark column, three-valued as in SQL."""
        f = self.fields
        if self.type == "and":
            return f["left"].column() & f["right"].column()
        if self.type == "or":
            return f["left"].column() | f["right"].column()
        if self.type == "not":
            return ~f["operand"].column()
        x = c(f["column"])
        if self.type in _COMPARE:
            return _COMPARE[self.type](x, f["value"])
        if self.type == "is_in":
            return x.isin(f["values"]) if f["values"] else F.lit(False)
        if self.type == "between":
            return x.between(F.lit(f["lower"]), F.lit(f["upper"]))
        if self.type in ("is_null", "is_not_null"):
            return x.isNull() if self.type == "is_null" else x.isNotNull()
        if self.type == "str_contains":
            return F.contains(x, F.lit(f["pattern"])) if f["literal"] else x.rlike(f["pattern"])
        return F.startswith(x, F.lit(f["prefix"])) if self.type == "str_starts_with" else F.endswith(x, F.lit(f["suffix"]))

    def problems(self, schema: dict[str, T.DataType]) -> list[str]:
        out = []
        for n in self.nodes():
            if "column" not in n.fields:
                continue
            name = n.fields["column"]
            if name not in schema:
                out.append(f"Column '{name}' does not exist")
            elif n.type in ("gt", "ge", "lt", "le", "between") and not (is_numeric(schema[name]) or is_datetime(schema[name])):
                out.append(f"Column '{name}' is {schema[name].simpleString()}, cannot use numeric comparison")
            elif n.type.startswith("str_") and not is_string(schema[name]):
                out.append(f"Column '{name}' is {schema[name].simpleString()}, cannot use string filter")
        return out


class Col:
    """Start of a filter on one column."""

    __hash__ = None

    def __init__(self, name: str) -> None:
        self.name = name

    def __eq__(self, value: Any) -> Filter:  # type: ignore[override]
        return Filter("eq", column=self.name, value=value)

    def __ne__(self, value: Any) -> Filter:  # type: ignore[override]
        return Filter("ne", column=self.name, value=value)

    def __gt__(self, value: Any) -> Filter:
        return Filter("gt", column=self.name, value=value)

    def __ge__(self, value: Any) -> Filter:
        return Filter("ge", column=self.name, value=value)

    def __lt__(self, value: Any) -> Filter:
        return Filter("lt", column=self.name, value=value)

    def __le__(self, value: Any) -> Filter:
        return Filter("le", column=self.name, value=value)

    def is_in(self, values: Sequence[Any]) -> Filter:
        return Filter("is_in", column=self.name, values=values)

    def between(self, lower: Any, upper: Any) -> Filter:
        return Filter("between", column=self.name, lower=lower, upper=upper)

    def is_null(self) -> Filter:
        return Filter("is_null", column=self.name)

    def is_not_null(self) -> Filter:
        return Filter("is_not_null", column=self.name)

    def str_contains(self, pattern: str, *, literal: bool = True) -> Filter:
        return Filter("str_contains", column=self.name, pattern=pattern, literal=literal)

    def str_starts_with(self, prefix: str) -> Filter:
        return Filter("str_starts_with", column=self.name, prefix=prefix)

    def str_ends_with(self, suffix: str) -> Filter:
        return Filter("str_ends_with", column=self.name, suffix=suffix)


def all_of(filters: Sequence[Filter]) -> Filter:
    return reduce(lambda a, b: a & b, filters)
