"""Validation and dry runs: declarative checks, and exact schemas by lowering steps on an empty frame."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..filters import Filter
from ..registry import REGISTRY, Scope
from ..steps import Step, encode
from .context import HIDDEN, Context


class SchemaValidationError(ValueError):
    """A plan that doesn't fit a schema."""


@dataclass(frozen=True)
class ValidationError:
    """What is wrong with one step."""

    step: int
    operation: str
    message: str

    def __str__(self) -> str:
        return f"Step {self.step} ({self.operation}): {self.message}"


@dataclass
class Validation:
    """All that is wrong; ``warnings`` don't make a plan invalid."""

    errors: list[ValidationError | str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def add_error(self, step: int, operation: str, message: str) -> None:
        self.errors.append(ValidationError(step, operation, message))

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def raise_if_invalid(self) -> None:
        if self.errors:
            raise SchemaValidationError(f"the plan has {len(self.errors)} error(s):\n" + "\n".join(map(str, self.errors)))

    def __bool__(self) -> bool:
        return self.is_valid

    def __str__(self) -> str:
        return "valid" if self.is_valid else "\n".join(map(str, self.errors))


@dataclass
class ChunkValidation(Validation):
    """Also says which steps need the whole table, and which need whole groups (by what columns)."""

    global_operations: list[str] = field(default_factory=list)
    group_dependent_ops: list[tuple[str, list[str] | None]] = field(default_factory=list)


@dataclass
class DryRunStep:
    number: int
    operation: str
    schema_before: dict[str, str]
    schema_after: dict[str, str]
    error: str | None = None
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def step(self) -> int:
        return self.number

    @property
    def columns_added(self) -> list[str]:
        return [x for x in self.schema_after if x not in self.schema_before]

    @property
    def columns_removed(self) -> list[str]:
        return [x for x in self.schema_before if x not in self.schema_after]

    @property
    def columns_modified(self) -> list[str]:
        return [x for x, t in self.schema_after.items() if self.schema_before.get(x, t) != t]


@dataclass
class DryRun:
    steps: list[DryRunStep]
    errors: list[ValidationError]
    input_schema: dict[str, str] = field(default_factory=dict)

    @property
    def is_valid(self) -> bool:
        return not self.errors

    @property
    def output_schema(self) -> dict[str, str]:
        return self.steps[-1].schema_after if self.steps else self.input_schema

    @property
    def input_columns(self) -> list[str]:
        return list(self.input_schema)

    @property
    def output_columns(self) -> list[str]:
        return list(self.output_schema)

    def summary(self, *, show_params: bool = True, show_schema: bool = False) -> str:
        """A line a step: columns before and after, and what is added, removed or changed in type."""
        out = [f"input {len(self.input_schema)} columns"]
        if show_schema:
            out.append(f"      {shown(self.input_schema)}")
        for s in self.steps:
            changes = [f"{sign}{x}" for sign, xs in (("+", s.columns_added), ("-", s.columns_removed), ("~", s.columns_modified)) for x in xs]
            out.append(f"{s.number:>3} {s.operation:<24} {len(s.schema_before):>3} -> {len(s.schema_after):<3} {' '.join(changes)}" + (f"  ERROR {s.error}" if s.error else ""))
            if show_params and s.params:
                out.append(f"      {shown(s.params)}")
            if show_schema:
                out.append(f"      {shown(s.schema_after)}")
        out.append(f"output {len(self.output_schema)} columns, " + ("valid" if self.is_valid else f"{len(self.errors)} errors"))
        return "\n".join(out)

    def print(self, *, show_params: bool = True, show_schema: bool = False) -> None:
        print(self.summary(show_params=show_params, show_schema=show_schema))


def shown(params: dict[str, Any], width: int = 100) -> str:
    """Parameters on one line; values that are not given are left out, long lines are cut."""
    text = ", ".join(f"{k}={_shown_filter(v) if isinstance(v, Filter) else v!r}" for k, v in params.items() if v is not None)
    return text if len(text) <= width else text[: width - 3] + "..."


def _shown_filter(v: Filter) -> str:
    return json.dumps(encode(v.to_dict()), ensure_ascii=False, default=str)


def start_of_order(steps: Sequence[Step]) -> int | None:
    """Before which step rows must be numbered, if at all.

    Row-wise steps leave rows where they are, so numbering them later gives the same order; and the later,
    the better, since filters above the numbers don't reach the scan.
    """
    ordered = next((i for i, s in enumerate(steps) if REGISTRY[s.operation].ordered(s.params)), None)
    if ordered is None:
        return None
    moving = next((i for i, s in enumerate(steps[:ordered]) if REGISTRY[s.operation].scope(s.params) is not Scope.ROW), ordered)
    return min(moving, ordered)


class Orderer:
    """Gives the steps the row order they need, as late as possible: declared columns, or numbers of rows."""

    def __init__(self, ctx: Context, steps: Sequence[Step], order_by: str | Sequence[str] | None) -> None:
        self.ctx, self.start = ctx, start_of_order(steps)
        self.keys = [order_by] if isinstance(order_by, str) else list(order_by or [])

    def source(self, df: DataFrame) -> DataFrame:
        """Declared columns are copied at the source, before a step can change them."""
        return self.ctx.declare(df, [(k, False) for k in self.keys]) if self.keys and self.start is not None else df

    def before(self, df: DataFrame, step: int) -> DataFrame:
        return self.ctx.number_rows(df) if step == self.start and not self.keys else df


def _visible(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields if not f.name.startswith(HIDDEN)}


def dry_run(steps: Sequence[Step], data: DataFrame, references: dict[str, DataFrame] | None) -> DryRun:
    """Lower each step on an empty frame. After an errored step the schema before it goes on.

    Where columns depend on data (pivots, derived one-hot columns), later findings about missing columns
    are warnings, not errors.
    """
    ctx = Context(references or {}, dry=True)
    empty = data.sparkSession.createDataFrame([], data.schema)
    order = Orderer(ctx, steps, None)
    df = order.source(empty)
    out, errors, open_schema = [], [], False
    for i, s in enumerate(steps, 1):
        df = order.before(df, i - 1)
        op, before = REGISTRY[s.operation], _visible(df)
        problems = op.problems(before, s.params)
        after = df
        if not problems and s.operation == "join" and references is None:
            problems, open_schema = [], True
        elif not problems:
            try:
                after = op.lower(df, ctx, **s.params)
                after.schema  # noqa: B018  analysis happens here
            except (PySparkException, ValueError) as error:
                message = error.getMessage() if isinstance(error, PySparkException) and error.getMessage() else str(error)
                problems, after = [message.split("\n")[0]], df
        if problems and open_schema and all("exist" in p for p in problems):
            problems = []
        text = "; ".join(problems) or None
        out.append(DryRunStep(i, s.operation, {k: t.simpleString() for k, t in before.items()}, {k: t.simpleString() for k, t in _visible(after).items()}, text, dict(s.params)))
        errors += [ValidationError(i, s.operation, p) for p in problems]
        df, open_schema = after, open_schema or op.open_schema(s.params)
    return DryRun(out, errors, {k: t.simpleString() for k, t in _visible(data).items()})


def validate(steps: Sequence[Step], data: DataFrame, references: dict[str, DataFrame] | None) -> Validation:
    return Validation(dry_run(steps, data, references).errors)
