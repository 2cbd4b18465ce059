"""The plan builder."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .. import operators  # noqa: F401  fills the registry
from ..code import code
from ..filters import Filter
from ..registry import REGISTRY, Operator, Scope, as_list
from ..steps import Step, decode
from .audit import run
from .chunked import ChunkedProtocol, chunk_problems, run_chunked
from .protocol import Protocol
from .validate import ChunkValidation, DryRun, Validation, dry_run, validate

VERSION = "1.0"


class Plan:
    """A chain of named steps: ``Plan().rows_filter(Col("a") > 1).math_add("a", 2)``.

    Every operator of the registry is a method. Steps are immutable; building never touches data.
    """

    def __init__(self) -> None:
        self._steps: list[Step] = []
        self._section: str | None = None
        self._last = 0  # how many steps the last call added

    # -- building

    def add(self, operation: str, *args: Any, **kwargs: Any) -> Plan:
        """Append the operation by name; operators with a column sequence give one step a column."""
        op = REGISTRY.get(operation)
        if op is None:
            raise ValueError(f"Unknown operation: {operation}")
        params = op.bind(*args, **kwargs)
        if op.each and isinstance(params[op.each], (list, tuple)):
            many = [params | {op.each: x} for x in params[op.each]]
        else:
            many = [params]
        for p in many:
            self._steps.append(Step(operation, op.prepare(p) if op.prepare else p, self._section))
        self._last = len(many)
        return self

    def pipe(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        """``function(plan, ...)``: build-time composition."""
        return function(self, *args, **kwargs)

    def section(self, name: str | None) -> Plan:
        """Name the steps that follow; None ends the section."""
        self._section, self._last = name, 0
        return self

    def because(self, reason: str) -> Plan:
        """Give a reason to all steps of the last call."""
        if not self._last:
            raise ValueError("because() must follow an operation.")
        for i in range(len(self._steps) - self._last, len(self._steps)):
            s = self._steps[i]
            self._steps[i] = Step(s.operation, s.params, s.section, reason)
        return self

    def extend(self, other: Plan) -> Plan:
        """Append another plan's steps; its own sections win over the current one."""
        new = [Step(s.operation, copy.deepcopy(s.params), s.section or self._section, s.reason) for s in other._steps]
        self._steps += new
        self._last = len(new)
        return self

    def __add__(self, other: Plan) -> Plan:
        out = Plan()
        out._steps, out._section = list(self._steps), self._section
        return out.extend(other)

    def __len__(self) -> int:
        return len(self._steps)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Plan) and self.to_dict() == other.to_dict()

    __hash__ = None

    def __repr__(self) -> str:
        return f"Plan({', '.join(s.operation for s in self._steps)})"

    @property
    def steps(self) -> tuple[Step, ...]:
        return tuple(self._steps)

    # -- running

    def process(
        self,
        data: DataFrame,
        references: dict[str, DataFrame] | None = None,
        *,
        order_by: str | Sequence[str] | None = None,
        audit: str = "full",
        check: bool = True,
    ) -> tuple[DataFrame, Protocol]:
        """Validate, run and audit.

        order_by declares the row order (ascending, nulls first) that order-sensitive steps follow; without
        it rows are numbered as the source delivers them. audit: "full" (rows, columns and content hash of
        each step), "shape", "endpoints" (input and output only) or "none" (lazy, no job of its own).
        """
        if check:
            self.validate(data, references).raise_if_invalid()
        return run(self.steps, data, references or {}, order_by, audit)

    def transform(self, data: DataFrame, references: dict[str, DataFrame] | None = None, *, order_by: str | Sequence[str] | None = None) -> DataFrame:
        """The lazy result alone: no validation, no audit."""
        return run(self.steps, data, references or {}, order_by, "none")[0]

    def validate(self, data: DataFrame, references: dict[str, DataFrame] | None = None) -> Validation:
        """Check every step against the schema; no data is read."""
        return validate(self.steps, data, references)

    def dry_run(self, data: DataFrame, references: dict[str, DataFrame] | None = None) -> DryRun:
        """The schema before and after each step; no data is read."""
        return dry_run(self.steps, data, references)

    def validate_chunked(self, partition_key: str | Sequence[str] | None = None, data: DataFrame | None = None, *, strict: bool = True) -> ChunkValidation:
        """Whether chunks of rows (of whole partition keys) can be processed one by one."""
        found = ChunkValidation(list(chunk_problems(self.steps, partition_key, strict)))
        for s in self.steps:
            op = REGISTRY[s.operation]
            if op.scope(s.params) is Scope.GLOBAL:
                found.global_operations.append(s.operation)
            elif op.scope(s.params) is Scope.GROUP:
                found.group_dependent_ops.append((s.operation, as_list(s.params[op.group_param])))
        if data is not None:
            found.errors += self.validate(data).errors
        return found

    def process_chunked(self, source: str | Path | DataFrame, *, partition_key: str | Sequence[str] | None = None, chunk_size: int = 50_000, references: dict[str, DataFrame] | None = None, strict_chunking: bool = True, spark: Any = None) -> tuple[DataFrame, ChunkedProtocol]:
        """Process a Parquet source by chunks in one distributed job; see run_chunked()."""
        return run_chunked(self, source, partition_key, chunk_size, references or {}, strict_chunking, spark)

    # -- storing

    def to_dict(self) -> dict[str, Any]:
        return {"version": VERSION, "steps": [s.to_dict() for s in self._steps]}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Plan:
        """Rebuild a plan; only names of the registry are operations, so a file can't call anything else."""
        plan = cls()
        for s in data["steps"]:
            name = s["operation"]
            op = REGISTRY.get(name)
            if op is None:
                raise ValueError(f"Unknown operation: {name}")
            params = {k: Filter.from_dict(decode(v)) if k == "filter" and isinstance(v, dict) else decode(v) for k, v in s.get("params", {}).items()}
            try:
                params = op.bind(**params)
                params = op.prepare(params) if op.prepare else params
            except (TypeError, KeyError, ValueError) as error:
                raise ValueError(f"Invalid parameters for operation '{name}': {error}") from error
            plan._steps.append(Step(name, params, s.get("section"), s.get("reason")))
        return plan

    def to_json(self, path: str | Path | None = None, indent: int = 2) -> str:
        text = json.dumps(self.to_dict(), indent=indent, ensure_ascii=False)
        if path is not None:
            Path(path).write_text(text, encoding="utf-8")
        return text

    @classmethod
    def from_json(cls, source: str | Path) -> Plan:
        """From JSON text (it starts with a brace) or a file."""
        text = source if isinstance(source, str) and source.lstrip().startswith("{") else Path(source).read_text(encoding="utf-8")
        return cls.from_dict(json.loads(text))

    def to_python(self, variable: str = "plan") -> str:
        """Python code that builds this plan."""
        lines, section, names = [], None, {"Plan"}
        for s in self._steps:
            if s.section != section:
                lines.append(f"    .section({s.section!r})")
                section = s.section
            shown = []
            for p in REGISTRY[s.operation].signature.parameters.values():
                v = s.params[p.name]
                if p.default is p.empty or v != p.default or type(v) is not type(p.default):
                    shown.append(f"{p.name}={code(v)}")
                    names |= {"Col"} if isinstance(v, Filter) else set()
            lines.append(f"    .{s.operation}({', '.join(shown)})")
            if s.reason is not None:
                lines.append(f"    .because({s.reason!r})")
        head = [f"import {m}" for m in ("datetime", "decimal") if any(f"{m}." in x for x in lines)]
        head += [""] * bool(head) + [f"from stepframe import {', '.join(sorted(names))}"]
        return "\n".join([*head, "", f"{variable} = (", "    Plan()", *lines, ")"]) + "\n"


def _method(op: Operator) -> Callable[..., Plan]:
    def method(self: Plan, *args: Any, **kwargs: Any) -> Plan:
        return self.add(op.name, *args, **kwargs)

    method.__name__ = method.__qualname__ = op.name
    method.__doc__ = op.lower.__doc__
    method.__signature__ = op.signature  # type: ignore[attr-defined]
    return method


for _op in REGISTRY.values():
    setattr(Plan, _op.name, _method(_op))
