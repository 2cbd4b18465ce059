"""The audit protocol of one run."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..steps import Step, encode
from .validate import shown

Shape = tuple[int, int]
NO_EFFECT = "○"


class Protocol:
    """Input, each step and output: shape, content hash and time."""

    def __init__(self, audit: str = "full") -> None:
        self.audit = audit
        self.metadata: dict[str, Any] = {}
        self.input_shape: Shape | None = None
        self.input_hash: str | None = None
        self.references: dict[str, dict[str, Any]] = {}
        self.derived: dict[str, dict[str, Any]] = {}
        self.elapsed = 0.0
        self._steps: list[dict[str, Any]] = []
        self._held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> None:
        self._held.append(df)

    def release(self) -> None:
        """Unpersist what the run keeps for its result; a result used after it is computed again."""
        while self._held:
            self._held.pop().unpersist()

    def set_input(self, shape: Shape, content: str | None) -> None:
        self.input_shape, self.input_hash = tuple(shape), content

    def set_metadata(self, **values: Any) -> Protocol:
        self.metadata.update(values)
        return self

    def add_reference(self, name: str, shape: Shape, content: str | None) -> None:
        self.references[name] = {"shape": list(shape), "hash": content}

    def add_step(self, step: Step, before: Shape | None, after: Shape | None, content: str | None, seconds: float) -> None:
        previous = self._steps[-1]["output_hash"] if self._steps else self.input_hash
        changed = None if after is None or before is None else tuple(before) != tuple(after) or previous is None or content is None or previous != content
        self._steps.append(
            {
                "step": len(self._steps) + 1,
                **step.to_dict(),
                "input_shape": list(before) if before else None,
                "output_shape": list(after) if after else None,
                "rows_changed": after[0] - before[0] if after and before else None,
                "columns_changed": after[1] - before[1] if after and before else None,
                "output_hash": content,
                "changed": changed,
                "elapsed": seconds,
            }
        )

    @property
    def steps(self) -> list[dict[str, Any]]:
        return [dict(s) for s in self._steps]

    @property
    def output_hash(self) -> str | None:
        return self._steps[-1]["output_hash"] if self._steps else self.input_hash

    @property
    def output_shape(self) -> Shape | None:
        return tuple(self._steps[-1]["output_shape"]) if self._steps and self._steps[-1]["output_shape"] else self.input_shape

    def __len__(self) -> int:
        return len(self._steps)

    def sections(self) -> list[dict[str, Any]]:
        """Runs of steps of one section: how many steps, rows before and after, seconds."""
        out: list[dict[str, Any]] = []
        for s in self._steps:
            if not out or out[-1]["section"] != s.get("section"):
                out.append({"section": s.get("section"), "steps": 0, "rows_before": (s["input_shape"] or [None])[0], "rows_after": None, "elapsed": 0.0})
            out[-1]["steps"] += 1
            out[-1]["rows_after"] = (s["output_shape"] or [None])[0]
            out[-1]["elapsed"] += s["elapsed"]
        return out

    def to_dict(self) -> dict[str, Any]:
        return {
            "version": "1.0",
            "audit": self.audit,
            "metadata": {k: encode(v) for k, v in self.metadata.items()},
            "input": {"shape": list(self.input_shape) if self.input_shape else None, "hash": self.input_hash},
            "references": self.references,
            "derived": {k: {n: encode(v) for n, v in d.items()} for k, d in self.derived.items()},
            "steps": self.steps,
            "output_hash": self.output_hash,
            "elapsed": self.elapsed,
        }

    def to_json(self, path: str | Path | None = None, indent: int | None = 2) -> str:
        text = json.dumps(self.to_dict(), indent=indent, ensure_ascii=False, default=str)
        if path is not None:
            Path(path).write_text(text, encoding="utf-8")
        return text

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Protocol:
        out = cls(data.get("audit", "full"))
        out.metadata, out.references, out.derived = dict(data.get("metadata", {})), dict(data.get("references", {})), dict(data.get("derived", {}))
        shape = data["input"]["shape"]
        out.input_shape, out.input_hash = tuple(shape) if shape else None, data["input"]["hash"]
        out._steps, out.elapsed = [dict(s) for s in data["steps"]], data.get("elapsed", 0.0)
        return out

    @classmethod
    def from_json(cls, source: str | Path) -> Protocol:
        text = source if isinstance(source, str) and source.lstrip().startswith("{") else Path(source).read_text(encoding="utf-8")
        return cls.from_dict(json.loads(text))

    _FIELDS = ("step", "operation", "params", "section", "reason", "rows_before", "rows_after", "columns_before", "columns_after", "output_hash", "changed", "elapsed")

    def _flat(self) -> list[dict[str, Any]]:
        rows = []
        for s in self._steps:
            before, after = s["input_shape"] or [None, None], s["output_shape"] or [None, None]
            rows.append({"step": s["step"], "operation": s["operation"], "params": json.dumps(s["params"], ensure_ascii=False, default=str), "section": s.get("section"), "reason": s.get("reason"), "rows_before": before[0], "rows_after": after[0], "columns_before": before[1], "columns_after": after[1], "output_hash": s["output_hash"], "changed": s["changed"], "elapsed": s["elapsed"]})
        return rows

    def to_csv(self, path: str | Path | None = None) -> str:
        out = io.StringIO()
        writer = csv.DictWriter(out, self._FIELDS, lineterminator="\n")
        writer.writeheader()
        writer.writerows(self._flat())
        if path is not None:
            Path(path).write_text(out.getvalue(), encoding="utf-8")
        return out.getvalue()

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        schema = "step int, operation string, params string, section string, reason string, rows_before long, rows_after long, columns_before int, columns_after int, output_hash string, changed boolean, elapsed double"
        return spark.createDataFrame([tuple(r[k] for k in self._FIELDS) for r in self._flat()], schema)

    def summary(self, *, show_params: bool = True) -> str:
        """Input, a line a step under its section, and output; with the parameters of each step by default."""
        out = [f"input {self.input_shape} {self.input_hash or ''}".rstrip()]
        section = None
        for s in self._steps:
            if s.get("section") != section:
                section = s.get("section")
                out.append(f"[{section or 'no section'}]")
            shape = tuple(s["output_shape"]) if s["output_shape"] else ""
            mark = f" {NO_EFFECT}" if s["changed"] is False else ""
            out.append(f"{s['step']:>3} {s['operation']:<24} {shape} {s['output_hash'] or ''} {s['elapsed']:.4f}s{mark}" + (f"  because {s['reason']}" if s.get("reason") else ""))
            if show_params and s["params"]:
                out.append(f"      {shown(s['params'])}")
        out.append(f"output {self.output_shape} in {self.elapsed:.4f}s")
        return "\n".join(out)

    def print(self, *, show_params: bool = True) -> None:
        print(self.summary(show_params=show_params))
