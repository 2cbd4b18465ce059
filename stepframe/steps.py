"""Steps of a plan and their JSON form."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass, field
from typing import Any

from .filters import Filter


@dataclass(frozen=True)
class Step:
    operation: str
    params: dict[str, Any] = field(default_factory=dict)
    section: str | None = None
    reason: str | None = None

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"operation": self.operation, "params": {k: encode(v) for k, v in self.params.items()}}
        if self.section is not None:
            out["section"] = self.section
        if self.reason is not None:
            out["reason"] = self.reason
        return out


def encode(value: Any) -> Any:
    """JSON data for a parameter; what JSON lacks is tagged."""
    if isinstance(value, Filter):
        return value.to_dict() | {k: encode(v) for k, v in value.fields.items()}
    if isinstance(value, dt.datetime):
        return {"$datetime": value.isoformat()}
    if isinstance(value, dt.date):
        return {"$date": value.isoformat()}
    if isinstance(value, dt.timedelta):
        return {"$seconds": value.total_seconds()}
    if isinstance(value, decimal.Decimal):
        return {"$decimal": str(value)}
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return {"$float": repr(value)}
    if isinstance(value, dict):
        if all(isinstance(k, str) and not k.startswith("$") for k in value):
            return {k: encode(v) for k, v in value.items()}
        return {"$pairs": [[encode(k), encode(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return [encode(v) for v in value]
    return value


_TAGS = {
    "$datetime": dt.datetime.fromisoformat,
    "$date": dt.date.fromisoformat,
    "$seconds": lambda v: dt.timedelta(seconds=v),
    "$decimal": decimal.Decimal,
    "$float": float,
    "$pairs": lambda v: {_key(decode(k)): decode(x) for k, x in v},
}


def _key(value: Any) -> Any:
    return tuple(value) if isinstance(value, list) else value


def decode(value: Any) -> Any:
    if isinstance(value, dict):
        if len(value) == 1 and next(iter(value)) in _TAGS:
            tag, inner = next(iter(value.items()))
            return _TAGS[tag](inner)
        return {k: decode(v) for k, v in value.items()}
    if isinstance(value, list):
        return [decode(v) for v in value]
    return value
