"""Python source text for parameter values."""

from __future__ import annotations

import decimal
from typing import Any


def code(value: Any) -> str:
    """An expression that gives the value, with ``datetime`` and ``decimal`` imported."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return f"float({str(value)!r})"
    if isinstance(value, decimal.Decimal):
        return f"decimal.Decimal({str(value)!r})"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{code(k)}: {code(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(code, value)) + "]"
    if isinstance(value, tuple):
        return "(" + ", ".join(map(code, value)) + ("," if len(value) == 1 else "") + ")"
    return repr(value)
