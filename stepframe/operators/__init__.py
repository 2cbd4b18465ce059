"""Importing this package fills the registry."""

from . import column, datetime, join, maps, math, rows, string

__all__ = ["column", "datetime", "join", "maps", "math", "rows", "string"]
