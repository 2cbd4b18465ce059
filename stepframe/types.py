"""Canonical type names and their Spark types."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import types as T

#: name -> (Spark type, lower and upper bound where Spark has no such type of its own)
CANONICAL: dict[str, tuple[T.DataType, tuple[int, int] | None]] = {
    "Int8": (T.ByteType(), None),
    "Int16": (T.ShortType(), None),
    "Int32": (T.IntegerType(), None),
    "Int64": (T.LongType(), None),
    "UInt8": (T.ShortType(), (0, 2**8 - 1)),
    "UInt16": (T.IntegerType(), (0, 2**16 - 1)),
    "UInt32": (T.LongType(), (0, 2**32 - 1)),
    "UInt64": (T.DecimalType(20, 0), (0, 2**64 - 1)),
    "Float32": (T.FloatType(), None),
    "Float64": (T.DoubleType(), None),
    "Boolean": (T.BooleanType(), None),
    "String": (T.StringType(), None),
    "Binary": (T.BinaryType(), None),
    "Date": (T.DateType(), None),
    "Datetime": (T.TimestampNTZType(), None),
    "Duration": (T.DayTimeIntervalType(), None),
}
_PYTHON = {bool: "Boolean", int: "Int64", float: "Float64", str: "String", bytes: "Binary", dt.datetime: "Datetime", dt.date: "Date", dt.time: "Time", dt.timedelta: "Duration"}
_ALIASES = {"Utf8": "String", "Bool": "Boolean", "Str": "String", "string": "String", "str": "String", "int": "Int64", "integer": "Int64", "float": "Float64", "bool": "Boolean", "boolean": "Boolean", "date": "Date", "datetime": "Datetime"}


def canonical(dtype: Any) -> str:
    """The canonical name of a name, a Python type or a Spark type; raises on what has none."""
    if isinstance(dtype, T.DataType):
        for name, (spark, bounds) in CANONICAL.items():
            if bounds is None and type(spark) is type(dtype):
                return name
        raise ValueError(f"Unknown dtype name: {dtype.simpleString()}")
    name = _PYTHON.get(dtype, dtype) if isinstance(dtype, type) else dtype
    name = _ALIASES.get(name, name) if isinstance(name, str) else name
    if name == "Time":
        raise ValueError("Time is not supported: store microseconds of the day as Int64")
    if not isinstance(name, str) or name not in CANONICAL:
        raise ValueError(f"Unknown dtype name: {name}")
    return name


def spark_type(name: str) -> T.DataType:
    return CANONICAL[name][0]


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_datetime(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType))


def is_timestamp(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType))


def is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)
