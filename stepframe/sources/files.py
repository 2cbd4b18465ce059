"""Tables in files, by Spark's own readers and writers: any store that Spark reaches works."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json")


def _format(path: str, format: str | None) -> str:
    found = format or path.rstrip("/").rpartition(".")[2].lower()
    if found not in FORMATS:
        raise ValueError(f"Unknown table format: {found!r}; one of {FORMATS} is expected")
    return found


def read_table(spark: SparkSession, path: str, *, format: str | None = None, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """Read a table; text formats need a schema (or explicit inferSchema), as inference reads everything twice."""
    kind = _format(path, format)
    if kind in ("csv", "json") and schema is None and not options.get("inferSchema"):
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**({"header": True} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_table(df: DataFrame, path: str, *, format: str | None = None, mode: str = "errorifexists", partition_by: str | Sequence[str] = (), **options: Any) -> None:
    """Write a table, optionally in folders by column values."""
    kind = _format(path, format)
    writer = df.write.format(kind).mode(mode).options(**({"header": True} if kind == "csv" else {}), **options)
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    (writer.partitionBy(*keys) if keys else writer).save(path)
