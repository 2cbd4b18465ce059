"""Chunked processing: the reports of a run by chunks, from one distributed job."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import c
from ..registry import REGISTRY, Scope, as_list
from ..steps import Step, encode
from .audit import digest, metrics, row_hash
from .context import HIDDEN, Context

CHUNK = f"{HIDDEN}chunk"


def chunk_problems(steps: Sequence[Step], partition_key: str | Sequence[str] | None, strict: bool = True) -> list[str]:
    """Why steps can't run chunk by chunk.

    A chunk holds all rows of its partition keys P. Groups by G stay whole if rows that agree on G agree
    on P, that is if P is part of G. Key columns are followed through renames; one that a step drops or
    changes no longer counts. Global steps fail only if ``strict``: run as one job they are exact anyway.
    """
    keys: list[str | None] = list(as_list(partition_key))
    out = []
    for i, s in enumerate(steps, 1):
        op = REGISTRY[s.operation]
        scope = op.scope(s.params)
        if scope is Scope.GLOBAL and strict:
            if op.group_param:
                out.append(f"Step {i}: Operation '{s.operation}' without '{op.group_param}' parameter requires the full dataset")
            else:
                out.append(f"Step {i}: Operation '{s.operation}' requires the full dataset and cannot run by chunks")
        elif scope is Scope.GROUP:
            group = as_list(s.params[op.group_param])
            if not keys:
                out.append(f"Step {i}: Operation '{s.operation}' groups by {group}, which needs a partition_key")
            elif missing := [k for k in keys if k is None or k not in group]:
                out.append(f"Step {i}: Operation '{s.operation}' groups by {group} but chunks hold whole {list(as_list(partition_key))}. Missing columns: {[k or '(changed)' for k in missing]}")
        if s.operation == "col_rename":
            keys = [s.params["new_name"] if k == s.params["column"] else k for k in keys]
        elif s.operation in ("col_select", "col_reorder"):
            keys = [k if k in s.params["columns"] else None for k in keys]
        elif op.each and s.params.get(op.each) in keys:  # in place
            keys = [None if k == s.params[op.each] else k for k in keys]
    return out


class ChunkingError(ValueError):
    """A plan that can't run by chunks; ``validation_result`` says why."""

    def __init__(self, message: str, validation_result: Any = None) -> None:
        super().__init__(message)
        self.validation_result = validation_result


@dataclass
class ChunkInfo:
    """Rows and content hash of one chunk before and after."""

    chunk_index: int
    input_rows: int
    output_rows: int
    input_hash: str | None
    output_hash: str | None
    elapsed_seconds: float = 0.0


class ChunkedProtocol:
    """Rows and hashes of every chunk, before and after. Chunks run at once: a chunk's time is its part of the whole by rows."""

    VERSION = "1.0"

    def __init__(self, source: str = "", partition_key: Sequence[str] = (), chunk_size: int = 0, operations: Sequence[dict[str, Any]] = ()) -> None:
        self.source, self.partition_key, self.chunk_size, self.operations = source, list(partition_key), chunk_size, list(operations)
        self.metadata: dict[str, Any] = {}
        self.chunks: list[ChunkInfo] = []
        self.elapsed = 0.0
        self._held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> None:
        self._held.append(df)

    def release(self) -> None:
        """Unpersist what the run keeps for its result; a result used after it is computed again."""
        while self._held:
            self._held.pop().unpersist()

    def set_metadata(self, **values: Any) -> ChunkedProtocol:
        self.metadata.update(values)
        return self

    def add_chunk(self, chunk: ChunkInfo) -> None:
        self.chunks.append(chunk)

    @property
    def num_chunks(self) -> int:
        return len(self.chunks)

    def __len__(self) -> int:
        return len(self.chunks)

    @property
    def total_input_rows(self) -> int:
        return sum(x.input_rows for x in self.chunks)

    @property
    def total_output_rows(self) -> int:
        return sum(x.output_rows for x in self.chunks)

    @property
    def total_elapsed_seconds(self) -> float:
        return self.elapsed

    def output_hash(self) -> str:
        """16 hex digits over the chunks' output hashes, in order; empty without chunks."""
        return hashlib.sha256("|".join(x.output_hash or "" for x in self.chunks).encode()).hexdigest()[:16] if self.chunks else ""

    def to_dict(self) -> dict[str, Any]:
        source = {"path": self.source, "partition_key": self.partition_key, "chunk_size": self.chunk_size}
        totals = {"num_chunks": self.num_chunks, "total_input_rows": self.total_input_rows, "total_output_rows": self.total_output_rows, "total_elapsed_seconds": self.elapsed, "output_hash": self.output_hash()}
        return {"version": self.VERSION, "metadata": {k: encode(v) for k, v in self.metadata.items()}, "source": source, "operations": self.operations, "summary": totals, "chunks": [asdict(x) for x in self.chunks]}

    def to_json(self, path: str | Path | None = None, indent: int | None = 2) -> str:
        text = json.dumps(self.to_dict(), indent=indent, ensure_ascii=False, default=str)
        if path is not None:
            Path(path).write_text(text, encoding="utf-8")
        return text

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> ChunkedProtocol:
        source = data.get("source", {})
        out = cls(source.get("path", ""), source.get("partition_key") or (), source.get("chunk_size", 0), data.get("operations", ()))
        out.metadata = dict(data.get("metadata", {}))
        out.chunks = [ChunkInfo(**x) for x in data.get("chunks", [])]
        out.elapsed = data.get("summary", {}).get("total_elapsed_seconds", 0.0)
        return out

    @classmethod
    def from_json(cls, source: str | Path) -> ChunkedProtocol:
        text = source if isinstance(source, str) and source.lstrip().startswith("{") else Path(source).read_text(encoding="utf-8")
        return cls.from_dict(json.loads(text))

    def summary(self) -> str:
        mean = self.elapsed / self.num_chunks if self.chunks else 0.0
        lines = [f"{self.source}: {self.num_chunks} chunks of {self.chunk_size}, {self.total_input_rows} -> {self.total_output_rows} rows, {self.elapsed:.4f}s ({mean:.4f}s a chunk on average: chunks run at once)"]
        lines += [f"{x.chunk_index:>5} {x.input_rows:>10} -> {x.output_rows:<10} {x.output_hash or ''}" for x in self.chunks]
        return "\n".join(lines)

    def print(self) -> None:
        print(self.summary())


def number_chunks(df: DataFrame, keys: list[str], chunk_size: int, held: list[DataFrame]) -> DataFrame:
    """Add the chunk: runs of ``chunk_size`` rows, or of whole keys (null is a key) up to about as many rows.

    ``held`` takes frames to unpersist once the chunks are computed.
    """
    if keys:
        # one row a key; those of one range of the key order are summed apart, so no task holds all keys
        counts = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias(f"{HIDDEN}n"))
        order = [c(k).asc_nulls_first() for k in keys]
        counts = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{HIDDEN}p", F.spark_partition_id()).persist()
        counts.count()
        held.append(counts)
        before = counts.groupBy(f"{HIDDEN}p").agg(F.sum(f"{HIDDEN}n").alias(f"{HIDDEN}t"))
        before = before.select(f"{HIDDEN}p", F.coalesce(F.sum(f"{HIDDEN}t").over(Window.orderBy(f"{HIDDEN}p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{HIDDEN}o"))
        start = F.sum(f"{HIDDEN}n").over(Window.partitionBy(f"{HIDDEN}p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"{HIDDEN}n") + F.col(f"{HIDDEN}o")
        placed = counts.join(F.broadcast(before), f"{HIDDEN}p").select(*[c(k).alias(f"{HIDDEN}k{i}") for i, k in enumerate(keys)], F.floor(start / chunk_size).cast("long").alias(CHUNK))
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & c(k).eqNullSafe(F.col(f"{HIDDEN}k{i}"))
        return df.join(placed, cond).drop(*[f"{HIDDEN}k{i}" for i in range(len(keys))])
    df = df.withColumn(f"{HIDDEN}row", F.monotonically_increasing_id())
    part = F.shiftright(F.col(f"{HIDDEN}row"), 33)
    sizes = df.groupBy(part.alias(f"{HIDDEN}p")).agg(F.count(F.lit(1)).alias(f"{HIDDEN}t"))
    sizes = sizes.select(f"{HIDDEN}p", F.coalesce(F.sum(f"{HIDDEN}t").over(Window.orderBy(f"{HIDDEN}p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{HIDDEN}o"))
    place = F.col(f"{HIDDEN}row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col(f"{HIDDEN}o")
    return df.withColumn(f"{HIDDEN}p", part).join(F.broadcast(sizes), f"{HIDDEN}p").withColumn(CHUNK, F.floor(place / chunk_size).cast("long")).drop(f"{HIDDEN}p", f"{HIDDEN}o", f"{HIDDEN}row")


def run_chunked(plan: Any, source: Any, partition_key: Any, chunk_size: int, references: dict[str, DataFrame], strict: bool, spark: SparkSession | None) -> tuple[DataFrame, ChunkedProtocol]:
    """Read, check and run the whole source at once, then report by chunk.

    The plan runs over all rows, so the result is exact. The chunk number rides along as a hidden column
    and is one more group key; row-wise steps and steps by groups that chunks hold whole carry it, others
    (``strict_chunking=False``) are reported as one chunk. An empty source gives an empty frame of the
    transformed schema.
    """
    from .validate import start_of_order

    keys, began = as_list(partition_key), time.perf_counter()
    if isinstance(source, DataFrame):
        data, name = source, "DataFrame"
    else:
        spark = spark or SparkSession.getActiveSession()
        name = str(source)
        if "://" not in name and not Path(name).exists():
            raise FileNotFoundError(f"Source file not found: {name}")
        data = spark.read.parquet(name)
    if missing := [k for k in keys if k not in data.columns]:
        raise ValueError(f"Columns do not exist: {missing}")
    found = plan.validate_chunked(keys, data, strict=strict)
    if not found.is_valid:
        raise ChunkingError(str(found), found)
    protocol = ChunkedProtocol(name, keys, chunk_size, [s.to_dict() for s in plan.steps])
    ctx = Context(references)
    # chunks are joined to the rows, so their order is taken at the source
    df = ctx.number_rows(data) if start_of_order(plan.steps) is not None else data
    held: list[DataFrame] = []
    source_rows = df = number_chunks(df, keys, chunk_size, held).persist()
    hashed = lambda d: [x for x in metrics(d, True)]
    before = {r[CHUNK]: r.asDict() for r in df.groupBy(CHUNK).agg(*hashed(df)).collect()}  # one row a chunk
    for s in plan.steps:
        df = REGISTRY[s.operation].lower(df, ctx, **s.params)
    carried = CHUNK in df.columns
    df = df.persist()
    after = {r[0]: r.asDict() for r in df.groupBy((F.col(CHUNK) if carried else F.lit(0)).alias("k")).agg(*hashed(df)).collect()}
    for x in (source_rows, *held):
        x.unpersist()
    protocol.hold(df)
    for k in sorted(before) if carried else [0]:
        x = before[k] if carried else None
        y = after.get(k, {"rows": 0})
        protocol.add_chunk(ChunkInfo(k, x["rows"] if x else sum(v["rows"] for v in before.values()), y["rows"], digest(data, x) if x else None, digest(df, y)))
    from .audit import finish

    protocol.elapsed = time.perf_counter() - began
    for x in protocol.chunks:
        x.elapsed_seconds = protocol.elapsed * x.input_rows / max(1, protocol.total_input_rows)
    return finish(df, ctx), protocol


__all__ = ["ChunkInfo", "ChunkedProtocol", "ChunkingError", "chunk_problems", "number_chunks", "row_hash", "run_chunked"]
