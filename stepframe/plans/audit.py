"""Running a plan, with shape and content hash of each step from (nearly) one pass over the data."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c
from ..registry import REGISTRY
from ..steps import Step
from .context import HIDDEN, Context
from .protocol import Protocol
from .validate import Orderer

LEVELS = ("full", "shape", "endpoints", "none")


def row_hash(df: DataFrame) -> Column:
    """64 bits of a row, the same for any order of columns; which column is null counts."""
    parts: list[Column] = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name.startswith(HIDDEN):
            continue
        x = c(f.name)
        if isinstance(f.dataType, T.MapType):
            x = F.array_sort(F.map_entries(x))
        elif isinstance(f.dataType, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
            x = x.cast("string")
        parts += [x.isNull(), x]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def metrics(df: DataFrame, hashed: bool) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    if hashed:
        h = row_hash(df)
        # the sum of all hashes by 16 bits each: sums of longs are cheap, and don't overflow below 2^47 rows
        out += [F.sum(F.shiftright(h, 16 * k).bitwiseAND(F.lit(0xFFFF)) if k < 3 else F.shiftright(h, 48)).alias(f"sum{k}") for k in range(4)]
        out.append(F.bit_xor(h).alias("xor"))
    return out


def digest(df: DataFrame, found: dict[str, Any]) -> str:
    """16 hex digits from the schema and the aggregated row hashes; repeated rows count."""
    schema = "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name) if not f.name.startswith(HIDDEN))
    total = sum((found.get(f"sum{k}") or 0) << (16 * k) for k in range(4))
    return hashlib.sha256(f"{schema}#{found['rows']}#{total}#{found.get('xor') or 0}".encode()).hexdigest()[:16]


def frame_hash(df: DataFrame) -> str:
    return digest(df, df.agg(*metrics(df, True)).first().asDict())


def n_columns(df: DataFrame) -> int:
    return sum(not x.startswith(HIDDEN) for x in df.columns)


class _Watch:
    """Metrics that the next action fills in."""

    def __init__(self, df: DataFrame, hashed: bool) -> None:
        self.observation, self.frame, self.hashed = Observation(), df, hashed
        self.watched = df.observe(self.observation, *metrics(df, hashed))

    def result(self) -> tuple[tuple[int, int], str | None]:
        found = self.observation.get
        found = {**found, "rows": found.get("rows") or 0}
        return (found["rows"], n_columns(self.frame)), digest(self.frame, found) if self.hashed else None


def finish(df: DataFrame, ctx: Context) -> DataFrame:
    """The sort that steps asked for, once, and without the hidden columns."""
    if ctx.sorted and ctx.order:
        df = df.orderBy(*ctx.order_by())
    return df.drop(*ctx.hidden(df)) if ctx.hidden(df) else df


def run(steps: Sequence[Step], data: DataFrame, references: dict[str, DataFrame], order_by: str | Sequence[str] | None, audit: str) -> tuple[DataFrame, Protocol]:
    """Lower all steps. With an audit, metrics ride on the frame and are filled by actions at barriers.

    A barrier is where later operators would distort what is counted below them: limits stop the
    rows above them early, range partitioning runs them twice, and derived statistics are actions of their
    own. There the frame is persisted and counted, so that every step's metrics come from one evaluation.
    The last such frame stays, as the result reads it; protocol.release() gives it up.
    """
    if audit not in LEVELS:
        raise ValueError(f"audit must be one of {LEVELS}, got {audit!r}")
    ctx, protocol, began = Context(references), Protocol(audit), time.perf_counter()
    order = Orderer(ctx, steps, order_by)
    df = order.source(data)
    if audit == "none":
        for i, s in enumerate(steps):
            df = REGISTRY[s.operation].lower(order.before(df, i), ctx, **s.params)
        return finish(df, ctx), protocol
    hashed, every = audit in ("full", "endpoints"), audit in ("full", "shape")
    waiting: list[tuple[int, _Watch]] = []
    results: dict[int, tuple[tuple[int, int], str | None]] = {}

    def watch(i: int, df: DataFrame) -> DataFrame:
        w = _Watch(df, hashed)
        waiting.append((i, w))
        return w.watched

    def barrier(df: DataFrame) -> DataFrame:
        df = df.persist()
        df.count()
        protocol.release()  # all that goes on reads the new frame
        protocol.hold(df)
        for i, w in waiting:
            results[i] = w.result()
        waiting.clear()
        return df

    df = watch(0, df)
    times = []
    for i, s in enumerate(steps, 1):
        op, start = REGISTRY[s.operation], time.perf_counter()
        if waiting and (op.barrier or op.open_schema(s.params) or op.scope(s.params).value == "global"):
            df = barrier(df)
        df = op.lower(order.before(df, i - 1), ctx, **s.params)
        if every or i == len(steps):
            df = watch(i, df)
            if op.barrier:
                df = barrier(df)
        times.append(time.perf_counter() - start)
    if waiting:
        df = barrier(df)
    shape, content = results[0]
    protocol.set_input(shape, content)
    for name, right in references.items():
        found = right.agg(*metrics(right, hashed)).first().asDict()
        protocol.add_reference(name, (found["rows"], n_columns(right)), digest(right, found) if hashed else None)
    before = shape
    for i, (s, seconds) in enumerate(zip(steps, times), 1):
        after, content = results.get(i, (None, None))
        protocol.add_step(s, before if every else None, after, content, seconds)
        before = after or before
    protocol.derived = {k: dict(v) for k, v in ctx.derived.items()}
    protocol.elapsed = time.perf_counter() - began
    return finish(df, ctx), protocol
