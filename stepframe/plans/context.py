"""What the lowering of one plan carries along: references, row order, derived statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c, quote
from ..types import is_datetime, is_numeric

HIDDEN = "__sf_"
#: Rows of a batch that monotonically_increasing_id numbers without a gap.
_ID_BITS = 33


@dataclass
class Key:
    """One hidden column of the row order."""

    name: str
    descending: bool = False
    nulls_first: bool = True

    def column(self, reverse: bool = False) -> Column:
        x = F.col(self.name)
        if self.descending != reverse:
            return x.desc_nulls_first() if self.nulls_first != reverse else x.desc_nulls_last()
        return x.asc_nulls_first() if self.nulls_first != reverse else x.asc_nulls_last()


@dataclass
class Context:
    references: dict[str, DataFrame] = field(default_factory=dict)
    dry: bool = False
    order: list[Key] = field(default_factory=list)
    sorted: bool = False
    derived: dict[str, Any] = field(default_factory=dict)
    counter: int = 0

    def fresh(self) -> str:
        self.counter += 1
        return f"{HIDDEN}{self.counter}"

    def visible(self, df: DataFrame) -> list[str]:
        return [x for x in df.columns if not x.startswith(HIDDEN)]

    def hidden(self, df: DataFrame) -> list[str]:
        return [x for x in df.columns if x.startswith(HIDDEN)]

    def select(self, df: DataFrame, *columns: Column | str) -> DataFrame:
        """A projection that keeps the hidden order."""
        return df.select(*[c(x) if isinstance(x, str) else x for x in columns], *self.hidden(df))

    def order_by(self, reverse: bool = False) -> list[Column]:
        if not self.order:
            raise RuntimeError("no row order: the plan's needs were not seen")
        return [k.column(reverse) for k in self.order]

    def number_rows(self, df: DataFrame) -> DataFrame:
        """Number the rows at the source, as the order of last resort."""
        name = f"{HIDDEN}pos"
        self.order = [Key(name)]
        return df.withColumn(name, F.monotonically_increasing_id())

    def declare(self, df: DataFrame, columns: list[tuple[str, bool]], nulls_first: bool = True) -> DataFrame:
        """Put ``columns`` (name, descending) before the present order, as copies that later steps can't change."""
        keys = []
        for name, descending in columns:
            copy = self.fresh()
            df = df.withColumn(copy, c(name))
            keys.append(Key(copy, descending, nulls_first))
        self.order = keys + self.order
        return df

    def stats(self, df: DataFrame, label: str, **columns: Column) -> dict[str, Any]:
        """One row of aggregates, by one job; nothing in a dry run. What a step derived is kept for the protocol."""
        if self.dry:
            return dict.fromkeys(columns)
        found = df.agg(*[x.alias(k) for k, x in columns.items()]).first().asDict()
        self.derived.setdefault(label, {}).update(found)
        return found

    def buckets(self, df: DataFrame) -> Column | None:
        """Ranges of the row order that are numbered in the same direction; None if a window must be one.

        With them an ungrouped running window is computed within each range, and the ranges' totals (one
        row each) are carried over, so no task has to sort the whole table.
        """
        if self.dry or not self.order:
            return None
        key = self.order[0]
        if key.name.endswith("pos"):
            return F.shiftright(F.col(key.name), _ID_BITS)
        return self.ranges(df, key.name, key.descending, key.nulls_first)

    def ranges(self, df: DataFrame, column: str, descending: bool, nulls_first: bool) -> Column | None:
        """Ranges of a column's values, about equally full; equal values share a range. None for types without literals.

        Numbers and times are cut at approximate quantiles; other types where Spark's own range partitioning
        of the column alone puts the bounds. The driver gets one value a range.
        """
        x, t = c(column), df.schema[column].dataType
        if self.dry or isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return None
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if (is_numeric(t) or is_datetime(t)) and not isinstance(t, T.DecimalType):
            key = F.unix_micros(x.cast("timestamp")).cast("double") if is_datetime(t) else x.cast("double")
            bounds = df.select(key.alias("x")).where("x IS NOT NULL AND NOT isnan(x)").approxQuantile("x", [i / n for i in range(1, n)], 0.5 / n) if n > 1 else []
            bounds = sorted(bounds)
            nan = F.isnan(key)
        else:
            key, nan = x, F.lit(False)
            found = df.select(x.alias("x")).where("x IS NOT NULL").repartitionByRange(n, "x").groupBy(F.spark_partition_id()).agg(F.max("x").alias("x")).sort("x").collect()
            bounds = [r.x for r in found][:-1]
        bounds = list(dict.fromkeys(bounds))
        rank = F.when(nan, F.lit(len(bounds))).otherwise(_bounds_below(key, bounds))
        first = -1 if nulls_first else len(bounds) + 1
        return F.when(x.isNull(), F.lit(first)).otherwise(-rank + len(bounds) if descending else rank)

    def quantiles(self, df: DataFrame, label: str, column: str, **asked: float) -> dict[str, float | None]:
        """Exact quantiles, interpolated linearly; no task and no driver holds the column.

        The range of values is cut into cells of equal width, and the cell in which a rank falls is cut again,
        until it holds one value or few enough to fetch. Each cut is a count by cell. NaN is the largest value.
        """
        if self.dry:
            return dict.fromkeys(asked)
        x = c(column).cast("double")
        values = df.select(x.alias("x")).where("x IS NOT NULL")
        real = values.where("NOT isnan(x)")
        total = values.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.isnan("x"), 1)).alias("real"), F.min("x").alias("low"), F.max(F.when(~F.isnan("x"), F.col("x"))).alias("high")).first()
        found: dict[str, float | None] = {}
        cuts: dict[tuple[float, float], list[Any]] = {}
        for name, q in asked.items():
            if not total.n:
                found[name] = None
                continue
            at = q * (total.n - 1)
            k = int(at)
            a, b = _order_statistics(real, total, k, cuts) if k < total.real else (float("nan"), float("nan"))
            found[name] = a if at == k else (k + 1 - at) * a + (at - k) * b
        self.derived.setdefault(label, {}).update(found)
        return found


#: Cells of one cut, and how many values the driver fetches at last.
_CUTS, _FEW = 4096, 4096


def _order_statistics(values: DataFrame, total: Any, k: int, cuts: dict[tuple[float, float], list[Any]]) -> tuple[float, float]:
    """The values of rank k and k + 1 (from 0) of column x; of the last rank twice the last. ``cuts`` keeps counts by range."""
    x, low, high, below, inside = F.col("x"), total.low, total.high, 0, total.real

    def held() -> DataFrame:
        return values.where((x >= F.lit(low)) & (x <= F.lit(high)))

    while inside > _FEW and low < high and (high - low) / _CUTS > 0 and high - low != float("inf"):
        before = (low, high)
        if before not in cuts:
            cell = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / _CUTS)), F.lit(_CUTS - 1))
            cuts[before] = sorted(tuple(r) for r in held().groupBy(cell.alias("c")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect())
        for _, inside, low, high in cuts[before]:
            if k < below + inside:
                break
            below += inside
        if (low, high) == before:
            break
    found = [(low, inside)] if low == high else sorted(tuple(r) for r in held().groupBy("x").agg(F.count(F.lit(1))).collect())  # few values, or neighbouring doubles
    for i, (value, n) in enumerate(found):
        below += n
        if k < below:
            break
    if k + 1 < below:
        return value, value
    if i + 1 < len(found):
        return value, found[i + 1][0]
    following = values.where(x > F.lit(value)).agg(F.min("x")).first()[0]
    return value, following if following is not None else float("nan") if total.n > total.real else value


def _bounds_below(key: Column, bounds: list[Any]) -> Column:
    """How many of the ascending bounds are less than the key, by bisection: a comparison with each costs rows times ranges."""
    if not bounds:
        return F.lit(0)
    values = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) < key, n + step).otherwise(n))


def with_offsets(df: DataFrame, bucket: Column, total: Column, carry: str, reverse: bool = False) -> tuple[DataFrame, str]:
    """Add ``carry``: the sum of ``total`` over all buckets before a row's own; returns the bucket's name too."""
    name = f"{HIDDEN}bucket"
    df = df.withColumn(name, bucket)
    w = Window.orderBy(F.col(name).desc() if reverse else F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(name).agg(total.alias(f"{HIDDEN}total"))  # one row a bucket
    totals = totals.select(F.col(name), F.sum(f"{HIDDEN}total").over(w).alias(carry))
    return df.join(F.broadcast(totals), name), name


def replace(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn by literal name: replaces in place or appends before the hidden columns."""
    if name in df.columns:
        return df.withColumn(name, value)
    hidden = [x for x in df.columns if x.startswith(HIDDEN)]
    return df.select(*[quote(x) for x in df.columns if x not in hidden], value.alias(name), *hidden)
