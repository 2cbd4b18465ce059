"""Mixing sources to target weights by Pareto order sampling after allocating certain whole copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE_CLASS, materialize, packed, uniform, unpacked

#: Cells of the histogram over ranks.
_CELLS = 4096
#: How often the ranks are walked down; each time with what still fits.
_WALKS = 3
#: Size bands of one doubling. Inclusion depends on the band, so a source has few different probabilities.
_BANDS = 4


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, share: float = 1.0) -> DataFrame:
    """Target of each source from (source, source_size): one row a source in and out.

    Sources in code point order, null last, weigh ``cycle`` repeating and share ``share`` of all sizes by
    weight; none gets over ``max_copies`` times its size, and what is cut is shared again by weight among
    the others until none is above. That fixed point is min(cap, level * weight): with the sources in
    ascending order of cap / weight, the first whose cap exceeds the level that is left fixes the level.
    """
    n = len(cycle)
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("__ratio", "__rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = sizes.withColumn("__rank", F.row_number().over(by_name)).withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.col("__rank") - 1) % n + 1).cast("int")))
    s = s.withColumn("__cap", F.col("source_size").cast("double") * max_copies).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    s = s.withColumn("__left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    s = s.withColumn("__weight", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    s = s.withColumn("__level", F.when(F.col("__left") / F.col("__weight") <= F.col("__ratio"), F.col("__left") / F.col("__weight")))
    s = s.withColumn("__level", F.first("__level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least("__cap", F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap"))).alias("target"))


def size_band(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) * _BANDS)).cast("long")


def inclusion(bands: DataFrame, targets: DataFrame, *, power: float = 0.25, max_copies: int = 3) -> DataFrame:
    """Whole copies ``sure`` and the inclusion odds' probability ``p`` of one more, by source and size band.

    ``bands``: source, band, words. A document of weight w = 2 ** (power * band / 4), about its size to that
    power, is expected min(max_copies, level * w) times, where the source's level makes the expected words
    its target. Documents that would exceed ``max_copies`` are taken that often with certainty and what is
    left is scaled up for the others: in descending order of w, the first band that stays below the limit
    fixes the level. A source has at most some hundred bands, so its windows are small.
    """
    b = _by_source(bands.where("words > 0"), targets.select(F.col("source").alias("src"), "target"), "source")
    b = b.withColumn("w", F.pow(F.lit(2.0), F.col("band") * (power / _BANDS)))
    down = Window.partitionBy("source").orderBy(F.desc("band"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("level", (F.col("target") - max_copies * above) / rest)
    b = b.withColumn("level", F.when(F.col("level") * F.col("w") <= max_copies, F.greatest("level", F.lit(0.0))))
    b = b.withColumn("level", F.first("level", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    copies = F.round(F.least(F.lit(float(max_copies)), F.coalesce(F.col("level") * F.col("w"), F.lit(float(max_copies)))), 9)
    b = b.withColumn("copies", copies).withColumn("sure", F.floor("copies").cast("long"))
    return b.select("source", "band", "words", "sure", (F.col("copies") - F.col("sure")).alias("p"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, power: float = 0.25, seed: int = 17) -> DataFrame:
    """How many whole copies of each document a mix takes: ``size, source_size, target, copies, taken``.

    Each document is expected in the mix in proportion to about size ** ``power`` (0: all alike), at most
    ``max_copies`` times; see inclusion(). The whole part of that number are certain copies. For the
    fraction p of one more, the source's documents are ranked by the odds of a fixed random number over the
    odds of their own p (Pareto order sampling) and taken in that order while their words stay within those
    that the source still misses: a sample of fixed size in words. The first document that does not fit is
    skipped, and the walk goes on with those small enough for the gap, twice; at last one more document is
    taken if that brings the source nearer to its target.

    The rank at which a walk stops is found on a histogram (source x 4096 cells), so that no task ever
    sorts a whole source; only the documents of the one cell in which the words run out are put in order. Documents with
    nothing left to draw (p = 0, as in a source that is taken ``max_copies`` times) are not ranked at all.

    Defined results: null text has size 0; size 0 takes 0 words; a null source is a source of its own, the
    last; rows with one id draw the same random number, and those that agree in source and size as well are
    taken all or none; equal ranks go by id, then size; an empty table gives an empty table. Added columns
    replace same-named ones; no other name of a column can clash.
    """
    drawn = packed(docs, id=id_col, source=F.col(source_col).cast("string"), size=word_count(F.col(text_col)), u=uniform(F.col(id_col), seed=seed))
    base = drawn.groupBy("id", "source", "size", "u").agg((F.count(F.lit(1)) * F.col("size")).alias("mass"))
    base = materialize(base.withColumn("band", size_band(F.col("size"))), "sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("mass").alias("source_size")), cycle=cycle, max_copies=max_copies)
    targets = materialize(targets, "targets")
    rates = materialize(inclusion(base.groupBy("source", "band").agg(F.sum("mass").alias("words")), targets, power=power, max_copies=max_copies), "rates")
    ranked = _ranked(base, rates).where("p > 0")
    missing = targets.join(rates.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("sure") * F.col("words")).alias("sure")), F.col("source").eqNullSafe(F.col("s")), "left")
    unit = f"struct<q:double,id:{docs.schema[id_col].dataType.simpleString()},size:bigint>"
    state = missing.select(F.col("source").alias("src"), "source_size", "target", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("gap0"), F.lit(None).cast(unit).alias("after0"))
    for k in range(_WALKS):
        state = _walk(ranked, state, unit, k)
    near = F.abs(F.col("mass") - F.col(f"gap{_WALKS}"))
    rest = _by_source(ranked, state, "source").where(~_taken() & (near < F.col(f"gap{_WALKS}")))
    last = rest.groupBy(F.col("source").alias("s")).agg(F.min_by(_unit(), F.struct(near, "q", "id", "size")).alias("last"))
    rules = materialize(state.join(last, F.col("src").eqNullSafe(F.col("s")), "left").drop("s"), "rules")

    out = _by_source(_ranked(drawn.withColumn("band", size_band(F.col("size"))), rates, "left"), rules, "source", "left")
    more = (F.col("p") > 0) & (_taken() | F.coalesce(_unit() == F.col("last"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")
    return unpacked(out, docs, {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": copies * F.col("size")})


def _unit() -> Column:
    return F.struct("q", "id", "size")


def _by_source(rows: DataFrame, keyed: DataFrame, column: str, how: str = "inner") -> DataFrame:
    return rows.join(keyed, F.col(column).eqNullSafe(F.col("src")), how).drop("src")


def _ranked(rows: DataFrame, rates: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``sure``, ``p`` and the Pareto rank q, as odds / (1 + odds) so that it lies in (0, 1)."""
    r = rates.select(F.col("source").alias("src"), F.col("band").alias("b"), "sure", "p")
    rows = rows.join(r, F.col("source").eqNullSafe(F.col("src")) & (F.col("band") == F.col("b")), how).drop("src", "b")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return rows.withColumn("q", F.when(F.col("p") > 0, odds / (1 + odds)))


def _between(k: int) -> Column:
    """Ranks that walk k looks at: past the document at which the walk before stopped, small enough for the gap."""
    return (F.col("size") <= F.col(f"gap{k}")) & (F.col(f"after{k}").isNull() | (_unit() > F.col(f"after{k}")))


def _taken() -> Column:
    """Whether one of the walks took the document: it looked at it and stopped later."""
    out = F.lit(False)
    for k in range(_WALKS):
        out = out | F.coalesce(_between(k) & (_unit() < F.col(f"after{k + 1}")), F.lit(False))
    return out


def _walk(ranked: DataFrame, state: DataFrame, unit: str, k: int) -> DataFrame:
    """Walk k down the ranks of each source adds the gap it leaves and the first unit that did not fit."""
    gap = F.col(f"gap{k}")
    cell = F.floor(F.col("q") * _CELLS)
    rows = _by_source(ranked, state.select("src", gap, F.col(f"after{k}")).where(gap > 0), "source").where(_between(k)).withColumn("cell", cell)
    cells = rows.groupBy("source", "cell").agg(F.sum("mass").alias("words"))
    cells = materialize(cells.withColumn("end", F.sum("words").over(Window.partitionBy("source").orderBy("cell"))), f"cells{k}")
    # the cell in which the words run out, and what is missing at its start
    left = cells.join(state.select("src", gap), F.col("source").eqNullSafe(F.col("src"))).withColumn("left", gap - F.col("end") + F.col("words"))
    border = left.where((F.col("left") >= 0) & (F.col("left") < F.col("words"))).select("src", F.col("cell").alias("at"), "left")
    run = F.sum("mass").over(Window.partitionBy("source").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = _by_source(rows, border, "source").where("cell = at").withColumn("run", run)
    used = F.coalesce(F.max(F.when(F.col("run") <= F.col("left"), F.col("run"))), F.lit(0))
    stops = last.groupBy(F.col("source").alias("s1")).agg((F.first("left") - used).alias("left"), F.min(F.when(F.col("run") > F.col("left"), _unit())).alias("stop"))
    totals = cells.groupBy(F.col("source").alias("s2")).agg(F.max("end").alias("end"))
    out = state.join(stops, F.col("src").eqNullSafe(F.col("s1")), "left").join(totals, F.col("src").eqNullSafe(F.col("s2")), "left")
    end = F.struct(F.lit(2.0).alias("q"), F.lit(None).alias("id"), F.lit(None).alias("size")).cast(unit)  # everything fitted
    after = F.coalesce("left", gap - F.coalesce("end", F.lit(0))).alias(f"gap{k + 1}")
    return materialize(out.select(*state.columns, after, F.coalesce("stop", end).alias(f"after{k + 1}")), f"walk{k}")
