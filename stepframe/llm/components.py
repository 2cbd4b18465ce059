"""Connected components of a graph of any size, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b of type long); root is the component's least node.

    Alternates the large-star and small-star steps: every node links its larger neighbours, then its
    smaller ones and itself, to the least node it knows. Each step is one aggregate by node (partial, so a
    node with very many neighbours is no hot spot) and one join that adaptive execution can split. The
    edges are written to the shared folder after each round, which cuts the lineage.

    Defined results: loops and rows with null are ignored, repeated edges count once, no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = materialize(e, "edges0"), None
    for i in range(rounds):
        # a star forest is a fixed point of both steps
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"edges{i + 1}")
    raise RuntimeError(f"no star forest after {rounds} rounds")
