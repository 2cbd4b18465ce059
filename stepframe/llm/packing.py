"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, quoted
from .mixing import word_count

LENGTHS = (512, 1024, 2048, 4096)


def bin_cost(length: int, overhead: int = 16) -> int:
    """Cost of one bin: its tokens, padding included, and a fixed cost a sequence."""
    return length + overhead


def _best_fit(sizes: Sequence[int], order: Sequence[int], lengths: Sequence[int], opens: Sequence[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing; a piece whose shortest fitting length is number k opens length number ``opens[k]``."""
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[tuple[int, int]] = []  # (room, bin) in ascending order
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = lengths[opens[bisect_left(lengths, size)]], len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = 16, rounds: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing with bins of variable capacity: bin and offset of each piece, length of each bin.

    A piece goes to the open bin that it leaves the least room in (ties: the oldest). If none has room, a
    length opens that depends on the shortest one that would hold the piece. Which one is planned on the
    pieces themselves: every single length (or the shortest that fits, where longer) is tried, and from the
    cheapest on, the choice for each shortest length in turn is changed as long as the cost of all bins
    falls. At the end of each trial every bin shrinks to the shortest permitted length that holds its contents.
    Pieces go in by ``rounds`` (all in one by default), in each by descending size.
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (rounds[i] if rounds else 0, -sizes[i], i))
    tried: dict[tuple[int, ...], int] = {}
    best: tuple[int, tuple[int, ...], tuple[np.ndarray, np.ndarray, list[int]]] | None = None

    def attempt(opens: tuple[int, ...]) -> None:
        nonlocal best
        if opens not in tried:
            packed = _best_fit(sizes, order, lengths, opens)
            tried[opens] = sum(bin_cost(c, overhead) for c in packed[2])
            if best is None or tried[opens] < best[0]:
                best = tried[opens], opens, packed

    n = len(lengths)
    for c in range(n):
        attempt(tuple(max(k, c) for k in range(n)))
    present = sorted({bisect_left(lengths, s) for s in sizes}, reverse=True)
    before = None
    while before != best[0]:
        before = best[0]
        for k in present:
            for c in range(k, n):
                attempt((*best[1][:k], c, *best[1][k + 1 :]))
    return best[2]


def best_fit_packing(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, overhead: int = 16, shard_tokens: int = 16_000_000) -> DataFrame:
    """Pack whole documents into training sequences; one row a piece.

    Returns ``<id>, piece, piece_start, piece_len, bin_id, bin_len, bin_offset``. Lengths are words. A
    document longer than the longest permitted length is cut into pieces of that length and a rest, so
    that no word is lost. The lengths are written once, and their pieces dealt at random (by row and piece, so
    that copies of a document part) to shards of about ``shard_tokens`` words. Each shard is packed on its
    own: what that costs against one packing of everything is at most the last, part-filled bins of each
    shard, times the rounds. Only (id, piece, length) are shuffled, never texts.

    Defined results: a text without words (null, empty) gives one row with piece_len 0 and no bin; rows
    that share an id are packed as rows of their own, numbered apart by nothing but their bins; a shard's
    first rows of each id are packed first, then the second ones and then all others, so that copies rarely share
    a bin; equal lengths go by id and piece; an empty table gives an empty table; other columns are not
    returned, so none can clash.
    """
    longest, names = max(lengths), ["id", "piece", "piece_start", "piece_len"]
    sized = docs.select(F.col(quoted(id_col)).alias("id"), word_count(F.col(quoted(text_col))).alias("n"), F.monotonically_increasing_id().alias("row"))
    sized = materialize(sized, "sizes")
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("long")
    pieces = sized.select("id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("id", "row", "piece", (F.col("piece") * longest).alias("piece_start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("long").alias("piece_len"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = pieces.where("piece_len > 0").select(*names, F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))

    def pack_shard(key, pieces):
        pieces = pieces.sort_by([("id", "ascending"), ("piece", "ascending")])
        same = pc.and_(*[pc.fill_null(pc.equal(pieces[k][1:], pieces[k][:-1]), False) for k in ("id", "piece")]) if len(pieces) > 1 else []
        at = np.arange(len(pieces))
        start = np.concatenate([[True], ~np.asarray(same, bool)]) if len(pieces) else np.zeros(0, bool)
        copy = at - np.maximum.accumulate(np.where(start, at, 0))
        bins, offsets, sizes = pack(pieces["piece_len"].to_pylist(), lengths, overhead, np.minimum(copy, 2).tolist())
        ids = [f"{key[0].as_py()}-{b}" for b in bins]
        return pa.table({**{n: pieces[n] for n in names}, "bin_id": pa.array(ids, pa.string()), "bin_len": pa.array([sizes[b] for b in bins], pa.int64()), "bin_offset": pa.array(offsets)})

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece long, piece_start long, piece_len long, bin_id string, bin_len long, bin_offset long"
    filled = dealt.groupBy("shard").applyInArrow(pack_shard, schema)
    empty = pieces.where("piece_len <= 0").select(*names, F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_len"), F.lit(None).cast("long").alias("bin_offset"))
    return filled.unionByName(empty).withColumnRenamed("id", id_col)
