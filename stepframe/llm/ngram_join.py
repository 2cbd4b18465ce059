"""Exact Jaccard self-join of word n-gram sets: rare shared n-grams bring documents together, signature
trees compare them, and links are followed to components."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, keyed_join, materialize, mix64, quoted, texts, word_hashes
from .components import components
from .signature_tree import linked_components

def shingles(text: str, n: int) -> np.ndarray:
    """The set of hashes of the n-word shingles of a text, in ascending order; A-Z are lower-cased.

    With fewer than n words the whole sequence is the one shingle; without words the set is empty.
    """
    words = word_hashes(text.encode("utf-8", "replace").lower())
    size = min(n, len(words))
    if not size:
        return words
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(h)])
    return np.unique(h)


#: Largest size of each class of sets, and how many of its shingles (those of lowest hashes) are counted, as a
#: multiple of what the prefix filter looks at; more than all means all.
CLASSES = ((150, 100.0), (600, 2.7), (None, 1.35))


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, classes: tuple = CLASSES, cell_tokens: int = 2_000_000) -> DataFrame:
    """``<id>, n_shingles, component_id`` for every row: its set's size and the least id reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of n-word shingles.
    No link is lost, and no pairs are listed:

    1. Equal sets become one (by a 128-bit digest and the size), with partial aggregates.
    2. In any one order of all shingles, linked sets of sizes a, b share one of the first size -
       ceil(percent/100 size) + 1 (prefix filter). The order: hashes below a share of their range come first,
       by ascending document count and hash; the others by hash. So only the low ones (and what a small
       set lacks) are counted and shuffled, and a set whose rare shingles fill its prefix is out: nothing else
       has them. Their share falls with the size, in ``classes``; a set within percent of a bound is
       in both classes, so every possible pair shares a class, and an order.
    3. A shingle that several sets have in their prefix connects them to the first of them; the connected
       components of that are candidate groups. Every linked pair lies in one group.
    4. The texts of candidates are brought together by group, and each group is compared by a signature
       tree with union-find. A group of over ``cell_tokens`` shingles is dealt at random to cells, each
       with the group's first set. A task thus holds about ``cell_tokens`` shingles at a time, however
       large a group. What may link between cells is then compared on the cheaper of two ways, by group:
       all outside the group's largest component meets all its cells in blocks (near copies hang together,
       so little is left), or sets meet in lots, one for each shingle that differing components share
       (groups that are chains of passages, where lots are small).

    Rows meet the component of their set, and sets the name of theirs, by keyed_join(): copies or components
    of over 1/1024 of all rows are broadcast, so no task gets a third of them.

    Defined results: null texts and texts without words have size 0 and link with nothing, their component
    is their own id; rows of one id are compared each for itself; a null id never names a component that
    has another id; ties need no order as links are symmetric; an empty table gives an empty table; other
    columns are not returned, so none can clash.
    """
    limits = [min(int(times * (100 - percent) / 100 * 2**63), 2**63 - 1) & ~3 for _, times in classes]  # hashes are shuffled as longs without sign
    bounds = [(0 if k == 0 else classes[k - 1][0] * percent // 100, top or 2**62) for k, (top, _) in enumerate(classes)]

    def sets(batches):
        for batch in batches:
            size, digest, first, lows = [], [], [], []
            for text in texts(batch, "__text"):
                s = shingles(text, n)
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                s = np.sort((s >> np.uint64(1)).astype(np.int64))
                prefix, counts, own = len(s) + (-percent * len(s) // 100) + 1, [0] * len(classes), []
                for k, (low, high) in enumerate(bounds):
                    if len(s) and low <= len(s) <= high:
                        counts[k] = int(np.searchsorted(s, limits[k]))
                        own.append((s[: max(prefix, counts[k])] & ~3) | k)  # the class in the last two bits
                first.append(np.concatenate(own) if own else s)
                lows.append(counts)
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            flat, ends = np.concatenate(first) if first else np.zeros(0, np.int64), np.cumsum([0, *map(len, first)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(lows, pa.list_(pa.int32()))], names=["id", "t", "n", "d1", "d2", "first", "lows"])

    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(F.col(quoted(text_col))).alias("__t"), F.col(quoted(text_col)).alias("__text"))
    rows = source.mapInArrow(sets, f"id {id_type}, t long, n long, d1 long, d2 long, first array<long>, lows array<int>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    kinds = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("row", "id", "t")).alias("k"), F.first("first").alias("first"), F.first("lows").alias("lows"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    kinds = materialize(kinds.select("d1", "d2", "n", F.col("k.row").alias("row"), F.col("k.id").alias("id"), F.col("k.t").alias("t"), "first", "lows", "least", "copies"), "kinds")
    everything, rows = rows, materialize(rows.select("id", "n", "d1", "d2"), "slim_rows")
    discard(everything)

    # document counts of the shingles that could be in a prefix; those of one set bring nothing together
    spread = kinds.select("row", F.explode("first").alias("h"))
    shared = spread.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    k = F.col("h").bitwiseAND(F.lit(3)).cast("int")
    high = F.col("h") >= F.element_at(F.array(*[F.lit(x) for x in limits]), k + 1)
    held = spread.join(shared, "h").groupBy("row", k.alias("k")).agg(F.sort_array(F.collect_list(F.struct(high.alias("high"), "df", "h"))).alias("held"))
    held = held.join(kinds.select("row", "n", "lows"), "row")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1  # exact for sizes below 2^45
    rest = prefix - (F.element_at("lows", F.col("k") + 1) - F.size(F.filter("held", lambda x: ~x["high"])))
    reached = held.select("row", F.explode(F.slice("held", F.lit(1), F.greatest(rest, F.lit(0)).cast("int"))["h"]).alias("h"))
    heads = reached.groupBy("h").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    linked = materialize(reached.join(heads, "h"), "linked")
    groups = components(linked.select(F.col("row").alias("a"), F.col("head").alias("b")))

    members = groups.join(kinds.select("row", "id", "t", "n", "d1"), groups["node"] == kinds["row"]).select("root", "row", "id", "t", "n", "d1")
    totals = members.groupBy("root").agg(F.ceil(F.sum("n") / cell_tokens).cast("int").alias("cells"))
    members = materialize(members.join(totals, "root"), "members")
    large = members.where("cells > 1")
    if large.isEmpty():
        large = None
        discard(linked)
    everything, kinds = kinds, materialize(kinds.drop("first", "lows"), "slim_kinds")
    discard(everything)
    bucket = F.pmod(F.xxhash64("row", F.lit(1)), F.col("cells")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("cells") - 1)
    placed = members.withColumn("cell", F.explode(F.when(F.col("row") == F.col("root"), everywhere).otherwise(F.array(bucket))))
    found = _compare(source, placed.select("root", "cell", "row", "id", "t", "d1", F.col("row").alias("label")), n, percent)
    found = materialize(found, "links")
    if large is not None:
        found = found.union(_across(source, large, linked.select("row", "h"), found, n, percent, cell_tokens))
        found = components(found.select(F.col("row").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("row"), F.col("root").alias("label"))

    kinds = kinds.join(found.where("row <> label").dropDuplicates(["row"]).withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    kinds = materialize(kinds.select("d1", "d2", "n", "least", "copies", F.coalesce("label", "row").alias("label")), "labels")
    least = materialize(kinds.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    named = keyed_join(kinds.drop("least"), least, ["label"], "members", kinds.count()).drop("label")
    named = materialize(named, "named")
    out = keyed_join(rows.where("n > 0"), named, ["d1", "d2", "n"], "copies", rows.count())
    out = out.select("id", "n", "component_id").union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _compare(source: DataFrame, placed: DataFrame, n: int, percent: int) -> DataFrame:
    """Compare the sets of each (root, cell): ``row, label`` with the label of its component in the cell.

    ``placed``: root, cell, row, id, t, d1, label; rows with equal labels count as connected already. Texts are
    found by id and hash of the text, so that rows of one id (all that have none) don't meet each other's.
    """
    # never by broadcast, whatever the size: the number of candidates grows with the corpus
    texts_of = source.join(placed.hint("merge"), source["__id"].eqNullSafe(placed["id"]) & (source["__t"] == placed["t"])).select("root", "cell", "row", "d1", "label", "__text")
    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts_of.repartition(partitions, "root", "cell").sortWithinPartitions("root", "cell", "row")

    def cells(batches):
        key, own = None, []

        def finish():
            seen = {row: (label, s) for row, label, s in own}  # texts that share an id are told apart by digest
            ids, labels, found = list(seen), np.array([x[0] for x in seen.values()], np.int64), [x[1] for x in seen.values()]
            first = linked_components(found, percent, labels)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels[first])], names=["row", "label"])

        for batch in batches:
            for root, cell, row, d1, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, cell) != key:
                    if own:
                        yield finish()
                    key, own = (root, cell), []
                s = shingles(text or "", n)
                if np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0] == d1:
                    own.append((row, label, s))
        if own:
            yield finish()

    return dealt.mapInArrow(cells, "row long, label long")


def _across(source: DataFrame, large: DataFrame, linked: DataFrame, found: DataFrame, n: int, percent: int, cell_tokens: int) -> DataFrame:
    """Links between the cells of the groups in ``large``; ``linked``: row, h for each shingle shared by prefixes.

    Either way every two sets that share a prefix shingle, and so every linked pair, are connected already
    or meet. The price of a way is the shingles of all copies of sets that it deals.
    """
    known = components(found.join(large.select("row").distinct(), "row").select(F.col("row").alias("a"), F.col("label").alias("b")))
    now = large.join(known.withColumnRenamed("root", "label"), large["row"] == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", "row"))
    now = materialize(now, "across")
    most = now.groupBy("root", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    outside = F.when(F.col("label") != F.col("main"), F.col("n"))
    prices = now.join(most, "root").groupBy("root", "main").agg(F.sum("n").alias("all"), F.sum(outside).alias("outside"), F.max("cells").alias("most")).where("outside > 0")
    prices = prices.withColumn("blocks", F.ceil(F.col("outside") / cell_tokens).cast("int"))

    # a lot for each set of holders; those of one component hold nothing new, and equal holders meet once
    held = linked.join(now.select("row", "root", "label", "n"), "row")
    lots = held.groupBy("root", "h").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("tokens"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    lots = lots.where("low < high").groupBy("root", "c", "x", "y").agg(F.min("h").alias("h"), F.ceil(F.first("tokens") / cell_tokens).cast("int").alias("parts"), F.first("tokens").alias("tokens"))
    lots = materialize(lots.select("root", "h", "c", "parts", "tokens"), "lots")
    by_lots = lots.groupBy("root").agg(F.sum(F.col("tokens").cast("double") * F.col("parts")).alias("by_lots"))
    by_cells = F.col("blocks").cast("double") * F.col("all") + F.col("most").cast("double") * F.col("outside")
    ways = prices.join(by_lots, "root", "left").withColumn("split", F.coalesce("by_lots", F.lit(0.0)) < by_cells)
    ways = materialize(ways.select("root", "main", "blocks", "split"), "ways")

    wanted = ["root", "cell", "row", "id", "t", "d1", "label"]
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = lambda seed, c: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(c)).cast("int")
    whole = now.join(ways.where("NOT split"), "root")
    meets_blocks = whole.select("*", F.explode(upto("blocks")).alias("block"), dealt(1, "cells").alias("bucket"))
    meets_buckets = whole.where("label <> main").select("*", dealt(2, "blocks").alias("block"), F.explode(upto("cells")).alias("bucket"))
    placed = meets_blocks.union(meets_buckets).withColumn("cell", (F.col("block") * F.col("cells") + F.col("bucket")).cast("int")).select(*wanted)

    # a lot of over cell_tokens is dealt to parts, and every two of them meet in a cell
    taken = lots.join(ways.where("split").select("root"), "root", "left_semi").select("h", "c", "parts")
    apart = keyed_join(linked, taken, ["h"], "c", linked.count()).join(now.drop("root"), "row")
    apart = apart.select("*", dealt(3, "parts").alias("part"), F.explode(upto("parts")).alias("other"))
    apart = apart.withColumn("cell", F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).withColumnRenamed("h", "root")
    placed = placed.union(apart.select(*wanted)).distinct()
    return materialize(_compare(source, placed, n, percent), "across_links").union(now.select("row", "label"))
