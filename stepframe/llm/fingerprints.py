"""Lempel-Ziv phrase fingerprints: minimum-hash signatures of a document's dictionary phrases."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import from_texts, mix64

SIZE = 128


#: A phrase dictionary in the making: (parent << 8 | byte) -> phrase << 8 in the order of phrases, and the
#: phrase that the next byte may lengthen. Phrases count from 1; 0 is the empty one.
State = tuple[dict[int, int], int]


def lz_parse(data: bytes, state: State | None = None) -> State:
    """LZ78: cut ``data`` into the shortest phrases not met before; a rest that is a known phrase adds none."""
    known, node = state or ({}, 0)
    find, last = known.get, len(known) << 8
    for byte in data:
        key = node | byte
        node = find(key)
        if node is None:
            last += 256
            known[key] = last
            node = 0
    return known, node


def phrase_hashes(dictionaries: list[dict[int, int]]) -> list[np.ndarray]:
    """A 64-bit hash of the bytes of each phrase, for many dictionaries at once.

    A phrase is its parent and a byte; hashes are put together by pointer doubling, so that the number of
    vector operations is the logarithm of the longest phrase.
    """
    sizes = np.array([len(d) + 1 for d in dictionaries])
    first = np.concatenate([[0], np.cumsum(sizes)])
    total, base = int(first[-1]), np.uint64(0x9E3779B97F4A7C15)
    hashes, power, parent = np.zeros(total, np.uint64), np.ones(total, np.uint64), np.repeat(first[:-1], sizes)
    for d, a in zip(dictionaries, first[:-1].tolist()):
        keys = np.fromiter(d, np.int64, len(d))
        parent[a + 1 : a + 1 + len(d)] += keys >> 8
        hashes[a + 1 : a + 1 + len(d)] = (keys & 255) + 1
        power[a + 1 : a + 1 + len(d)] = base
    root = np.repeat(first[:-1], sizes)
    while (parent != root).any():
        hashes += hashes[parent] * power
        power *= power[parent]
        parent = parent[parent]
    return [hashes[a + 1 : a + n] for a, n in zip(first[:-1].tolist(), sizes.tolist())]


def signature(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ``size`` smallest distinct hashes in ascending order, as 32 bits each."""
    h = np.unique((mix64(hashes) >> np.uint64(32)).astype(np.uint32))
    return h[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Jaccard likeness of two phrase sets, estimated from the smallest hashes of their union."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0  # both empty
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).mean())


def to_hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def fingerprints(rows: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Signatures of whole texts; an empty text has an empty signature."""
    return [signature(h, size) for h in phrase_hashes([lz_parse(t.encode("utf-8", "replace"))[0] for t in rows])] if rows else []


def parse_with_edit(text: str, cut: int, tail: str) -> tuple[dict[int, int], dict[int, int]]:
    """Dictionaries of a text and of that text with ``tail`` for its last ``cut`` characters; what both begin with is parsed once."""
    keep = len(text) - cut
    known, node = lz_parse(text[:keep].encode("utf-8", "replace"))
    other = lz_parse(tail.encode("utf-8", "replace"), (dict(known), node))[0]
    return lz_parse(text[keep:].encode("utf-8", "replace"), (known, node))[0], other


def lz_fingerprints(docs: DataFrame, *, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Add ``fingerprint`` (hex of the signature) of each whole text.

    Defined results: null texts count as empty, and an empty text has an empty fingerprint; equal texts have
    equal fingerprints, so repeated rows come back each with the same; an empty table gives an empty table;
    a column named ``fingerprint`` is replaced, all others pass through.
    """
    return from_texts(docs, text_col, {"fingerprint": pa.string()}, lambda rows: {"fingerprint": pa.array([to_hex(x) for x in fingerprints(rows, size)], pa.string())})


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, buckets: int | None = None, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Fingerprint every document and the edit of it whose last quarter is taken from the next document.

    Returns ``<id>, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``; ids are
    integers. The next document is that of the next id, the first one after the last. The texts are
    shuffled once, to buckets of id ranges between quantiles of the ids, about ``bucket_bytes`` of text and one
    task each; the first document of each bucket is also sent, as a guest, to the bucket before it, where it
    only serves as the next one. Rows are read in order one at a time, so no task holds a bucket; the driver
    gets one number a bucket.

    Defined results: null texts count as empty; two empty texts have likeness 1, an empty and another one
    0; rows of one id follow each other in the order of a hash of their text; a null id comes first; a
    single document is its own next; an empty table gives an empty table; other columns are not returned.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    total = 0 if buckets else d.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    bounds = np.array(sorted({int(b) for b in d.select("__id").na.drop().approxQuantile("__id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else [], np.int64)
    lowest = np.iinfo(np.int64).min  # stands for null; nothing sorts before either

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(lowest).astype("int64").to_numpy()))

    heads = d.select(F.coalesce("__id", F.lit(lowest)).alias("__id")).withColumn("b", bucket_of("__id")).groupBy("b").agg(F.min("__id").alias("id")).collect()
    heads = sorted((r.b, r.id) for r in heads)
    first_id = {b: i for b, i in heads}
    guest_of = {b: heads[k - 1][0] for k, (b, _) in enumerate(heads)}  # that of the first bucket is the last one

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        """Twice the bucket; for the first document of a bucket also twice the bucket before it and one."""
        ids = ids.fillna(lowest).astype("int64").to_numpy()
        own = np.searchsorted(bounds, ids).tolist()
        return pd.Series([[2 * b, 2 * guest_of[b] + 1] if first_id[b] == i else [2 * b] for i, b in zip(ids.tolist(), own)])

    dealt = d.withColumn("__place", F.explode(places("__id"))).withColumn("__b", F.shiftright("__place", 1).cast("int")).withColumn("__h", F.xxhash64("__text"))
    dealt = dealt.repartitionById(n, F.col("__b")).sortWithinPartitions("__place", F.col("__id").asc_nulls_first(), "__h", "__text").select("__place", "__id", "__text")
    fields = {"__id": pa.int64(), "n_chars": pa.int64(), "edited": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def follow(batches):
        rows: list[tuple] = []  # (id, text, edited, dictionary, edited dictionary) of documents in a row
        waiting = None  # (id, text) of the document whose next one is to come

        def add(doc, text, following):
            cut = len(text) // 4
            tail = following[:cut]
            rows.append((doc, len(text), text[: len(text) - cut] + tail, *parse_with_edit(text, cut, tail)))

        def finished(following):
            """The rows so far; ``following``: the text that comes after the last of them."""
            hashes = phrase_hashes([r[3] for r in rows] + [r[4] for r in rows] + [lz_parse(following.encode("utf-8", "replace"))[0]])
            found = [signature(h, size) for h in hashes]
            own, other = found[: len(rows)], found[len(rows) : -1]
            after = [*own[1:], found[-1]]
            columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [*map(to_hex, own)], [*map(to_hex, other)], [likeness(x, y, size) for x, y in zip(own, other)], [likeness(x, y, size) for x, y in zip(own, after)]]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))

        held = 0
        for batch in batches:
            for place, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if waiting is not None:
                    add(*waiting, text)
                    held += len(waiting[1])
                    if place % 2 or held > 1_000_000 or len(rows) >= 500:
                        yield finished(text)
                        held = 0
                waiting = None if place % 2 else (doc, text)  # after a guest the bucket has ended

    schema = ", ".join(f"{k} {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}" for k, t in fields.items())
    return dealt.mapInArrow(follow, schema).withColumnRenamed("__id", id_col)
