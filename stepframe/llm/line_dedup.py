"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WHITESPACE, keyed_join, materialize, packed, unpacked, with_arrow

_BLANK = WHITESPACE.encode()


def _keys(text: str, min_chars: int) -> list[bytes | None]:
    """For each line the 128-bit hash of its key, None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in text.encode().lower().split(b"\n"):  # bytes.lower() changes A-Z only
        key = line.strip(_BLANK)
        n = len(key)
        long = n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that many documents share; adds ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` distinct ids hold lose all their lines, except
    those in the largest id that holds the key. Other lines stay, joined by a line feed.

    The texts are exploded once: (hash, id) of the distinct long lines are written, and everything up to the drop
    lists reads that table. Counts are partial aggregates. Keys that over 1/1024 of all lines have, of which
    there are at most 1024, meet their lines by a broadcast, all others by a shuffle; so a line in a third
    of all documents lands in no one task. Each text is then shuffled once, to meet its own drop list,
    which is never longer than the document.

    Defined results: null text counts as empty, an empty text is one empty line; rows that share an id
    are one document for the count, and a null id is a document smaller than every other; repeated lines
    within a document all stay or all go; an empty table gives an empty table; columns of ``docs`` named
    like the added ones are replaced, all others pass through, whatever their names.
    """

    def explode(batches):
        for batch in batches:
            ids, rows, found = batch.column(0), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {k for k in _keys(text or "", min_chars) if k}
                rows += [i] * len(own)
                found += own
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "h1", "h2"])

    id_type = docs.schema[id_col].dataType.simpleString()
    source = packed(docs, id=id_col, text=text_col)
    lines = materialize(source.select("id", "text").mapInArrow(explode, f"id {id_type}, h1 long, h2 long"), "lines")
    counts = lines.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    counts = materialize(counts, "shared_lines")
    met = keyed_join(lines, counts, ["h1", "h2"], "n", lines.count())
    drops = met.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias("of")).agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))

    def reassemble(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(col("text").to_pylist(), col("drops")):
            text = text or ""
            if not drop.is_valid:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                kept.append(text)
                continue
            gone = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in drop.as_py()}
            lines = text.split("\n")
            stay = [line for line, k in zip(lines, _keys(text, min_chars)) if k is None or k not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        return {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_text": pa.array(kept, pa.string())}

    joined = source.join(drops, F.col("id").eqNullSafe(F.col("of")), "left").drop("of")
    added = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "kept_text": pa.string()}
    return unpacked(with_arrow(joined, added, reassemble), docs, {c: F.col(c) for c in added})
