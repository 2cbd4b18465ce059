"""What the corpus operators share: tables, the shared folder, Arrow plumbing and vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: The characters that separate words in every contract of this package.
WHITESPACE = " \t\n\x0b\x0c\r"
#: The same as a Java/RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``.

    Where that is unset, a local folder is made, but only under a local master: executors elsewhere would
    write to disks that nobody else reads. The session's settings are not changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + _local()
    return f"{base.rstrip('/')}/stepframe/{spark.sparkContext.applicationId}"


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="stepframe-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; lazy results that read them can't be computed after it."""
    _delete(spark, shared_base(spark))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back with its schema."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stepframe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    _delete(df.sparkSession, df._stepframe_path)


#: Keys that hold over this part of all rows are hot; so there are at most as many of them.
HOT = 1024


def keyed_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, *, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keyed`` (one row a key; ``count``: how many of ``rows``, ``total`` in all, have it).

    Hot keys, of which there are at most HOT whatever the data, are broadcast; the rows of all others are
    shuffled, and none of their keys has over 1/HOT of the rows. Null keys match nothing.
    """
    hot = keyed.where(F.col(count) * HOT > total)
    many = rows.join(F.broadcast(hot.drop(count)), keys)
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(count) * HOT <= total).drop(count), keys, how)
    return many.unionByName(few)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, **columns) -> DataFrame:
    """The user's row as the one column ``row``, so that no column of it can clash, and what else is asked for."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[(F.col(quoted(v)) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, docs: DataFrame, new: dict) -> DataFrame:
    """The columns of ``docs`` out of ``row`` and the new ones, which replace those of the same name, last."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def with_arrow(df: DataFrame, fields: dict[str, pa.DataType], fn: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """Append the columns that ``fn`` computes from each Arrow batch; same-named columns of ``df`` are replaced."""
    kept = [c for c in df.columns if c not in fields]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, from_arrow_type(t)) for n, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [new[n].cast(t) for n, t in fields.items()], names=[*kept, *fields])

    return df.mapInArrow(run, schema)


def from_texts(docs: DataFrame, text_col: str, fields: dict[str, pa.DataType], fn: Callable[[list[str]], dict[str, pa.Array]]) -> DataFrame:
    """Append what ``fn`` computes from the texts (null as empty) of each batch; same-named columns of ``docs`` are replaced."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return fn([x or "" for x in batch.column(0).field(text_col).to_pylist()])

    return unpacked(with_arrow(packed(docs), fields, run), docs, {c: F.col(c) for c in fields})


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b % 2**64, np.uint64))]) for b in (_ODD, pow(_ODD, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] (bytes) for many spans at once, equal for equal bytes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes of text hashed at once.
_BLOCK = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in blocks so that long texts need little more memory than they have words."""
    out, at = [], 0
    array = np.frombuffer(data, np.uint8)
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        block = array[at:end]
        out.append(span_hashes(block, *word_spans(block)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def uniform(*columns, seed: int = 0):
    """A number in (0, 1) that depends on the columns and the seed only; SQL can restate it (md5)."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
