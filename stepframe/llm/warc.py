"""Content-addressed WARC archive: payload bytes once by verified digest, exact record headers apart."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import HOT, keyed_join, materialize, quoted

CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(id_col: Column) -> Column:
    """A URN made of the page's id, so that a rerun writes the same bytes and a reader finds the id again."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(id_col.cast("string")), F.lit(">")), F.lit("<urn:page>"))


def _page_id(urn: Column, id_type: str) -> Column:
    return F.when(urn.startswith("<urn:page:"), F.url_decode(F.regexp_extract(urn, "^<urn:page:([^>]*)>$", 1)).cast(id_type))


#: Over how many tasks the records of a payload are dealt that over 1/HOT of all records have.
_SALTS = 32


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one WARC record a page below ``path``: ``headers`` (exact header bytes) and ``payloads``.

    A payload is the UTF-8 of the page's html (null: empty) and is stored once per SHA-256. Of pages with
    equal payloads of at least ``min_bytes`` bytes the smallest id is a response and the others are
    revisits that refer to it; smaller ones are all responses. Equality is by SHA-256 and byte length.

    Payloads are shuffled once, by digest, after equal ones have been merged within each task; so one that a
    third of all pages share is no hot spot. The headers are joined to (digest, smallest id) alone, those of
    payloads that over 1/1024 of all pages have by a broadcast (keyed_join).

    Defined results: repeated rows of one id are separate records with the same record id; a null id is
    larger than every other; null urls give an empty target;
    CR and LF in a url are percent-encoded, so a header can't be broken; an empty table gives two empty tables.
    """
    payload = F.coalesce(F.col(quoted(html_col)), F.lit("")).cast("binary")
    keyed = pages.select(F.col(quoted(id_col)).alias("page_id"), F.coalesce(F.col(quoted(url_col)), F.lit("")).alias("url"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("n"), payload.alias("payload"))
    # copies within a task are merged before the shuffle, so a payload moves at most once a task
    stored = keyed.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "n", "first", "copies")
    keyed = materialize(keyed.drop("payload"), "records")
    copy = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(copy, F.lit(0)).otherwise(F.col("n"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(copy, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.when(copy, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first")))),
        F.when(copy, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]  # concat_ws leaves null lines out
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)
    records = keyed_join(keyed, first, ["digest", "n"], "copies", keyed.count())
    records.select(header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, *, id_type: str = "bigint") -> DataFrame:
    """The archive's records, rebuilt by joins: ``page_id, record_type, refers_to, payload_digest,
    payload_bytes, header, payload, record`` (the record's exact bytes, without payload for revisits).

    Ids (as ``id_type``), type and digest are parsed from the headers: the archive needs nothing beside its
    records. Every stored payload is hashed again; a payload that does not have the digest it is stored
    under, or a header without payload, stops the read with an error. The records of a payload that over
    1/1024 of them have are dealt over 32 tasks, each with a copy of the payload.

    Defined results: a null id comes back as null; repeated records come back each; an empty archive gives
    an empty table; the columns are the archive's own, so none can clash.
    """
    field = lambda name: F.regexp_extract(F.col("text"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    headers = spark.read.parquet(f"{path}/headers").withColumn("text", F.decode("header", "utf-8"))
    headers = headers.select(
        "header",
        _page_id(field("WARC-Record-ID"), id_type).alias("page_id"),
        _page_id(field("WARC-Refers-To"), id_type).alias("refers_to"),
        field("WARC-Type").alias("record_type"),
        F.substring(field("WARC-Payload-Digest"), 8, 64).alias("digest"),
    )
    stored = spark.read.parquet(f"{path}/payloads")
    total = stored.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT > total
    salts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    payloads = stored.select(F.col("digest").alias("under"), "payload", salts).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    headers = headers.join(F.broadcast(stored.where(hot).select(F.col("digest").alias("hot"))), F.col("digest") == F.col("hot"), "left")  # at most HOT rows
    headers = headers.withColumn("part", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("header"), F.lit(_SALTS)).cast("int")).otherwise(F.lit(0)))
    joined = headers.join(payloads, (F.col("digest") == F.col("under")) & (F.col("part") == F.col("salt")), "left")
    sound = F.when(F.col("payload_digest") == F.col("digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("digest"))))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("page_id", "record_type", "refers_to", sound.alias("payload_digest"), "payload_bytes", "header", "payload", F.concat("header", body, F.lit((CRLF * 2).encode())).alias("record"))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of concatenated WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + size
