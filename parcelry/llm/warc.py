"""WARC archives without repeated payloads.

Headers, without payloads, are shuffled by payload digest; of the records of a digest the one
with the smallest id stays a response and the others become revisits of it. The archives are
then written with fresh headers: a revisit has no payload, and names the response. Reading
parses the archives record by record, by Content-Length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.session import Staging

END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGES = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, target_uri string, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in upper-case base32, 32 digits."""
    hexadecimal = F.sha1(payload)
    digits = [
        F.lpad(F.conv(F.substring(hexadecimal, at, 10), 16, 32), 8, "0")
        for at in range(1, 41, 10)
    ]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def resolve_revisits(pages: DataFrame, staging: Staging, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``payload``, ``n_bytes``, ``digest``, ``revisit`` and
    ``refers_to``.

    ``refers_to`` is the id of the response that a revisit repeats, NULL for a response. Payloads
    of fewer than ``min_bytes`` bytes are all responses. A NULL html is the empty payload. A NULL
    id is larger than all others; of equal ids the smaller URL goes first. Rows that are equal
    in all three stay apart, and one of them is the response.

    Only headers are grouped, with partial sums in every task, so many copies of a payload do
    not meet in one task. The decisions on repeated digests are joined back with the payloads:
    Spark may broadcast them if they are few, and split hot digests if they are not. They are
    read from the staging folder, so use the result before the staging ends.
    """
    records = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("n_bytes"),
        base32_sha1(F.col("payload")).alias("digest"),
    )
    header = ["page_id", "url", "digest", "n_bytes"]
    heads = staging.write(records.select(*header).where(F.col("n_bytes") >= min_bytes)).frame
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    firsts = staging.write(
        heads.groupBy(*header)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "n_bytes")
        .agg(F.min_by(F.struct("page_id", "url", "n"), order).alias("x"), F.sum("n").alias("copies"))
        .where("copies > 1")
        .select(
            "digest",
            F.col("n_bytes").alias("first_bytes"),
            F.col("x.page_id").alias("first_id"),
            F.col("x.url").alias("first_url"),
            F.col("x.n").alias("equal"),
        )
    ).frame
    joined = records.join(firsts, "digest", "left")
    repeated = F.col("equal").isNotNull()
    first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))

    def resolved(frame: DataFrame, revisit: Column) -> DataFrame:
        return frame.withColumn("revisit", revisit).select(
            *header,
            "payload",
            "revisit",
            F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"),
        )

    doubled = firsts.where("equal > 1")
    if doubled.isEmpty():
        return resolved(joined, repeated & ~first)
    # Equal rows compete for being the response: one takes a payload, the others need none.
    several = repeated & first & (F.col("equal") > 1)
    ones = joined.where(several).dropDuplicates(["digest"])
    others = doubled.select(
        F.col("first_id").alias("page_id"),
        F.col("first_url").alias("url"),
        "digest",
        F.col("first_bytes").alias("n_bytes"),
        F.lit(None).cast("binary").alias("payload"),
        "first_id",
        F.explode(F.array_repeat(F.lit(1), (F.col("equal") - 1).cast("int"))),
    )
    return (
        resolved(joined.where(~several | ~repeated), repeated & ~first)
        .unionByName(resolved(ones, F.lit(False)))
        .unionByName(resolved(others, F.lit(True)))
    )


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archives(
    records: DataFrame, path: str, date: str, per_file: int = 4000, compression: str = "gzip"
) -> None:
    """Write the records of :func:`resolve_revisits` as WARC 1.1 files under ``path``.

    A file has ``per_file`` records at most. ``compression`` is a codec that Spark's text
    writer knows; a file is compressed as a whole. Breaks in a URL are percent-encoded, as a
    header is one line.
    """
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D")
    uri = F.regexp_replace(uri, "\n", "%0A")
    revisit = F.col("revisit")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("n_bytes")),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("n_bytes"))),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    (
        records.select(F.concat(header, F.lit(END), body).alias("value"))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", per_file)
        .option("compression", compression)
        .text(path)
    )


def _parse(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        begin, size = stop + 4, int(fields["Content-Length"])
        yield fields, data[begin : begin + size]
        at = begin + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        at += 4


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``, a row each; ``payload`` is NULL for revisits
    and if it is not asked for. A damaged record is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content and name.endswith(".gz"):
                    content = zlib.decompress(content, wbits=31)
                found = [
                    (
                        _page(fields["WARC-Record-ID"]),
                        int(fields["X-Payload-Length"]),
                        fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        fields["WARC-Type"],
                        _page(fields.get("WARC-Refers-To")),
                        fields["WARC-Target-URI"],
                        body if payload and fields["WARC-Type"] == "response" else None,
                    )
                    for fields, body in _parse(content)
                ]
                columns = list(zip(*found)) or [()] * len(_ROWS)
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS
                )

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return archives.select("path", "content").mapInArrow(parse, PAGES)


_ROWS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("target_uri", pa.string()),
        ("payload", pa.binary()),
    ]
)
