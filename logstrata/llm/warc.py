"""WARC archives with revisit records in place of repeated payloads.

Headers are grouped by payload digest (and a second, longer one, so that payloads made to share the first are told apart): of records
with equal payloads the one with the least id is the response, the others refer to it. Each record is a gzip member of its own, so an
archive can be read from any record's offset. Archives are written by Spark's text writer, to any file system that Spark writes to:
a member's last byte is 0 (its length's highest), and this byte is the writer's line separator; a record of 16 MB or more is followed
by an empty member that ends so. Files hold at most FILE_BYTES of payloads and URLs, or one record: pages are written by classes of
size, each with its own number of records a file.

Reading inflates member by member and works out length and digest from the payload found; one that differs from its header is an
error. Revisits get both by a join with the response that they refer to.

Cases: a null payload is empty, and empty payloads are equal; a null id sorts after all others; ids keep their type; of rows that share
the least id and the payload one is the response and the others refer to that id; a null url is written as no target and line ends in
a url are percent-encoded; an empty table gives an archive without records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import binary, configure, delete, materialise, scratch_path

END = "\r\n"
DATE = "2020-01-01T00:00:00Z"
#: Bytes of payloads and URLs in one file, which is read whole: they bound a worker's memory. Greater records have files of their own.
FILE_BYTES = 32 << 20
#: Greatest sizes of the classes that pages are written by.
CLASSES = (32 << 10, 256 << 10, 2 << 20, FILE_BYTES)
#: An empty gzip member.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03" + bytes(9)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: What reading gives for each record.
_RECORD = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("refers_record", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(data: Column) -> Column:
    """Base32 of the SHA-1: eight letters for each ten hexadecimal digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(number: Column) -> Column:
    """A record id from the row's number, the same in every run over the same rows."""
    d = F.md5(F.encode(F.concat(F.lit("record "), number.cast("string")), "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(d, i, n), F.lit("-" if i < 21 else ">"))])


def plan(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The records to be written: each page with its digest, type and, for a revisit, the response it refers to. ``size`` is the full one's."""
    body = F.coalesce(F.col(payload), F.lit(""))
    data = F.encode(body, "UTF-8")
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.col(url).alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"), base32_sha1(data).alias("payload_digest"), F.unhex(F.sha2(data, 256)).alias("second"),
        (F.octet_length(body) + F.coalesce(F.octet_length(url), F.lit(0))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    firsts = rows.groupBy("payload_digest", "second").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialise(firsts.filter("n > 1").select(F.col("payload_digest").alias("d"), F.col("second").alias("s"), "first"), "responses")
    # Two tables: adaptive execution splits the rows of a payload that very many pages share.
    joined = rows.join(firsts, (rows["payload_digest"] == firsts["d"]) & (rows["second"] == firsts["s"]), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", "size", "row",
        F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.id")).alias("refers_to"),
        F.when(revisit, F.col("first.row")).alias("refers_row"),
    )


def records(planned: DataFrame) -> DataFrame:
    """The bytes of each record, headers written anew."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(F.lit(""))

    revisit = F.col("record_type") == "revisit"
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    said = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "%", "%25"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    size = F.octet_length(http) + F.octet_length("payload")
    head = F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("row"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_row")))),
        line("X-Page-ID", said("page_id")),
        line("X-Refers-To-Page-ID", said("refers_to")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit(END),
    )
    return planned.select(F.encode(F.concat(head, http, F.col("payload"), F.lit(END + END)), "UTF-8").alias("record"))


def member(record: bytes) -> bytes:
    """A record compressed by itself, without the 0 that is its last byte."""
    own = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = own.compress(record) + own.flush()
    return data[:-1] if data[-1] == 0 else data + EMPTY[:-1]


def write(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Writes deduplicated archives and returns the folder."""
    configure(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(r.as_py()) for r in binary(batch.column(0))], pa.binary())], names=["member"])

    planned = plan(pages, id_column, url, payload)
    of = F.lit(len(CLASSES))
    for k in reversed(range(len(CLASSES))):
        of = F.when(F.col("size") <= CLASSES[k], k).otherwise(of)
    found = {r[0] for r in planned.select(of.alias("k")).distinct().collect()}  # at most one for each class
    for k in sorted(found or {0}):
        least, most = CLASSES[k - 1] if k else -1, CLASSES[k] if k < len(CLASSES) else None
        own = planned.filter(F.col("size") > least)
        own = own.filter(F.col("size") <= most) if most else own
        out = records(own).mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write
        out.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", max(1, FILE_BYTES // most) if most else 1).text(f"{path}/size-{k}")
    return path


_HEADERS = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        if archive[at : at + 10] != b"WARC/1.1\r\n":
            raise ValueError(f"no record at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        headers = {k.decode().lower(): v.decode() for k, v in _HEADERS.findall(archive, at + 10, end + 2)}
        size = int(headers["content-length"])
        yield headers, archive[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def inflated(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds (or, of a plain archive, all of it)."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        own, parts = zlib.decompressobj(31), []
        while not own.eof:
            piece = data[at : at + (1 << 16)]
            if not piece:
                raise ValueError("an archive ends within a record")
            parts.append(own.decompress(piece))
            at += len(piece) - len(own.unused_data)
        yield b"".join(parts)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read(spark: SparkSession, path: str, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """The records of all archives in a folder, responses checked against their digests. A revisit's payload and its length are null:
    ``resolve`` finds the length."""
    configure(spark)
    schema = _RECORD if payloads else T.StructType([f for f in _RECORD if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for part in inflated(content.as_py()):
                    for headers, block in parse(part):
                        body = block[block.index(b"\r\n\r\n") + 4 :] if headers["warc-type"] == "response" else None
                        said = headers["warc-payload-digest"].removeprefix("sha1:")
                        if body is not None and digest_of(body) != said:
                            raise ValueError(f"the payload of {headers['warc-record-id']} is not that of its digest")
                        ids = [None if (v := headers.get(k)) is None else unquote(v) for k in ("x-page-id", "x-refers-to-page-id")]
                        row = (ids[0], headers.get("warc-target-uri"), headers["warc-type"], headers["warc-record-id"], said, ids[1], headers.get("warc-refers-to"), None if body is None else len(body))
                        rows.append((*row, body) if payloads else row)
                kinds = (*(pa.string(),) * 7, pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: len(schema)])], names=schema.names)

    # A file's bytes are bounded by what was written into it.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolve(archived: DataFrame) -> DataFrame:
    """Records with payload_bytes of the full payload, revisits by a join with the response they refer to, whose digest must be theirs."""
    rows = materialise(archived.select("page_id", "url", "record_type", "record_id", "payload_digest", "refers_to", "refers_record", "payload_bytes"), "headers")
    responses = rows.filter("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("payload_digest").alias("found"), F.col("payload_bytes").alias("full"))
    revisits = rows.filter("record_type = 'revisit'")
    asked = materialise(responses.join(revisits.select(F.col("refers_record").alias("of")).distinct(), "of", "left_semi"), "lengths")
    both = revisits.join(asked, revisits["refers_record"] == asked["of"], "left")
    wrong = F.raise_error(F.concat(F.lit("the digest of "), F.col("record_id"), F.lit(" is not that of the record it refers to"))).cast("string")
    both = both.withColumn("payload_digest", F.when(F.col("found") != F.col("payload_digest"), wrong).otherwise(F.col("payload_digest")))
    return rows.filter("record_type <> 'revisit'").unionByName(both.withColumn("payload_bytes", F.col("full")).select(rows.columns)).drop("refers_record")


def archive_round_trip(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Writes the pages' archives into the shared folder, reads them back, resolves the revisits and deletes the archives."""
    spark = pages.sparkSession
    path = write(pages, scratch_path(spark, "warc"), id_column)
    found = resolve(read(spark, path, payloads=False, id_type=pages.schema[id_column].dataType.simpleString()))
    delete(spark, path)  # the headers, all that the result is made of, have been written by now
    return found
