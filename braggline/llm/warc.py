"""WARC archives: three records per capture, and their assembly back into one nested row.

A capture is written as a request, a response (or a revisit, if its payload is that of
an earlier page) and a metadata record; the request and the metadata name the response
as the record they are concurrent to.  Spark's own text sink writes the records, with
the two line ends that close a record as its line separator, so archives can lie on any
file system that Spark reaches.  Archives are read as whole files of bounded size and
parsed by content length; the records of a capture meet by the identifier they share,
in whichever files they lie.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, fresh, numbered, written

END = "\r\n"
#: Fixed value: the profile of a revisit whose payload has the same digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(binary: Column) -> Column:
    """Upper-case base-32 SHA-1: eight times 20 bits, each as four digits of base 32."""
    digest = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(kind: str, *parts: Column) -> Column:
    """A name that follows from what the record is of, so that other rows can refer to it."""
    h = F.md5(F.concat_ws(":", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends; headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v)) for name, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(END, *lines), F.lit(2 * END), block)


def quoted(url: str) -> Column:
    """A URL as a part of a name: with a mark before it, so that neither a missing one nor its colons can be mistaken."""
    return F.concat(F.octet_length(url).cast("string"), F.lit("="), F.col(url))


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, first_id, first_url, revisit``: which page answers for each payload.

    Only payloads that several pages share are joined back, from a table written before,
    whose size Spark then knows.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    own = own.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    shared = (own.where(F.octet_length("html") >= min_bytes).groupBy("digest")
              .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")).alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    joined = own.join(written(shared, "shared-payloads"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "digest", "first_id", "first_url", (revisit & (F.octet_length("html") >= min_bytes)).alias("revisit"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 4000) -> None:
    """Write gzip archives below ``path``, about ``records_per_file`` captures to a file.

    A null ``html`` is an empty payload and a null ``url`` has no target header; white
    space and control characters in a URL are percent-encoded.  Of pages with equal
    payloads of at least ``min_bytes`` bytes the smallest id is the response and the
    others revisit it, a null id last.  A capture is a page id, a URL and a payload; a row
    repeated in full writes its records again, and ``assemble`` counts them.
    """
    rows = captures(pages, min_bytes)
    url = F.col("url")
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), url).otherwise(F.col("url"))
    uri = F.col("uri")
    capture = (F.col("page_id"), quoted("url"), F.col("digest"))
    own = record_id("response", *capture)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("html").cast("string"), F.lit(2 * END))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    answer = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = record("response", answer, F.concat(head, F.col("html")))
    revisit = record("revisit", [*answer, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id("response", F.col("first_id"), quoted("first_url"), F.col("digest")))], head)
    request = record("request", [("WARC-Record-ID", record_id("request", *capture)), ("WARC-Concurrent-To", own), *common,
                                 ("Content-Type", F.lit("application/http;msgtype=request"))],
                     F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{2 * END}")))
    fields = F.concat_ws(END, F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(""))
    metadata = record("metadata", [("WARC-Record-ID", record_id("metadata", *capture)), ("WARC-Concurrent-To", own), *common,
                                   ("Content-Type", F.lit("application/warc-fields"))], fields)
    text = F.concat_ws(2 * END, request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)
    (rows.withColumn("uri", url).select(text.alias("value")).write.option("lineSep", 2 * END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


RECORD = ("record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id bigint, "
          "payload_bytes bigint, payload_digest string, declared_digest string, payload binary")


class _Stream(io.RawIOBase):
    """The bytes of a gzip archive (of one member or many) or a plain one, unpacked piece by piece."""

    def __init__(self, raw: bytes):
        self.raw, self.zip = raw, raw[:2] == b"\x1f\x8b"
        self.at, self.left, self.unpack = 0, b"", zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, into):
        while not self.left and (self.at < len(self.raw) or self.unpack.unconsumed_tail):
            if not self.zip:
                self.left, self.at = self.raw[self.at:self.at + 65536], self.at + 65536
                continue
            piece = self.unpack.unconsumed_tail or self.raw[self.at:(end := min(self.at + 65536, len(self.raw)))]
            if not self.unpack.unconsumed_tail:
                self.at = end
            self.left = self.unpack.decompress(piece, 1 << 20)
            if self.unpack.eof:
                self.at -= len(self.unpack.unused_data)
                self.unpack = zlib.decompressobj(31)
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    stream = io.BufferedReader(_Stream(raw), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("an archive record does not begin with its version")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        yield headers, block


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; payload sizes and digests are of the bytes read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from base64 import b32encode

        names = ["record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "page_id", "payload_bytes", "payload_digest", "declared_digest", "payload"]
        types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for h, block in records(batch.column("content")[i].as_py()):
                    kind = h["warc-type"]
                    page = payload = None
                    if kind == "metadata":
                        found = [line[8:].strip() for line in block.decode("utf-8").split(END) if line.startswith("page-id:")]
                        page = int(found[0]) if found and found[0] else None
                    elif kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page,
                                 None if payload is None else len(payload), None if payload is None else b32encode(hashlib.sha1(payload).digest()).decode(),
                                 h.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload if with_payload else None))
                    held += len(block)
                    if len(rows) >= 10_000 or with_payload and held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``transaction, response, request, metadata, copies``.

    Records meet in one exchange by the response they are, or are concurrent to.  Records
    that repeat an identifier are one, and ``copies`` says how many responses (or revisits)
    did, which is how many rows the page had; a request or metadata record without its response
    still gives a row, with a null response.
    """
    answer = F.col("record_type").isin("response", "revisit")
    part = lambda when, *columns: F.max(F.when(when, F.struct(*columns)))
    return found.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction")).agg(
        part(answer, "record_type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "declared_digest", "payload").alias("response"),
        part(F.col("record_type") == "request", "record_id", "target_uri").alias("request"),
        part(F.col("record_type") == "metadata", "record_id", "page_id").alias("metadata"),
        F.greatest(F.count(F.when(answer, 1)), F.lit(1)).alias("copies"))


def every_row(captured: DataFrame) -> DataFrame:
    """Every capture as often as its page had rows, without ``copies``."""
    columns = [c for c in captured.columns if c != "copies"]
    return numbered(captured, "copies", fresh(captured, "__copy")).select(*columns)


def with_originals(assembled: DataFrame) -> DataFrame:
    """Add ``original``: of a revisit, the page, size and digest of the response it refers to."""
    first = assembled.where(F.col("response.record_type") == "response").select(
        F.col("transaction").alias("__first"), F.struct(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
                                                        F.col("response.payload_digest").alias("payload_digest")).alias("original"))
    return assembled.join(first, F.col("response.refers_to") == F.col("__first"), "left").drop("__first")


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages to archives, read them back and assemble their captures; ``every_row`` makes them rows of pages again."""
    path = path or f"{checkpoint_folder(spark)}/braggline-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return with_originals(written(assemble(read_records(spark, path)), "captures"))
