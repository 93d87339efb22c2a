"""Web archives (WARC): writing with revisit records, and reading by byte ranges.

Every record is one gzip member. Files are written by Spark's text writer, whose commits survive
lost tasks: a row is the bytes of a member, and the line separator is an empty member, so that a
file is nothing but members and any gzip or WARC tool reads it.

Reading splits files into byte ranges without an index. A task looks for the gzip magic in
its range, and takes a candidate only if it inflates to a WARC header; then it owns the record, also
if that ends in a later range, and goes on behind it. A magic inside compressed data does not
inflate to a header. Byte ranges are read through pyarrow's file systems, found by the path's scheme.
(A gzip member stored uncompressed inside a record's payload could still be taken for a record
if a range begins between the two; the writer here always deflates.)
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, read_table
from driftline.session import materialise, scratch_path

REVISIT_BYTES = 100
SPLIT = 4 << 20
READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
RECORD = "<urn:page:%s>"
DATE = "1970-01-01T00:00:00Z"


def record_bytes(page, url: str | None, size: int, digest: str, refers_to, payload: bytes) -> bytes:
    """One record as a gzip member; a revisit (refers_to given) keeps only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD % ('' if page is None else page)}",
        f"WARC-Date: {DATE}",
        f"Content-Type: {HTTP_TYPE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]+", "%20", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {RECORD % refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()


def planned(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, size, digest and refers_to (null for responses).

    Null html is an empty payload. Of equal payloads of `least` bytes or more the smallest page_id
    is the response; rows that share that id are all responses. A row without an id may refer to
    one with an id; payloads that only rows without an id have are responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("digest")
    )
    # Copies are added up before the shuffle, and only digests that occur twice are joined.
    first = (
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select(F.col("digest").alias("d"), "first")
    )
    # Written first, so that its real size decides how it is joined.
    first = materialise(first, "payloads")
    joined = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "size", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write one record per row of pages (page_id, url, html) below path; other columns are ignored."""

    def make():
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for page, url, html, size, digest, refers_to in rows:
                yield (record_bytes(page, url, size, digest, refers_to, html.encode()),)

        return step

    columns = ("page_id", "url", "html", "size", "digest", "refers_to")
    members = map_rows(planned(pages, least), columns, "member binary", make, lambda r: len(r[0]))
    members.select(F.col("member").cast("string").alias("value")).write.option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).option("encoding", "ISO-8859-1").text(path)


class Bytes:
    """The bytes of a file from a position on, read in pieces; what lies behind is dropped."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.size, self.base, self.data = file, size, start, bytearray()

    def more(self) -> bool:
        """Whether one more piece could be read."""
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        self.data += self.file.read(min(READ, self.size - at))
        return True

    def get(self, at: int, length: int) -> bytes:
        while self.base + len(self.data) < at + length and self.more():
            pass
        return bytes(self.data[at - self.base : at - self.base + length])

    def find(self, wanted: bytes, at: int, end: int) -> int:
        """Position of `wanted` that begins in [at, end), or -1."""
        while True:
            found = self.data.find(wanted, at - self.base)
            if found >= 0:
                return found + self.base if found + self.base < end else -1
            at = max(at, self.base + len(self.data) - len(wanted) + 1)
            if at >= end or not self.more():
                return -1

    def drop(self, at: int) -> None:
        del self.data[: at - self.base]
        self.base = at


def inflate(source: Bytes, at: int) -> tuple[bytes, int, str | None] | None:
    """(content, end, error) of the record member at `at`; None if it is not one.

    An empty member has empty content. The error is set if a member with a WARC header is damaged."""
    stream, content, place = zlib.decompressobj(31), bytearray(), at
    while not stream.eof:
        piece = source.get(place, 1 << 16)
        try:
            if not piece:
                raise zlib.error("the file ends inside the member")
            content += stream.decompress(piece)
        except zlib.error as error:
            return (bytes(content), place, str(error)) if content.startswith(b"WARC/") else None
        place += len(piece)
        if len(content) >= 5 and not content.startswith(b"WARC/"):
            return None
    if content and not content.startswith(b"WARC/"):
        return None
    return bytes(content), place - len(stream.unused_data), None


def header_fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parse_record(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = header_fields(head)
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, payload, length = {}, block, None
    if fields.get("content-type", "").startswith("application/http"):
        http_head, _, payload = block.partition(b"\r\n\r\n")
        http = header_fields(http_head)
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    return {"fields": fields, "payload": payload, "length": length}


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict | None, str | None]]:
    """(offset, record, error) of the records that begin in [start, end)."""
    source, at = Bytes(file, start, size), start
    while (at := source.find(MAGIC, at, end)) >= 0:
        source.drop(at)
        found = inflate(source, at)
        if found is None:
            at += 1
            continue
        content, behind, error = found
        if error:
            yield at, None, error
            at += 1
            continue
        if content:
            yield at, parse_record(content), None
        at = behind


def _local_uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def page_number(field: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """One row per record of the archives below path.

    Columns: file, offset, record_type, page_id and refers_to (numbers of this module's record
    ids, else null), uri, payload (without the HTTP header; null for revisits), payload_bytes,
    stated_digest (without its `sha256:`) and error (null, or why a record could not be read
    whole; then only file and offset are set). An archive without records gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start")
    )
    tasks = max(1, min(ranges.count(), 100_000))

    def make():
        from pyarrow import fs

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for name, length, start in rows:
                system, inner = fs.FileSystem.from_uri(_local_uri(name))
                with system.open_input_file(inner) as file:
                    for offset, record, error in records_in(file, length, start, min(start + split, length)):
                        if error:
                            yield name, offset, None, None, None, None, None, None, None, error
                            continue
                        fields, revisit = record["fields"], record["fields"].get("warc-type") == "revisit"
                        size = record["length"] if record["length"] is not None else len(record["payload"])
                        yield (
                            name, offset, fields.get("warc-type"), page_number(fields.get("warc-record-id")),
                            page_number(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
                            None if revisit else record["payload"], size if revisit else len(record["payload"]),
                            fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, None,
                        )

        return step

    schema = (
        "file string, offset bigint, record_type string, page_id bigint, refers_to bigint, uri string, "
        "payload binary, payload_bytes bigint, stated_digest string, error string"
    )
    return map_rows(ranges.repartition(tasks), ["path", "length", "start"], schema, make, lambda r: 200 + len(r[6] or b""))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    # A response's digest is taken of the payload that was read; a revisit has only the stated one.
    digest = F.coalesce(F.sha2("payload", 256), F.col("stated_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op1_warc": op1_warc}
ORACLES = {"op1_warc": OP1_SQL}
