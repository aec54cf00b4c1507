"""WARC archives of pages: written with revisit records for equal payloads, indexed, and read by byte ranges.

Writing: one record for each row, an HTTP response with the html in UTF-8 as payload (null: empty).
Of rows with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is the
response and the others are revisits that refer to it, without payload; smaller ones are all responses.
A record is a gzip member of its own, and Spark's text writer lays members end to end: the last byte of
a gzip member is the top byte of its length, zero below 16 MB, and is left to the writer as its line
separator (a longer record gets an empty member behind it).  So files are committed by Spark, once,
whichever executor is lost.

Reading begins with the index: offset, length, URL and digest of every record, from one pass over the
archives, which takes one member at a time.  Selected records are then sorted by archive and offset,
neighbouring byte ranges are read at once, and each payload is held against its digest.

Equal page_ids rank by their order in the input, a null page_id behind all others (and comes back as
null); repeated rows are records of their own, one of them the response; html of null comes back as an
empty text; controls and blanks in a URL are percent-encoded; an empty table gives archives without a
record.  Columns beyond page_id, url and html are not stored.  The input is read twice and must be the
same both times (a table, not a random sample): otherwise reading fails, as a revisit refers to nothing.

The archives are opened by tasks through Arrow's file systems (local or mounted folders, HDFS, S3, GCS,
Azure); `path` defaults to the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fresh_path, materialize, open_shared

GZIP = 31  # zlib's number for a gzip member
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string, url string, page_id string, payload_digest string, refers_to string"
READ = "record_id string, record_type string, url string, page_id string, refers_to string, payload_bytes long, payload_digest string"
CHUNK = 1 << 20


class Header(NamedTuple):
    """What a record says of itself; refers_to is the record_id of the response a revisit stands for."""

    record_id: str
    record_type: str
    url: str | None
    page_id: str | None
    digest: str
    refers_to: str | None = None
    refers_to_url: str | None = None


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member (with an empty one behind it if need be) without its last byte, which is zero."""
    squeezed = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    out = squeezed.compress(data) + squeezed.flush()
    if out[-1]:
        out += zlib.compressobj(wbits=GZIP).flush()
    return out[:-1]


def field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(head: Header, payload: bytes, size: int, date: str) -> bytes:
    """One record of WARC 1.1; a revisit keeps the HTTP header of its payload of size bytes."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    lines = ["WARC/1.1", f"WARC-Type: {head.record_type}", f"WARC-Record-ID: <{head.record_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {field(head.url)}"] if head.url is not None else []
    lines += [f"X-Page-ID: {field(head.page_id)}"] if head.page_id is not None else []
    if head.refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{head.refers_to}>"]
        lines += [f"WARC-Refers-To-Target-URI: {field(head.refers_to_url)}"] if head.refers_to_url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{head.digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[Header, bytes]:
    """The header and the payload of a record; an error if it is cut short or not a record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is shorter than it says")
    _, _, payload = rest[:size].partition(b"\r\n\r\n")
    inside = lambda name: fields[name].strip("<>") if name in fields else None
    return Header(inside("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), fields.get("x-page-id"), fields["warc-payload-digest"].partition(":")[2], inside("warc-refers-to")), payload


def members(chunks: Iterable[bytes], offset: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each record in bytes that begin at offset; an empty member belongs to the one before."""
    pending, at, unzip, content = None, offset, zlib.decompressobj(GZIP), []
    taken = 0
    for chunk in chunks:
        while chunk:
            content.append(unzip.decompress(chunk))
            rest = unzip.unused_data
            taken += len(chunk) - len(rest)
            chunk = rest
            if unzip.eof:
                whole = b"".join(content)
                if whole:
                    if pending:
                        yield pending
                    pending = (at, taken, whole)
                elif pending:
                    pending = (pending[0], pending[1] + taken, pending[2])
                at, taken, unzip, content = at + taken, 0, zlib.decompressobj(GZIP), []
    if taken:
        raise ValueError("a gzip member is cut short")
    if pending:
        yield pending


def coalesced(places: Iterable[tuple], gap: int, most: int) -> Iterator[list[tuple]]:
    """Runs of places (archive, offset, length, ...) in order of which one read takes all: at most gap bytes between, and most in all unless one place is longer."""
    run: list[tuple] = []
    for place in places:
        if run and (place[0] != run[0][0] or place[1] - run[-1][1] - run[-1][2] > gap or place[1] + place[2] - run[0][1] > most):
            yield run
            run = []
        run.append(place)
    if run:
        yield run


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 100, date: str | None = None, level: int = 2, records_per_file: int = 50_000) -> str:
    """Writes a record for each row of pages (page_id, url, html) into new archives below path; returns path."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    batch_id = uuid.uuid4()
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row_id"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row_id", "url")).alias("first")
    equal = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = materialize(equal.select("digest", F.col("first.row_id").alias("first_row"), F.col("first.url").alias("first_url")), "leaders")
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row_id"))
    told = rows.join(leaders, "digest", "left").select(
        "row_id", "url", F.col("page_id").cast("string").alias("page_id"), "digest", "size",
        F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("first_row")).alias("first_row"), "first_url",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda row_id: f"urn:uuid:{uuid.uuid5(batch_id, str(row_id))}"
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(begin, 256).to_pylist():
                    back = r["first_row"]
                    head = Header(name(r["row_id"]), "response" if back is None else "revisit", r["url"], r["page_id"], r["digest"], None if back is None else name(back), None if back is None else r["first_url"])
                    out.append(gzip_member(record(head, r["payload"] or b"", r["size"], date), level))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    told.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives below path: archive, offset, length, record_id, record_type, url, page_id, payload_digest, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")  # names only: the content is not read here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with open_shared(archive) as file:
                    rows = []
                    for offset, length, data in members(iter(lambda file=file: file.read(CHUNK), b"")):
                        h, _ = parsed(data)
                        rows.append((archive, offset, length, h.record_id, h.record_type, h.url, h.page_id, h.digest, h.refers_to))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return materialize(files.mapInArrow(run, INDEX), "warc-index")


def read_records(selected: DataFrame, with_payload: bool = True, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of rows of an index: record_id, record_type, url, page_id, refers_to, payload_bytes, payload_digest (both of the payload in the record) and, if asked, payload.

    The digest of a response is computed from the bytes read, and an error if the record says otherwise.
    The records are dealt by their bytes in the archives, some task_bytes to each task.
    """
    schema = READ + (", payload binary" if with_payload else "")
    tasks = 1 + (selected.agg(F.sum("length")).first()[0] or 0) // task_bytes
    ordered = selected.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
        places = (place for batch in batches for place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        archive, file = None, None
        for ranges in coalesced(places, gap, most):
            if ranges[0][0] != archive:
                if file:
                    file.close()
                archive = ranges[0][0]
                file = open_shared(archive)
            begin = ranges[0][1]
            data = file.read_at(ranges[-1][1] + ranges[-1][2] - begin, begin)
            rows, held = [], 0
            for _, offset, length in ranges:
                ((_, _, content),) = members([data[offset - begin : offset - begin + length]])
                h, payload = parsed(content)
                digest = hashlib.sha256(payload).hexdigest()
                if h.record_type == "response" and digest != h.digest:
                    raise ValueError(f"{archive} at {offset}: the payload is not that of the record's digest")
                rows.append((h.record_id, h.record_type, h.url, h.page_id, h.refers_to, len(payload), digest, payload)[: len(names)])
                held += len(payload) if with_payload else 0
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if file:
            file.close()

    return ordered.mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Every record with the payload columns of the response it stands for, and refers_to, the page_id of that response for revisits.

    A revisit whose response is not among the records is an error.
    """
    full = [c for c in records.columns if c.startswith("payload")]
    own = records.select("record_id", "record_type", "url", "page_id", F.coalesce("refers_to", "record_id").alias("holder"))
    responses = records.where(F.col("record_type") == "response").select(F.col("record_id").alias("holder"), F.col("page_id").alias("holder_page"), *full)
    found = own.join(responses, "holder", "left")
    revisit = F.col("record_type") == "revisit"
    held = F.when(F.col("payload_digest").isNull(), F.raise_error(F.concat(F.lit("no response for "), F.col("record_id"))).cast("string")).otherwise(F.col("payload_digest"))
    return found.select("record_id", "record_type", "url", "page_id", F.when(revisit, F.col("holder_page")).alias("refers_to"), *(held.alias(c) if c == "payload_digest" else F.col(c) for c in full))


def restored_pages(index: DataFrame) -> DataFrame:
    """page_id (as text), url and html of every record of an index, revisits with the html of their response."""
    return resolved(read_records(index)).select("page_id", "url", F.col("payload").cast("string").alias("html"))
