"""Write and read web archives (WARC 1.1), one gzip member per record.

Archives are written by Spark's text writer, one archive per row and file, so they land in
any store that Spark reaches, with its commit protocol; each ends with a metadata record.
The reader takes archives whole from Spark (one file per row), decompresses them in small
steps, frames records by Content-Length and verifies the digests.

Rows: a null html is an empty payload, a null url an empty target; a null page_id is kept
as null and never chosen as the original unless no other has that payload; repeated rows
give repeated records, and those of the original are responses all; very long payloads are
one record, decompressed in small steps; an empty table gives no records; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.llm.common import importable, own_columns, texts
from bookpulse.session import stage

DATE = "1970-01-01T00:00:00Z"   # pages carry no time of capture
ARCHIVE_BYTES = 32 << 20
LEAST_REVISIT = 100
_STEP = 1 << 16
RECORDS = (
    "record_type string, record_id string, refers_to_id string, target_uri string, payload_digest string, "
    "payload_bytes bigint, payload binary, verified boolean"
)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    block_digest = ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")
    lines = [*headers, block_digest, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: bytes, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """``response`` with the payload, or ``revisit`` of record ``first`` with its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    uri = url.replace(b"\r", b"%0D").replace(b"\n", b"%0A").decode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if revisit:
        headers += [
            ("WARC-Refers-To", _id(first)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    return record(headers, http.encode() + (b"" if revisit else payload))


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def end_record() -> bytes:
    """The metadata record that closes an archive."""
    return record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
         ("Content-Type", "application/warc-fields")],
        b"archive: end\r\n",
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
                   least_revisit: int = LEAST_REVISIT) -> None:
    """Write a record per page; of equal payloads the smallest page_id is kept, others revisit it.

    Only digests that occur more than once are joined back, and only their narrow rows are
    shuffled before; Spark broadcasts them if the written table is small, else it splits
    the hot digests of a sort-merge join.
    """
    spark = importable(pages.sparkSession)
    rows = own_columns(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    originals = stage(
        rows.where(F.octet_length("html") >= least_revisit).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .where("n > 1").select("digest", "first"),
        "originals",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            ids, firsts = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for page_id, url, html, first in zip(ids, texts(batch.column(1)), texts(batch.column(2)), firsts):
                revisit = first is not None and first != page_id
                members.append(page_record(page_id, url, html, hashlib.sha256(html).hexdigest(), first, revisit))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield _archive(members)
                    members, size = [], 0
        if members:
            yield _archive(members)

    archives = (
        rows.join(originals, "digest", "left").select("page_id", "url", "html", "first")
        .mapInArrow(write, "archive binary")
    )
    (
        archives.select(F.col("archive").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
        .option("lineSep", end_record().decode("latin-1")).text(folder)
    )


def _archive(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])


class Stream:
    """Bytes of the gzip members of an archive, decompressed step by step; no record is held twice."""

    def __init__(self, data: bytes):
        self.data, self.at, self.gz, self.buffer = memoryview(data), 0, None, b""

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if self.at >= len(self.data):
            return False
        self.gz, self.buffer = zlib.decompressobj(31), b""
        return True

    def _more(self, want: int) -> bytes:
        if self.gz.eof:
            raise ValueError("a record is longer than its gzip member")
        if self.gz.unconsumed_tail:
            got = self.gz.decompress(self.gz.unconsumed_tail, want)
        else:
            step = self.data[self.at:self.at + _STEP]
            if not len(step):
                raise ValueError("the archive ends within a record")
            self.at += len(step)
            got = self.gz.decompress(step, want)
        if self.gz.eof:  # what is left belongs to the next member
            self.at -= len(self.gz.unused_data)
        return got

    def until(self, mark: bytes) -> bytes:
        seen = self.buffer
        while mark not in seen:
            seen += self._more(_STEP)
        found, _, self.buffer = seen.partition(mark)
        return found

    def take(self, n: int) -> bytes:
        parts, got = [self.buffer[:n]], min(n, len(self.buffer))
        self.buffer = self.buffer[n:]
        while got < n:
            parts.append(self._more(min(n - got, 1 << 20)))
            got += len(parts[-1])
        return b"".join(parts)

    def end_member(self) -> None:
        if self.take(4) != b"\r\n\r\n" or self.buffer:
            raise ValueError("a record does not end where Content-Length says")
        while not self.gz.eof:
            if self._more(1):
                raise ValueError("a gzip member holds more than one record")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record, in order."""
    stream = Stream(data)
    while stream.next_member():
        first, *lines = stream.until(b"\r\n\r\n").decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record begins with {first[:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(headers["content-length"]))
        stream.end_member()
        yield headers, block


def _matches(label: str | None, data: bytes) -> bool:
    """Does a digest like ``sha256:...`` (hex) or ``sha1:...`` (base 32) hold? No digest: yes."""
    if not label:
        return True
    kind, _, value = label.partition(":")
    try:
        found = hashlib.new(kind.replace("-", ""), data)
    except ValueError:
        return False
    return value.lower() == found.hexdigest() or value.upper() == base64.b32encode(found.digest()).decode()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response and revisit record of all archives in ``folder``.

    ``verified``: the block, and for responses the payload, match their digests. A broken
    frame or member raises, as nothing after it can be trusted. ``payload_bytes`` of a
    revisit is the length of the payload it stands for; its ``payload`` is null.
    """
    importable(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for headers, block in read_records(batch.column(0)[i].as_buffer()):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    label = headers.get("warc-payload-digest", "")
                    sound = _matches(headers.get("warc-block-digest"), block)
                    if kind == "response":
                        sound, length = sound and _matches(label, payload), len(payload)
                    else:
                        payload, length = None, next(
                            (int(x[15:]) for x in head.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")),
                            None,
                        )
                    out.append((
                        kind, headers.get("warc-record-id"), headers.get("warc-refers-to"),
                        headers.get("warc-target-uri"), label.partition(":")[2], length, payload, sound,
                    ))
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(read, RECORDS)


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified of read page records."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to_id").alias("refers_to"), "verified",
    )
