"""WARC archives: a writer of gzip members and a reader that splits inside files.

Each record is a gzip member.  Reading tasks take byte ranges: a task scans its
range for the gzip magic, decodes what follows each candidate to see whether a
WARC header is there, and owns the records that start inside its range, to
whatever byte they reach.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.session import prepare, shared_path, table

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
#: Bytes of an archive file after which a task begins another, and of a reading task's range.
FILE_BYTES, SPLIT_BYTES = 256 << 20, 8 << 20
#: Reading tasks; more ranges than that are shared out evenly among them.
MOST_TASKS = 1_000_000
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
#: A header section of more bytes is no WARC record.
_HEADER = 1 << 20
PAGE = "urn:x-page:"


def member(headers: list[tuple[str, str]], block: bytes, level: int = 5) -> bytes:
    """One record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, original: int | None, revisit: bool) -> bytes:
    """A response, or a revisit: the response's HTTP header without its payload."""
    kind = "revisit" if revisit else "response"
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{PAGE}{original}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return member(headers, http if revisit else http + payload)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """file:/x, as Hadoop writes it, is file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, size, digest and original: the largest page_id of equal payloads of at least
    LEAST_REVISIT bytes, null where no other page has the payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("size"), F.sha1("payload").alias("digest"))
    long = rows.where(F.col("size") >= LEAST_REVISIT)
    repeated = long.groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(repeated, ["digest", "size"], "left").select("page_id", "url", "payload", "size", "digest", "original")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as archives below ``folder``; (path, bytes, records) of the files that count.

    A file gets its name when it is complete, and only files that a finished
    task reports count: an attempt that was lost leaves files nobody reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(_uri(folder))
        where.create_dir(base, recursive=True)
        out, path, done, size, n = None, "", [], 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path, size, n = posixpath.join(base, f"{uuid.uuid4().hex}.warc.gz"), 0, 0
                    out = where.open_output_stream(path + ".open", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                revisit = r["original"] is not None and r["page_id"] != r["original"]
                record = page_record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], r["original"], revisit)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    where.move(path + ".open", path)
                    done.append((posixpath.basename(path), size, n))
                    out = None
        if out is not None:
            out.close()
            where.move(path + ".open", path)
            done.append((posixpath.basename(path), size, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "bytes", "records"])

    return with_originals(pages).mapInArrow(run, "name string, bytes long, records long").checkpoint().withColumn("path", F.concat(F.lit(_uri(folder).rstrip("/") + "/"), "name"))


class _Source:
    """Bytes of a file from a place on, read ahead in blocks."""

    def __init__(self, file: Any, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, b""

    def fill(self, n: int) -> bool:
        """Have at least ``n`` bytes at hand, if the file has them."""
        while len(self.data) < n:
            self.file.seek(self.at + len(self.data))
            more = self.file.read(min(max(_READ, n - len(self.data)), self.size - self.at - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def _is_record(data: bytes) -> bool:
    """Whether a WARC header begins in a gzip member at the front of ``data``."""
    z = zlib.decompressobj(31)
    try:
        return z.decompress(data, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflate(source: _Source) -> Iterator[bytes]:
    """The member at the source's place, in parts; then the source is behind it."""
    z = zlib.decompressobj(31)
    while not z.eof:
        if not source.data and not source.fill(1):
            raise EOFError("the archive ends inside a record")
        given = source.data
        part = z.decompress(given)
        source.skip(len(given) - len(z.unused_data))
        yield part


def records(path: str, size: int, start: int, stop: int) -> Iterator[dict[str, Any]]:
    """The records of a file that begin at ``start`` <= offset < ``stop``: offset, headers, block.

    A member that does not decode to its end ends with an error, not with half a
    record; bytes that merely look like a member's first are passed over.
    """
    where, name = _filesystem(path)
    with where.open_input_file(name) as file:
        source = _Source(file, start, size)
        while source.at < stop:
            source.fill(len(MAGIC))
            at = source.data.find(MAGIC)
            if at < 0:
                if not source.data or source.at + len(source.data) >= size:
                    return
                source.skip(max(1, len(source.data) - len(MAGIC) + 1))
                continue
            if source.at + at >= stop:
                return
            source.skip(at)
            source.fill(512)
            if not _is_record(source.data[:4096]):
                source.skip(1)
                continue
            offset = source.at
            whole = b"".join(_inflate(source))
            head, _, block = whole.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            yield {"offset": offset, "headers": headers, "block": block[: int(headers.get("content-length", len(block)))]}


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(PAGE)
    return int(text) if text else None


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read(files: DataFrame, split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Page records of archives: ``files`` has path and bytes; each range of ``split`` bytes is a task.

    Size and digest are those of the payload read; a revisit's are those its
    headers give for the payload it stands for.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), F.lit(split).cast("long"))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start"))
    # a number of its own: partitions without one would be merged, as rows that name ranges are small
    total = files.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split))).first()[0] or 1
    ranges = ranges.repartition(min(int(total), MOST_TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in PAGES.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        rows: list[tuple] = []
        held = 0
        for b in batches:
            for r in b.to_pylist():
                for found in records(r["path"], r["bytes"], r["start"], r["start"] + split):
                    h = found["headers"]
                    if h.get("warc-type") not in ("response", "revisit"):
                        continue
                    http, _, payload = found["block"].partition(b"\r\n\r\n")
                    if h["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n"))}
                        size, digest = int(fields["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((_page(h.get("warc-record-id")), size, digest, h["warc-type"], _page(h.get("warc-refers-to")), h.get("warc-target-uri"), payload if payloads and h["warc-type"] == "response" else None))
                    held += len(payload)
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        yield batch_of(rows)

    return ranges.mapInArrow(run, PAGES)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back, a row for each page.

    A null html is an empty payload, a null url leaves the target out, a null
    page_id is read back as null.  Of rows with the same page_id and payload
    all are responses if that page_id is the largest.  No rows give no rows, and
    columns other than page_id, url and html are not looked at.
    """
    prepare(pages.sparkSession)
    files = write(pages, shared_path(pages.sparkSession, "warc"))
    return read(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
