"""WARC: written archives, an index of their records, and coalesced reads of byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

LEVEL = 3
FILE_BYTES = 512 << 20
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
CHUNK = 1 << 20
_END = b"\r\n\r\n"
INDEX = "file string, offset bigint, length bigint, type string, url string, digest string, page_id bigint, status int, media string"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    """The payload digest as it stands in a record."""
    return "sha256:" + hashlib.sha256(payload).hexdigest()


def record(page_id: int | None, url: str, payload: bytes, date: str) -> bytes:
    """One response record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = digest_of(payload)
    target = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {target}\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>\r\nWARC-Payload-Digest: {digest}\r\n"
    if page_id is not None:
        head += f"WARC-Page-ID: {page_id}\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + _END


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``(page_id, url, html)`` as gzipped WARC files, a member per record, and returns ``(file, records, bytes)``.

    Rows with a null url or html have no record. A task names its files after its attempt, so a task that is repeated
    or runs twice never touches another's files; the files of the attempts that counted are those returned.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId():08d}"
        fs, path = _open(folder)
        done, out, name, records, size = [], None, None, 0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
            for page, url, html in zip(*columns):
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out, records, size = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                    info = b"software: rillgrid\r\n"
                    size += out.write(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + _END, level))
                size += out.write(_member(record(page, url, html.encode("utf-8", "surrogatepass"), date), level))
                records += 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.where("url is not null and html is not null").mapInArrow(write, "file string, records bigint, bytes bigint")


def _members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, or of each record of a file that isn't compressed."""
    buffer, at = b"", 0
    buffer = stream.read(CHUNK)
    if buffer[:2] != b"\x1f\x8b":
        while True:
            while b"\r\n\r\n" not in buffer and (more := stream.read(CHUNK)):
                buffer += more
            head = buffer.find(_END)
            if head < 0:
                if buffer.strip():
                    raise ValueError(f"a record at {at} has no end of its head")
                return
            size = head + 4 + int(_fields(buffer[:head]).get("content-length", 0)) + 4
            while len(buffer) < size and (more := stream.read(CHUNK)):
                buffer += more
            if len(buffer) < size - 4:
                raise ValueError(f"a record at {at} is cut off")
            yield at, size, buffer[:size]
            buffer, at = buffer[size:], at + size
    while buffer:
        opener, parts, used = zlib.decompressobj(31), [], 0
        while not opener.eof:
            if not buffer:
                raise ValueError(f"a member at {at} is cut off")
            parts.append(opener.decompress(buffer))
            used += len(buffer) - len(opener.unused_data)
            buffer = opener.unused_data if opener.eof else stream.read(CHUNK)
        yield at, used, b"".join(parts)
        at += used
        buffer = buffer or stream.read(CHUNK)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parse(content: bytes) -> tuple[dict[str, str], int | None, str | None, bytes]:
    """Fields, HTTP status, media type and payload of a record. What isn't an HTTP response has no status."""
    head, _, rest = content.partition(_END)
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", 0))]
    if fields.get("warc-type") == "response" and block.startswith(b"HTTP/"):
        http, _, payload = block.partition(_END)
        status = http.split(b"\r\n", 1)[0].split()
        media = _fields(http).get("content-type", "").partition(";")[0].strip().lower() or None
        return fields, int(status[1]) if len(status) > 1 and status[1].isdigit() else None, media, payload
    return fields, None, None, block


def index_warc(files: DataFrame) -> DataFrame:
    """The index of the WARC files in ``files(file)``: one row per record, with its place and how to choose it.

    A file is read by one task, in chunks, one record in memory at a time. The digest is the record's own, or computed if it has none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "length", "type", "url", "digest", "page_id", "status", "media"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = _open(file)
                rows = []
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as stream:
                    for offset, length, content in _members(stream):
                        fields, status, media, payload = parse(content)
                        page = fields.get("warc-page-id")
                        rows.append((file, offset, length, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest") or digest_of(payload), int(page) if page else None, status, media))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    listed = files.select("file").where("file is not null").distinct()
    return listed.repartition(max(1, listed.count())).mapInArrow(scan, INDEX)


def coalesce(selected: DataFrame, gap_bytes: int = GAP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, start, stop, records)``: byte ranges that hold the selected index rows, in the order of the file.

    Neighbours at most ``gap_bytes`` apart share a read, and a read starts anew past ``range_bytes``.
    """
    order = Window.partitionBy("file").orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap_bytes, F.lit(True))
    runs = selected.withColumn("run", F.sum(apart.cast("int")).over(order))
    first = F.min("offset").over(Window.partitionBy("file", "run"))
    runs = runs.withColumn("part", F.floor((F.col("offset") - first) / range_bytes))
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "digest", "page_id", "url")))
    return runs.groupBy("file", "run", "part").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), inside.alias("records")).drop("run", "part")


def read_selected(selected: DataFrame, gap_bytes: int = GAP_BYTES, range_bytes: int = RANGE_BYTES, verify: bool = True) -> DataFrame:
    """``(page_id, url, digest, payload)`` of the selected index rows, by one read for each coalesced range.

    A payload whose digest isn't that of the index is an error, where the digest is one of those written here.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "digest": pa.string(), "payload": pa.binary()}
        name, source = None, None
        for batch in batches:
            for file, start, stop, records in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "records"))):
                if file != name:
                    fs, path = _open(file)
                    name, source = file, fs.open_input_file(path)
                data = source.read_at(stop - start, start)
                rows = []
                for r in records:
                    content = data[r["offset"] - start : r["offset"] - start + r["length"]]
                    if content[:2] == b"\x1f\x8b":
                        content = zlib.decompress(content, 31)
                    payload = parse(content)[3]
                    if verify and r["digest"].startswith("sha256:") and digest_of(payload) != r["digest"]:
                        raise ValueError(f"the record at {r['offset']} of {file} has another digest")
                    rows.append((r["page_id"], r["url"], r["digest"], payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    # a range is a row of a few kilobytes that stands for megabytes of reading, so ranges are dealt out evenly
    ranges = coalesce(selected, gap_bytes, range_bytes)
    return ranges.mapInArrow(fetch, "page_id bigint, url string, digest string, payload binary")


def archive_and_read(pages: DataFrame, where: Column | str = "type = 'response' and status = 200 and media = 'text/html'") -> DataFrame:
    """``(page_id, url, digest, n_bytes, html)``: pages written to archives, indexed, chosen by the index alone, and read.

    The index is written as a table of its own before anything is chosen. Rows with a null url or html have no record; null
    and repeated page ids have one each. A url's spaces and control characters come back percent-encoded. Empty input
    gives no rows. Extra columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    work = shared_dir(spark)
    files = written(write_warc(pages, work), f"{work}/files")
    index = written(index_warc(files), f"{work}/index")
    found = read_selected(index.where(where))
    return found.select("page_id", "url", "digest", F.length("payload").cast("bigint").alias("n_bytes"), F.decode("payload", "UTF-8").alias("html"))


def duckdb_sql(table: str = "pages") -> str:
    """What ``archive_and_read`` returns, in DuckDB's SQL."""
    return f"select page_id, url, 'sha256:' || sha256(html) as digest, strlen(html)::bigint as n_bytes, html from {table} where url is not null and html is not null"
