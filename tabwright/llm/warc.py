"""WARC archives: one gzip member per record, written by Spark tasks and read back record by record."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.tables import text_bytes
from tabwright.storage import scratch_path, written

#: Compressed bytes asked for at a time.
CHUNK = 1 << 16
#: zlib window bits: a gzip member.
_GZIP = 31
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"

_RECORDS = pa.schema([("file", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                      ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_RECORDS_SQL = ("file string, position long, record_type string, record_id string, target_uri string, page_id long, "
                "payload binary, payload_bytes long, payload_digest string, refers_to long")


class DamagedArchive(ValueError):
    """A record whose framing or digest is wrong."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _header_value(text: str | None) -> str:
    """A value that fits one header line: line breaks and other controls are percent-encoded."""
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    head = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()
    packer = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
    return packer.compress(head + block + _CRLF + _CRLF) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, level: int = 6) -> bytes:
    """One compressed ``response`` or ``revisit`` record; a revisit keeps length and digest of the payload, not the payload."""
    name = lambda i: f"<urn:tabwright:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date),
               ("WARC-Target-URI", _header_value(url)), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}")]
    if revisit:
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", _PROFILE)]
    return _member(headers, block, level)


def _members(stream) -> Iterator[bytes]:
    """The decompressed members of a stream, one after the other; holds one member and one chunk."""
    data = stream.read(CHUNK)
    while data:
        unpacker, parts = zlib.decompressobj(_GZIP), []
        while not unpacker.eof:
            if not data:
                raise DamagedArchive("the file ends within a record")
            try:
                parts.append(unpacker.decompress(data))
            except zlib.error as e:
                raise DamagedArchive(f"a record does not decompress: {e}") from e
            data = unpacker.unused_data if unpacker.eof else stream.read(CHUNK)
        yield b"".join(parts)
        data = data or stream.read(CHUNK)


def _framed(data: bytes, start: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and what follows the empty line."""
    head, gap, rest = data.partition(_CRLF + _CRLF)
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not head.startswith(start):
        raise DamagedArchive("a record without a header")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, rest


def read_records(stream) -> Iterator[dict]:
    """Read an archive in order: ``headers, http, payload`` of each record, lengths and digests checked.

    Every record is framed by its Content-Length; a wrong length, digest or ending raises ``DamagedArchive``.
    """
    for data in _members(stream):
        headers, rest = _framed(data, b"WARC/")
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise DamagedArchive("a record without a length") from e
        block, end = rest[:length], rest[length:]
        if len(block) < length or end != _CRLF + _CRLF:
            raise DamagedArchive("a record's length does not fit its content")
        if (want := headers.get("warc-block-digest")) and want != f"sha1:{digest32(block)}":
            raise DamagedArchive("a block does not match its digest")
        http, payload = ({}, block)
        if headers.get("content-type", "").startswith("application/http"):
            http, payload = _framed(block, b"HTTP/")
        if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest")) and want != f"sha1:{digest32(payload)}":
            raise DamagedArchive("a payload does not match its digest")
        yield {"headers": headers, "http": http, "payload": payload}


def _write_part(folder: str, level: int, date: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A fresh name for every attempt: a file counts only once its name has come back in a finished task's rows.
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int, int]] = []
        out, name, count, size = None, "", 0, 0

        def close() -> None:
            out.close()
            files.append((name, count, size))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")]
            for start in range(0, batch.num_rows, 256):
                page_ids, urls, htmls, refers, revisits = (c.slice(start, 256) for c in columns)
                for page_id, url, payload, refers_to, revisit in zip(page_ids.to_pylist(), urls.to_pylist(), text_bytes(htmls), refers.to_pylist(), revisits.to_pylist()):
                    if out is None:
                        name, count, size = posixpath.join(root, f"{uuid.uuid4().hex}.warc.gz"), 0, 0
                        out = store.open_output_stream(name, compression=None)
                        info = b"software: tabwright\r\nformat: WARC file version 1.1\r\n"
                        out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                           ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{digest32(info)}")], info, level))
                    data = record(page_id, url, payload, refers_to, revisit, date, level)
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= roll_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()),
                                          pa.array([f[2] for f in files], pa.int64())], ["file", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 6, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write ``page_id, url, html`` as ``.warc.gz`` files below ``folder``; returns the manifest ``file, records, bytes``.

    Of records with equal payloads (UTF-8 of ``html``, null as empty) of at least ``least_bytes``, the one with the largest
    ``page_id`` is a response and the others revisit it; smaller payloads are always responses. Rows that repeat that
    page_id and payload are all responses; a null page_id is smaller than any other. Other columns are ignored.

    The manifest is written too and lists the files of finished tasks only, so what a lost task left behind is not read. ``folder`` must
    be one that all executors reach.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared = F.octet_length("html") >= least_bytes
    # One row per payload that occurs more than once; a group of any size is summed before it is shuffled. Written, so
    # that the join reads plain shuffles and can split such a group between tasks.
    groups = rows.filter(shared).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = written(groups.select("digest", "refers_to", F.lit(True).alias("grouped")), "warc-groups")
    marked = rows.join(groups, "digest", "left")
    marked = marked.withColumn("revisit", F.coalesce(F.col("grouped") & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False)) & shared)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    files = marked.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "revisit")
    return written(files.mapInArrow(_write_part(folder, level, date, roll_bytes), "file string, records long, bytes long"), "warc-manifest")


def _read_part(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        number = lambda urn: None if urn.endswith(":none>") else int(urn.rpartition(":")[2][:-1])
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            for name, want in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                with store.open_input_stream(name, compression=None) as stream:
                    position = 0
                    for found in read_records(stream):
                        h, kind = found["headers"], found["headers"].get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        payload = found["payload"] if kind == "response" else None
                        size = int(found["http"].get("content-length", -1))
                        if payload is not None and size != len(payload):
                            raise DamagedArchive(f"{name}: a payload's length is wrong")
                        rows.append((name, position, kind, h["warc-record-id"], h.get("warc-target-uri"), number(h["warc-record-id"]), payload, size,
                                     h["warc-payload-digest"].removeprefix("sha1:"), number(h["warc-refers-to"]) if kind == "revisit" else None))
                        position, held = position + 1, held + len(payload or b"")
                        if len(rows) >= 4096 or held >= 1 << 24:
                            yield flush()
                    if position != want:
                        raise DamagedArchive(f"{name}: {position} records, expected {want}")
        if rows:
            yield flush()

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the listed archives, several files at a time but each in order: one row per response or revisit record.

    ``payload`` is null for revisits; ``payload_bytes`` and ``payload_digest`` always tell of the full payload.
    """
    return manifest.select("file", "records").mapInArrow(_read_part(folder), _RECORDS_SQL)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages below the shared folder and read the archives back."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, least_bytes)
    # One file name per task, so that reading is as parallel as writing was.
    files = max(1, manifest.count())
    return read_archives(manifest.repartition(files, "file"), folder)
