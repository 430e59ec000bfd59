"""WARC archives: written as gzip members of one record each, and read again in byte ranges.

Writing: a task writes its records to files of its own in the archive's folder, `FILE_BYTES` each, and returns their names;
only files that a task returned count, so what a lost or repeated task left is ignored. Records whose payload was stored
before are revisits: the record that keeps the payload is found from digests alone (`revisits`), and a payload that a
third of the pages share meets in no task.

Reading: a file is cut into ranges of `SPLIT_BYTES`, whatever its members. A task looks in its range for gzip's magic,
takes a place as a member if what it unpacks begins with a WARC header, and then follows member by member; it owns the
records that begin in its range, the last of which may end beyond. Compressed data can hold the magic, and even a whole
member, where a payload is itself an archive: each file's members carry one random mark in gzip's extra field, so that
members of another file aren't taken for its own. A file without marks, from another writer, is read by the header alone.
A member that is broken ends there, and the search goes on behind it.

Defined results: a null payload is empty; a null url gives a record without a target; control characters and blanks in a url
are percent-encoded; rows that repeat are records of their own, and where the largest id repeats, each of its rows is a response;
a null id is smaller than all others; an empty table gives an archive without files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from .hot_keys import looked_up
from .shared import ship, stored, trimmed

ship(__name__)

#: Bytes after which a task begins another file, of a reader's range, and of what a reader fetches at a time.
FILE_BYTES, SPLIT_BYTES, FETCH = 256 << 20, 32 << 20, 1 << 20
#: Tasks of a reader at most; of more ranges each takes several.
TASKS = 20_000
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
#: Of gzip's extra field: the subfield that holds the file's mark, and the mark's length.
FIELD, MARK = b"cz", 16
RECORD = re.compile(rb"WARC/1\.\d\r\n")
#: Bytes that a WARC header has at most.
HEADER = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, bytes long, records long"
FOUND = "path string, at long, record_id string, type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, bytes, digest, first) of pages(page_id, url, html): `first`, where it is there, is the page that keeps an equal payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    # told apart by SHA-256; SHA-1 is what WARC names
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("key", F.when(F.col("bytes") >= least, F.unhex(F.sha2("payload", 256))))
    met = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1 AND first IS NOT NULL")
    whole = looked_up(rows, met, ["key"], "n")
    return whole.select("page_id", "url", "payload", "bytes", F.sha1("payload").alias("digest"), F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def target(url: str) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()) if re.search(r"[\x00-\x20\x7f]", url) else url


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, date: str) -> bytes:
    """A WARC record of a page as an HTTP response; of a revisit the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {target(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"] if first is not None else []
    block = http + payload if first is None else http
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, mark: bytes, level: int) -> bytes:
    """A gzip member with the file's mark in its extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    extra = FIELD + struct.pack("<H", len(mark)) + mark
    return MAGIC + b"\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def written(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = 6, date: str = DATE) -> DataFrame:
    """Files (path, bytes, records) of a new archive in `folder`, from rows of `revisits`. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        out, path, n, size, mark, files = None, "", 0, 0, b"", []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "bytes", "digest", "first")), strict=True):
                if out is None:
                    path, n, size, mark = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, os.urandom(MARK)
                    out = store.open_output_stream(f"{top}/{path}", compression=None)
                data = member(record(*(x.as_py() for x in row), date), mark, level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    files.append((f"{folder}/{path}", size, n))
                    out = None
        if out is not None:
            out.close()
            files.append((f"{folder}/{path}", size, n))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return stored(rows.select("page_id", "url", "payload", "bytes", "digest", "first").mapInArrow(trimmed(run), FILES), keep=True)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Files (path, bytes) of archives of any writer in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))


class Window:
    """A file by absolute places, fetched piece by piece; what lies before `keep` may go."""

    def __init__(self, source: pa.NativeFile, size: int, at: int, fetch: int = FETCH):
        self.source, self.size, self.start, self.data, self.fetch = source, size, at, b"", fetch

    def upto(self, end: int) -> None:
        while (have := self.start + len(self.data)) < min(end, self.size):
            self.source.seek(have)
            if not (got := self.source.read(max(self.fetch, min(end, self.size) - have))):
                break
            self.data += got

    def keep(self, at: int) -> None:
        if at - self.start >= self.fetch:
            self.data = self.data[at - self.start :]
            self.start = min(at, self.size)

    def piece(self, at: int, n: int) -> bytes:
        self.upto(at + n)
        return self.data[at - self.start : at - self.start + n]


def opening(window: Window, at: int) -> tuple[int, bytes] | None:
    """Of a gzip header at this place its length, and the mark (empty where it has none)."""
    head = window.piece(at, 12)
    if len(head) < 10 or head[:3] != MAGIC or head[3] & 0xE0:
        return None
    flags, n, mark = head[3], 10, b""
    if flags & 4:
        if len(head) < 12:
            return None
        (size,) = struct.unpack("<H", head[10:12])
        extra, i = window.piece(at + 12, size), 0
        if len(extra) < size:
            return None
        while i + 4 <= size:
            (held,) = struct.unpack("<H", extra[i + 2 : i + 4])
            if extra[i : i + 2] == FIELD:
                mark = extra[i + 4 : i + 4 + held]
            i += 4 + held
        n += 2 + size
    for flag in (8, 16):  # a name, a comment
        if flags & flag:
            end, width = -1, 0
            while end < 0 and width < HEADER:
                width += 256
                text = window.piece(at + n, width)
                end = text.find(b"\0")
                if len(text) < width and end < 0:
                    return None
            if end < 0:
                return None
            n += end + 1
    return n + (2 if flags & 2 else 0), mark


def unpacked(window: Window, at: int, mark: bytes) -> tuple[bytes, int] | None:
    """The record of the member at this place and where it ends; None if there is none."""
    head = opening(window, at)
    if head is None or (mark and head[1] != mark):
        return None
    unpacker, out, told, pos = zlib.decompressobj(-15), bytearray(), False, at + head[0]
    while not unpacker.eof:
        data = window.piece(pos, 1 << 15)
        if not data:
            return None
        try:
            out += unpacker.decompress(data)
        except zlib.error:
            return None
        pos += len(data)
        if not told and (len(out) >= HEADER or b"\r\n\r\n" in out or unpacker.eof):
            if parsed(bytes(out[:HEADER])) is None:
                return None
            told = True
    pos -= len(unpacker.unused_data)
    if window.piece(pos, 8) != struct.pack("<II", zlib.crc32(out), len(out) & 0xFFFFFFFF):
        return None
    return bytes(out), pos + 8


def parsed(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a WARC header in small letters, and where it ends."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not RECORD.match(data):
        return None
    fields: dict[str, str] = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return (fields, end + 4) if {"warc-type", "warc-record-id"} <= fields.keys() and fields.get("content-length", "").isdigit() else None


def members(window: Window, start: int, end: int, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """Places and records of the members that begin in a range."""
    at = start
    while at < end:
        if (found := unpacked(window, at, mark)) is not None:
            yield at, found[0]
            at = found[1]
            window.keep(at)
            continue
        at += 1  # not a member, or a broken one: on to the next magic
        while at < end:
            window.keep(at)
            data = window.piece(at, min(FETCH, end - at) + len(MAGIC) - 1)
            hit = data.find(MAGIC)
            if hit >= 0:
                at += hit
                break
            if len(data) < len(MAGIC):
                return
            at += len(data) - len(MAGIC) + 1


def fields(data: bytes) -> tuple:
    """record_id, type, uri, refers_to, payload_digest, payload_bytes, payload of a record."""
    header, at = parsed(data)
    block = data[at : at + int(header["content-length"])]
    payload: bytes | None = block
    size, kind = len(block), header["warc-type"]
    if header.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size = int(told[1]) if told and kind == "revisit" else len(payload)
    if kind == "revisit":
        payload = None
        name, _, value = header.get("warc-payload-digest", "").partition(":")
        digest = base64.b32decode(value).hex() if name == "sha1" and len(value) == 32 else value.lower()
    else:
        digest = hashlib.sha1(payload).hexdigest()
    bare = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
    return bare(header["warc-record-id"]), kind, header.get("warc-target-uri"), bare(header.get("warc-refers-to")), digest, size, payload


def records(files: DataFrame, split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of files(path, bytes): where they are, their fields, and their payload (null for revisits, and unless `payloads`).

    payload_digest is the SHA-1 of the payload as read; of a revisit it and payload_bytes are what the record says.
    """
    cuts = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in FOUND.split(", ")]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    first = opening(Window(source, size, 0, 4096), 0)
                    mark = first[1] if first else b""
                    out, held = [], 0
                    for at, data in members(Window(source, size, start), start, min(size, start + split), mark):
                        *told, payload = fields(data)
                        out.append((path, at, *told, payload if payloads else None))
                        held += len(data) if payloads else 256
                        if held >= 1 << 24:
                            yield rows(out)
                            out, held = [], 0
                    yield rows(out)

    # dealt evenly, and by a number, as adaptive execution would join the few bytes that name them
    return cuts.repartition(max(1, min(TASKS, cuts.count()))).mapInArrow(trimmed(run), FOUND)


def archived(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, split: int = SPLIT_BYTES) -> DataFrame:
    """Pages(page_id, url, html) written to an archive and read from it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Without a folder the archive is a new one in the folder that driver and executors share.
    """
    files = written(revisits(pages, least), folder or f"{shared_folder(pages.sparkSession)}/cadenza-warc-{uuid.uuid4().hex}", file_bytes)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return records(files, split, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
