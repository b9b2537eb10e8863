"""WARC records in ZIP-packaged archives: written by tasks, read back by ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import map_batches, new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class _Stream:
    """A file that can only be written to, as stores offer it."""

    def __init__(self, file):
        self.file = file

    def write(self, data: bytes) -> int:
        self.file.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, date: str) -> bytes:
    """A gzip member with one WARC record. A revisit carries the headers of the answer only."""
    def name(i):
        return f"<urn:page:{'' if i is None else i}>"

    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode("ascii")
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    text = ("\r\n".join(head) + "\r\n\r\n").encode("utf-8")
    return gzip.compress(text + block + b"\r\n\r\n", compresslevel=6, mtime=0)


class Parsed(NamedTuple):
    page_id: int | None
    url: str
    kind: str
    digest: str
    refers_to: int | None
    payload: bytes


def parse(data: bytes) -> Parsed:
    """The record in a gzip member."""
    whole = gzip.decompress(data)
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a WARC record is cut off")

    def number(value: str | None) -> int | None:
        digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    return Parsed(number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"],
                  fields["warc-payload-digest"].removeprefix("sha1:"),
                  number(fields.get("warc-refers-to")), block.partition(b"\r\n\r\n")[2])


class Member(NamedTuple):
    name: str
    method: int
    start: int
    size: int


def members(file) -> list[Member]:
    """The members of a ZIP file from its central directory; only the needed ranges are read.

    The end record is looked for in the last 64 KB; where a count, size or place overflows,
    the ZIP64 end record and extra fields have it. A member's data begin behind its local
    header, whose own lengths count. Split archives, encryption and broken records raise.
    """
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if len(data) != n:
            raise ValueError("the ZIP file is cut off")
        return data

    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or
                       at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    disk, _, _, count, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
    end = tail_at + at
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        mark, _, where, _ = struct.unpack("<4sIQI", read(end - 20, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        fields = struct.unpack("<4sQHHIIQQQQ", read(where, 56))
        if fields[0] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        disk, count, length, start = fields[4], fields[7], fields[8], fields[9]
    if disk:
        raise ValueError("a split ZIP archive")
    directory, at, found = read(start, length), 0, []
    for _ in range(count):
        (mark, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _,
         where) = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
        if mark != b"PK\x01\x02" or flags & 1:
            raise ValueError("a broken or encrypted directory entry")
        name = directory[at + 46:at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        spot = 0
        while spot + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, spot)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, spot + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                where = next(wide) if where == 0xFFFFFFFF else where
            spot += 4 + n
        local = read(where, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        own_name, own_extra = struct.unpack_from("<HH", local, 26)
        found.append(Member(name, method, where + 30 + own_name + own_extra, packed))
        at += 46 + n_name + n_extra + n_note
    return found


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, record_type, refers_to`` of pages with ``page_id, url, payload``.

    Of records with equal payloads (by SHA-1) of at least ``min_bytes`` bytes, that with the
    largest page_id is the response, the others revisit it; rows that repeat this page_id are
    responses, too, and rows without a page_id always are.
    Only digests and ids are grouped; pages meet the pages they revisit in a join by id.
    """
    slim = pages.where(F.length("payload") >= min_bytes).select(
        F.sha1("payload").alias("sha"), F.col("page_id").alias("id")).where("id IS NOT NULL")
    groups = slim.groupBy("sha").agg(F.max("id").alias("refers_to"), F.min("id").alias("low"))
    again = slim.join(groups.where("low < refers_to"), "sha").where("id < refers_to").select(
        "id", "sha", "refers_to").distinct()
    again = again.withColumnRenamed("sha", "its_sha")
    marked = pages.withColumn("sha", F.sha1("payload")).join(
        again, (F.col("page_id") == F.col("id")) & (F.col("sha") == F.col("its_sha")), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return marked.select("page_id", "url", "payload", kind.alias("record_type"), "refers_to")


def write_archives(
    records: DataFrame, folder: str, max_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write records into ZIP archives in ``folder``; the manifest (``path, records, bytes``) is returned.

    Each task writes archives of its own, of up to about ``max_bytes``, one stored member
    with the gzipped records and one with their index. File names are new at every attempt;
    the manifest is a written table of those whose tasks succeeded, so that a task that runs
    twice leaves a stray file at worst, no second copy of a record.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            store, place = fs.FileSystem.from_uri(path)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            lines, at = [], 0
            with store.open_output_stream(place) as out, zipfile.ZipFile(
                    _Stream(out), "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                with archive.open(DATA, "w", force_zip64=True) as data:
                    while row is not None and at < max_bytes:
                        packed = record(*(value.as_py() for value in row), date)
                        data.write(packed)
                        lines.append(f"{at} {len(packed)}\n")
                        at += len(packed)
                        row = next(rows, None)
                archive.writestr(INDEX, "".join(lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([len(lines)], pa.int64()), pa.array([at], pa.int64())],
                schema=schema)

    return written(
        map_batches(
            records.select("page_id", "url", "payload", "record_type", "refers_to"), run,
            "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, bytes_per_task: int = 8 << 20) -> DataFrame:
    """All records of the archives in ``manifest``: ``page_id, url, record_type, payload_digest,
    refers_to, payload``.

    Directory and index of each archive are read first. Then tasks read the records' ranges,
    about ``bytes_per_task`` of neighbouring ones each, whatever the size of an archive: there are
    as many tasks as the bytes in the manifest make.
    Digests of responses are taken from the payload and must be those of the header. A
    revisit has no payload of its own: null.
    """
    found = pa.schema([("path", pa.string()), ("at", pa.int64()), ("n", pa.int64())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    inside = {m.name: m for m in members(file)}
                    data, index = inside[DATA], inside[INDEX]
                    if data.method or index.method:
                        raise ValueError("a member is compressed, not stored")
                    file.seek(index.start)
                    spans = [line.split() for line in file.read(index.size).split(b"\n") if line]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(spans), pa.string()),
                     pa.array([data.start + int(a) for a, _ in spans], pa.int64()),
                     pa.array([int(n) for _, n in spans], pa.int64())], schema=found)

    out = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {}
        try:
            for batch in batches:
                got, size = [], 0
                for path, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if path not in files:
                        if len(files) > 32:
                            files.pop(next(iter(files))).close()
                        store, place = fs.FileSystem.from_uri(path)
                        files[path] = store.open_input_file(place)
                    files[path].seek(at)
                    page = parse(files[path].read(n))
                    if page.kind == "response" and digest(page.payload) != page.digest:
                        raise ValueError(f"the payload of page {page.page_id} is damaged")
                    got.append((page.page_id, page.url, page.kind, page.digest, page.refers_to,
                                page.payload if page.kind == "response" else None))
                    size += len(page.payload)
                    if size > 4 << 20:
                        yield _batch(got, out)
                        got, size = [], 0
                yield _batch(got, out)
        finally:
            for file in files.values():
                file.close()

    spans = map_batches(manifest.select("path"), locate, "path string, at long, n long")
    whole = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, -(-whole // bytes_per_task))
    dealt = spans.repartition(tasks, "path", F.floor(F.col("at") / bytes_per_task))
    return map_batches(
        dealt, fetch, "page_id long, url string, record_type string, payload_digest string,"
        " refers_to long, payload binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``page_id, url, payload`` into archives in the shared folder and read all back.

    Columns: ``page_id, url, record_type, payload_digest, refers_to, payload_bytes``; revisits
    have the payload size of the response they refer to. A null payload counts as empty, a
    null url is written as an empty one. Repeated rows give repeated records. An empty table
    gives no rows.
    """
    ready = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    folder = new_path(pages.sparkSession, "archives")
    records = written(read_archives(write_archives(mark_revisits(ready, min_bytes), folder))
                      .withColumn("payload_bytes", F.length("payload").cast("long"))
                      .drop("payload"), "records")
    known = records.where("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("id"), F.col("payload_digest").alias("its_digest"),
        F.col("payload_bytes").alias("its_bytes")).distinct()
    return records.join(
        known, (F.col("refers_to") == F.col("id"))
        & (F.col("payload_digest") == F.col("its_digest")), "left").select(
        "page_id", "url", "record_type", "payload_digest", "refers_to",
        F.coalesce("payload_bytes", "its_bytes").alias("payload_bytes"))
