"""WARC records in ZIP-packaged archives, and a reader that never extracts them.

**Writing.** Each task streams its pages into one archive: a ZIP file with two stored
members, the WARC (one gzip member per record) and an index with a line per record. Nothing
larger than a record and the index is held in memory. A repeated task writes another file;
only the files named by the task that Spark commits are in the returned manifest.

**Reading.** The tail of the file gives the end record, or through its locator the ZIP64
one; the central directory gives the members; a member's local header gives where its bytes
begin. From then on records are range reads of the archive file by the offsets of the
index, so a large archive is split between tasks by ranges of its index.

**Revisits.** Of pages with equal payloads, found by digest, the smallest page id is the
response. Sizes of groups do not matter: the smallest id per digest is a partial
aggregation, and the rows of a digest are spread over ``SALT`` parts when it is joined back.

**Edge cases.** A null payload is empty (and of zero bytes). A null url becomes an empty
target. A page without an id is a revisit if a page with an id has its payload, else a response;
its own id comes back as null. Equal ids with equal payloads are all responses. No rows:
no archives and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.session import new_path, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
SALT = 8
#: Bytes of compressed records that one task of the reader takes at least, and a range read at most.
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Member(NamedTuple):
    """A file inside a ZIP archive, as its central directory has it."""

    name: str
    method: int
    stored: int
    size: int
    header: int


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- ZIP directories -------------------------------------------------------------------------


def _at(f, offset: int, n: int) -> bytes:
    out = f.read_at(n, offset) if n else b""
    if len(out) != n:
        raise ValueError(f"archive ends before byte {offset + n}")
    return bytes(out)


def _directory(f, size: int) -> tuple[int, int, int]:
    """Number of entries, size and offset of the central directory."""
    tail_at = max(0, size - 22 - 65535)
    tail = _at(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive: no end record")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    before = tail_at + at - 20
    if before >= 0 and (loc := _at(f, before, 20)).startswith(LOCATOR):
        end64 = _at(f, struct.unpack_from("<Q", loc, 8)[0], 56)
        if not end64.startswith(END64):
            raise ValueError("ZIP64 locator points to no end record")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    elif 0xFFFFFFFF in (length, start):
        raise ValueError("ZIP64 end record is missing")
    return count, length, start


def members(f, size: int) -> list[Member]:
    """Members listed by the central directory; ZIP64 sizes and offsets are taken from the extra field."""
    count, length, start = _directory(f, size)
    raw, at, out = _at(f, start, length), 0, []
    for _ in range(count):
        if raw[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, pos = raw[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while pos + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, pos)
            if kind == 1:  # only the fields that overflow are there, in this order
                p = pos + 4
                if plain == 0xFFFFFFFF:
                    plain, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                if stored == 0xFFFFFFFF:
                    stored, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, p)[0]
            pos += 4 + n
        out.append(Member(name, method, stored, plain, header))
        at += 46 + n_name + n_extra + n_note
    return out


def member_start(f, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = _at(f, member.header, 30)
    if not head.startswith(LOCAL):
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


# --- records -----------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, length: int) -> bytes:
    """One WARC record; a revisit has the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


class Record(NamedTuple):
    """A parsed record; ``payload`` is None for a revisit."""

    page_id: int | None
    url: str
    record_type: str
    digest: str
    length: int
    refers_to: int | None
    payload: bytes | None


def _page(urn: str | None) -> int | None:
    got = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


def parse(raw: bytes) -> Record:
    """A record from its uncompressed bytes; a response's payload must have the stated digest."""
    version, head, rest = _headers(raw)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    _, http, payload = _headers(rest[:int(head["content-length"])])
    kind, digest, length = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError("payload differs from its digest")
    return Record(_page(head["warc-record-id"]), head["warc-target-uri"], kind, digest, length, _page(head.get("warc-refers-to")),
                  payload if kind == "response" else None)


# --- Spark ----------------------------------------------------------------------------------------


def with_digest(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, n, refers_to): what a record needs."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "n": F.length("payload")})
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    first = (rows.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("sha", "n", "first", spread.alias("salt")))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(first, ["sha", "n", "salt"], "left")
    return out.select("page_id", "url", "payload", "sha", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", level: int = 4) -> DataFrame:
    """Write one archive per task into ``folder``; returns the staged manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        path, index, offset = f"{folder.rstrip('/')}/pages-{uuid.uuid4().hex}.wacz", [], 0
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        with system.open_output_stream(opened(path)[1]) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as zf:
            with zf.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                for b in (x for group in ([first], batches) for x in group):
                    cols = [b.column(i) for i in range(5)]
                    for pid, target, payload, sha, ref in zip(*[c.to_pylist() if i != 2 else _payloads(c) for i, c in enumerate(cols)], strict=True):
                        digest = base64.b32encode(bytes.fromhex(sha)).decode()
                        raw = gzip.compress(record(pid, target, payload, digest, ref, len(payload)), level, mtime=0)
                        data.write(raw)
                        index.append(json.dumps({"url": target, "digest": digest, "offset": offset, "length": len(raw)}))
                        offset += len(raw)
            zf.writestr(INDEX, "\n".join(index))
        yield pa.record_batch([pa.array([path]), pa.array([len(index)], pa.int64())], ["path", "records"])

    return staged(with_digest(pages, id, url, html).mapInArrow(run, "path string, records long"), "manifest")


def _payloads(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() for x in column)


def index_ranges(manifest: DataFrame) -> DataFrame:
    """(path, start, stop, lengths): runs of records inside each archive, in file offsets, by the archives' own indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = opened(path)
                with system.open_input_file(at) as f:
                    found = {m.name: m for m in members(f, f.size())}
                    base, text = member_start(f, found[DATA]), _at(f, member_start(f, found[INDEX]), found[INDEX].size)
                starts, lengths = [], []
                for line in text.splitlines():
                    entry = json.loads(line)
                    starts.append(base + entry["offset"])
                    lengths.append(entry["length"])
                i = 0
                while i < len(starts):
                    j, total = i, 0
                    while j < len(starts) and (j == i or total + lengths[j] <= RANGE_BYTES):
                        total += lengths[j]
                        j += 1
                    yield pa.record_batch([pa.array([path]), pa.array([starts[i]], pa.int64()), pa.array([lengths[i:j]], pa.list_(pa.int64()))],
                                          ["path", "start", "lengths"])
                    i = j

    return manifest.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def read_archives(manifest: DataFrame) -> DataFrame:
    """DataFrame of (page_id, payload_bytes, payload_digest, record_type, refers_to), read back by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, lengths in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows = list(records(path, start, lengths))
                yield pa.record_batch([pa.array([r.page_id for r in rows], pa.int64()), pa.array([r.length for r in rows], pa.int64()),
                                       pa.array([r.digest for r in rows], pa.string()), pa.array([r.record_type for r in rows], pa.string()),
                                       pa.array([r.refers_to for r in rows], pa.int64())],
                                      ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ranges = staged(index_ranges(manifest), "ranges")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "start").mapInArrow(run, RESULT)


def records(path: str, start: int, lengths: list[int]) -> Iterator[Record]:
    """Consecutive records of an archive from byte ``start`` on, read a bounded range at a time."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        i = 0
        while i < len(lengths):
            j, total = i, 0
            while j < len(lengths) and (j == i or total + lengths[j] <= READ_BYTES):
                total += lengths[j]
                j += 1
            raw, pos = _at(f, start, total), 0
            for n in lengths[i:j]:
                yield parse(zlib.decompress(raw[pos:pos + n], 31))._replace(payload=None)
                pos += n
            i, start = j, start + total


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page into archives in the shared folder and read all records back."""
    folder = new_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, id, url, html))
