"""WARC 1.1 archives as a PySpark Python data source, read and write.

Writing: one record per row in rolling files of about ``ROLL`` bytes, each record its own gzip member whose extra
field (SL) holds the member's compressed and whole length; the commit writes a manifest, so files of failed
tasks are never read. Reading: partitions are planned from the manifest (or the folder) as groups of files of
about ``SPLIT`` bytes. Predicates on record type and headers are pushed down. A record's headers are parsed
first; a record that they rule out, or whose payload is not wanted, is passed over by its SL length without
inflating the rest, where there is one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.llm.common import NO_ID, lane, lane_groups, shared_dir, table, with_id, written

ROLL, SPLIT = 64 << 20, 8 << 20
MANIFEST = "manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary, headers map<string,string>"
#: Column to the header that it holds: these take pushed predicates.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


class Folder:
    """A folder, or one file, on local disk or in any store that pyarrow opens by URI."""

    def __init__(self, path: str):
        self.fs, self.top = None, path
        if path.startswith("file:"):
            self.top = unquote(urlparse(path).path)
        elif "://" in path:
            from pyarrow.fs import FileSystem

            self.fs, self.top = FileSystem.from_uri(path)

    def make(self) -> None:
        self.fs.create_dir(self.top, recursive=True) if self.fs else Path(self.top).mkdir(parents=True, exist_ok=True)

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.top}/{name}", compression=None) if self.fs else open(f"{self.top}/{name}", "wb")

    def read(self, path: str):
        return self.fs.open_input_file(path) if self.fs else open(path, "rb")

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.top}/{name}") if self.fs else Path(self.top, name).unlink()

    def files(self) -> list[tuple[str, int]]:
        """Path and size of all files, of the one file itself."""
        if self.fs:
            from pyarrow.fs import FileSelector, FileType

            info = self.fs.get_file_info(self.top)
            found = [info] if info.type == FileType.File else self.fs.get_file_info(FileSelector(self.top, recursive=True, allow_not_found=True))
            return [(i.path, i.size) for i in found if i.type == FileType.File]
        top = Path(self.top)
        return [(str(p), p.stat().st_size) for p in ([top] if top.is_file() else top.rglob("*")) if p.is_file()]

    def manifest(self) -> list | None:
        path = f"{self.top}/{MANIFEST}"
        if not any(p == path for p, _ in self.files()):
            return None
        with self.read(path) as f:
            return json.loads(f.read())


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean(value: str) -> str:
    """One header line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member with one record."""
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in headers).encode()
    whole = b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    data = deflate.compress(whole) + deflate.flush()
    size = 10 + 14 + len(data) + 8
    extra = struct.pack("<H2sHQ", 12, b"SL", 8, size)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + data + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)


def page_record(record_id: str, url: str | None, date: str, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit of refers_to without. digest: SHA-1 in hex or base32."""
    if len(digest) == 40:
        digest = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if refers_to:
        headers += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    return record(headers, http + (payload or b""))


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        folder = Folder(self.path)
        folder.make()
        files, out, size = [], None, 0
        for r in rows:
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                out, size = folder.write(name), 0
                files.append([name, 0])
            data = page_record(r.record_id, r.target_uri, r.date, r.payload_digest, r.payload_bytes, r.payload, r.refers_to)
            out.write(data)
            size += len(data)
            files[-1][1] = size
            if size >= ROLL:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        folder = Folder(self.path)
        folder.make()
        before = [] if self.overwrite else folder.manifest() or []
        with folder.write(MANIFEST) as out:
            out.write(json.dumps(before + [f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        for name, _ in (f for m in messages if m for f in m.files):
            Folder(self.path).delete(name)


@dataclass
class Files(InputPartition):
    names: list


class _Member:
    """Inflates a gzip member (or passes plain bytes) as far as asked."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.size = file, at, b"", None
        file.seek(at)
        start = file.read(12)
        self.over = not start
        self.gzip = start[:2] == b"\x1f\x8b"
        if self.gzip and start[3] & 4:
            extra = file.read(struct.unpack("<H", start[10:12])[0])
            if extra[:2] == b"SL":
                self.size = struct.unpack("<Q", extra[4:12])[0]
        file.seek(at)
        self.inflate = zlib.decompressobj(31) if self.gzip else None

    def more(self) -> bool:
        if self.gzip:
            if self.inflate.eof:
                return False
            data = self.inflate.unconsumed_tail or self.file.read(1 << 16)
            if not data:
                return False
            self.held += self.inflate.decompress(data, 1 << 16)
            return True
        data = self.file.read(1 << 16)
        self.held += data
        return bool(data)

    def take(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self.more():
                break
            parts.append(self.held)
            size += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def skip(self, n: int) -> None:
        """Passes n bytes without keeping them."""
        while n > 0 and (self.held or self.more()):
            gone = min(n, len(self.held))
            self.held, n = self.held[gone:], n - gone

    def another(self) -> bool:
        """Whether a further record stands in this member (or, in a plain file, after this one)."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return True
            if not self.more():
                return False

    def next(self) -> int:
        """Where the next member starts, this one being read to its end."""
        return self.file.tell() - len(self.inflate.unused_data) if self.gzip else self.file.tell()


def parse_headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def records(file, tests: list, payload: bool) -> Iterator[tuple]:
    """Rows of an archive: gzip members of one or more records each, or plain records one after another."""
    at = 0
    while True:
        m = _Member(file, at)
        if m.over:
            return
        first = True
        while first or m.another():
            head = m.until(b"\r\n\r\n")
            if head is None or not head.lstrip().startswith(b"WARC/"):
                if first and head is None and not m.held.strip():
                    break  # a member, or the end of a file, without records
                raise ValueError(f"no WARC record in the member at byte {at}")
            first = False
            h = parse_headers(head.lstrip())
            rest = int(h.get("content-length", 0))
            if all(t(h) for t in tests):
                size, data, digest = rest, None, h.get("warc-payload-digest")
                if h.get("content-type", "").startswith("application/http"):
                    before = m.until(b"\r\n\r\n") or b""
                    rest -= len(before) + 4
                    size = int(parse_headers(before).get("content-length", rest))
                if payload and h.get("warc-type") != "revisit":
                    data = m.take(rest)
                    rest = 0
                    if len(data) != size or digest and digest.startswith("sha1:") and digest[5:] != base32_sha1(data):
                        raise ValueError(f"the payload of a record in the member at byte {at} is not what its headers say")
                yield (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), digest.removeprefix("sha1:") if digest else None, h.get("warc-refers-to"), size, data, h)
            if m.size:  # one record, of known length: what is left of it is not inflated
                break
            m.skip(rest)
        at = m.at + m.size if m.size else m.next()


def as_test(f: Filter):
    """A test of headers for a pushed predicate, or None."""
    column = ".".join(getattr(f, "attribute", ()))
    if column not in HEADERS or column == "payload_digest" and not isinstance(f, EqualTo | EqualNullSafe | In):
        return None
    key, strip = HEADERS[column], "sha1:" if column == "payload_digest" else ""
    get = lambda h: None if h.get(key) is None else h[key].removeprefix(strip)
    if isinstance(f, EqualTo | EqualNullSafe):
        return lambda h: get(h) == f.value
    if isinstance(f, In):
        return lambda h: get(h) in f.value
    if isinstance(f, StringStartsWith):
        return lambda h: (get(h) or "").startswith(f.value)
    if isinstance(f, StringContains):
        return lambda h: f.value in (get(h) or "")
    return None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if test := as_test(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list:
        folder = Folder(self.path)
        listed = folder.manifest()
        files = [(f"{folder.top}/{n}", s) for n, s in listed] if listed is not None else [x for x in folder.files() if x[0].endswith((".warc", ".warc.gz"))]
        out, size = [], SPLIT
        for name, n in sorted(files):
            if size + n > SPLIT:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        folder = Folder(self.path)
        for name in partition.names:
            with folder.read(name) as file:
                yield from records(file, self.tests, self.payload)


class WarcDataSource(DataSource):
    """Format "warc". Options: path; payload ("true": inflate and return payloads; "false": the column is null)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


ID = "urn:quire:page:"


def archive(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row of pages(page_id, url, html) under path: payload the html in UTF-8 (null: empty).

    Of records with equal payloads of at least least bytes, that with the smallest page_id is the response and
    the others revisit it; all smaller payloads are responses. A null page_id is written as the smallest number
    and read back as null. Rows that repeat a page_id and payload are responses of their own where they are
    first. Other columns are ignored; an empty table gives an archive without records.
    """
    register(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    p = pages.select(with_id("page_id").alias("page_id"), F.col("url"), F.encode(html, "utf-8").alias("payload"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("size")).withColumn("lane", lane("page_id", "sha1"))
    lanes, groups = lane_groups(p.where(F.col("size") >= least), ["sha1", "size"], "page_id")
    back = written(lanes.join(groups.select("sha1", "size", "first"), ["sha1", "size"]))
    p = p.join(back, ["lane", "sha1", "size"], "left").withColumn("again", F.col("first").isNotNull() & (F.col("first") != F.col("page_id")))
    name = lambda c: F.concat(F.lit(f"<{ID}"), c.cast("string"), F.lit(">"))
    out = p.select(
        name(F.col("page_id")).alias("record_id"), F.lit(None).cast("string").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.col("sha1").alias("payload_digest"),
        F.when(F.col("again"), name(F.col("first"))).alias("refers_to"), F.col("size").alias("payload_bytes"), F.when(~F.col("again"), F.col("payload")).alias("payload"), F.lit(None).cast("map<string,string>").alias("headers"),
    )
    out.write.format("warc").mode("append").save(path)


def archived(spark, path: str, payload: bool = True) -> DataFrame:
    """The records under path."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    archive(table(spark, sf_dir, "pages"), path)
    r = archived(spark, path)
    number = lambda c: F.when(F.col(c).isNotNull(), F.nullif(F.regexp_extract(c, ID + r"(-?\d+)", 1).cast("long"), F.lit(NO_ID)))
    return r.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op1_warc": op1_warc}
