"""Files to books: discovery, kinds by content, zip members, EPUB, FictionBook, comics, plain text and pictures.

Parsers are total: whatever a file holds, a row comes back, with one of the codes in ``ERRORS`` where nothing could be read.
They run per file in Arrow batches; a file is one row of Spark's binaryFile source.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from posixpath import dirname, join, normpath
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from quire.functions.html import blocks_of
from quire.functions.text import decode_bytes

ERRORS = ("corrupt", "empty", "protected", "missing", "unsupported")
# Known extensions, longest first.
EXTENSIONS = [(".fb2.zip", "fb2"), (".epub", "epub"), (".xhtml", "html"), (".html", "html"), (".azw3", "kindle"), (".mobi", "kindle"), (".azw", "kindle"), (".prc", "kindle"), (".htm", "html"), (".fb2", "fb2"), (".cbz", "comic"), (".txt", "text"), (".md", "text"), (".pdf", "pdf")]
PICTURES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
MEMBER_MOST, ALL_MOST, DEPTH = 256 << 20, 2 << 30, 8
# How a Kindle book's text is packed.
STORED, LZ77, HUFFMAN = 1, 2, 17480


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, length, modified, content of known files below roots: no dot names, no sidecar folders, at most DEPTH folders deep."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dict.fromkeys(roots)))
    names = F.split(F.col("path"), "/")
    plain = lambda p: F.regexp_replace(p, "^file:/+", "/")
    # folders between the file and the nearest root above it
    tops = [re.sub("^file:/+", "/", r).rstrip("/") + "/" for r in roots]
    below = F.least(*(F.when(F.startswith(plain("path"), F.lit(t)), F.size(F.split(F.substr(plain("path"), F.lit(len(t) + 1)), "/")) - 1) for t in tops), F.lit(1 << 30))
    known = F.lower(F.col("path")).rlike("(" + "|".join(re.escape(e) for e, _ in EXTENSIONS) + ")$")
    shown = ~F.exists(names, lambda n: n.startswith(".") | n.endswith(".sdr"))
    return raw.where(known & shown & (below <= DEPTH)).select("path", "length", F.unix_timestamp("modificationTime").alias("modified"), "content").dropDuplicates(["path"])


def kind_by_name(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for end, kind in reversed(EXTENSIONS):
        out = F.when(F.endswith(F.lower(path), F.lit(end)), kind).otherwise(out)
    return out


def kind_by_magic(content: Column) -> Column:
    """By the first bytes; null where they do not tell."""
    first = lambda n: F.hex(F.substring(content, 1, n))
    head = F.lower(F.decode(F.substring(content, 1, 512), "iso-8859-1"))
    return (
        F.when(first(4) == "504B0304", "zip")
        .when(first(4) == "25504446", "pdf")
        .when(F.decode(F.substring(content, 61, 8), "iso-8859-1").isin("BOOKMOBI", "TEXtREAd"), "kindle")
        .when(head.rlike(r"<fictionbook[\s>]"), "fb2")
        .when(head.rlike(r"^\W*(<!doctype html|<html[\s>])"), "html")
    )


def safe_name(name: str) -> str | None:
    """A member's canonical name, or None for one that leaves the archive."""
    name = normpath(name.replace("\\", "/")).lstrip("/")
    return None if name.startswith("..") or name in ("", ".") or ":" in name.split("/")[0] else name


def zip_members(data: bytes) -> dict[str, bytes]:
    """Name to content; the last of equal names; what a damaged archive still gives, by its local headers."""
    out: dict[str, bytes] = {}
    total = 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                name = safe_name(i.filename)
                if name and not i.is_dir() and not i.flag_bits & 1 and i.file_size <= MEMBER_MOST and total + i.file_size <= ALL_MOST:
                    out[name] = z.read(i)
                    total += len(out[name])
        return out
    except Exception:  # noqa: BLE001  any damage: read by local headers
        pass
    for m in re.finditer(rb"PK\x03\x04", data):
        at = m.start()
        try:
            method, packed, n, extra = struct.unpack("<8xH8xI4xHH", data[at : at + 30])
        except struct.error:
            break
        name = safe_name(data[at + 30 : at + 30 + n].decode("utf-8", "replace"))
        body = data[at + 30 + n + extra :]
        if not name or name.endswith("/"):
            continue
        try:
            out[name] = zlib.decompressobj(-15).decompress(body, MEMBER_MOST) if method == 8 else body[:packed]
        except zlib.error:
            continue
    return out


def find_member(members: dict[str, bytes], name: str) -> str | None:
    """Exact, percent-decoded, then whatever the case."""
    for want in (name, unquote(name)):
        if want in members:
            return want
    low = {}
    for m in members:
        low.setdefault(m.casefold(), m)
    return low.get(unquote(name).casefold())


def zip_kind(names: list[str]) -> str | None:
    shown = [n for n in names if not any(p.startswith((".", "__MACOSX")) for p in n.split("/"))]
    if any(n.lower().endswith(("meta-inf/container.xml", ".opf")) for n in names):
        return "epub"
    if any(n.lower().endswith(".fb2") for n in shown):
        return "fb2"
    pictures = sum(n.lower().endswith(PICTURES) for n in shown)
    return "comic" if pictures * 2 > len(shown) else None


def xml(data: bytes) -> ElementTree.Element:
    """Declarations cut off, so no entity is ever expanded; names without namespaces."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\]\s*)?>", "", decode_bytes(data)[0], flags=re.S)
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    text = re.sub(r"&(?!(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;", text)
    root = ElementTree.fromstring(text)
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2].lower()
    return root


def said(e: ElementTree.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def epub(data: bytes) -> dict:
    members = zip_members(data)
    container = find_member(members, "META-INF/container.xml")
    package = None
    if container:
        package = next((find_member(members, e.get("full-path", "")) for e in xml(members[container]).iter("rootfile")), None)
    package = package or min((n for n in members if n.lower().endswith(".opf")), key=lambda n: (n.count("/"), natural(n)), default=None)
    if not package:
        return {"error": "missing"}
    if find_member(members, "META-INF/rights.xml") and find_member(members, "META-INF/encryption.xml"):
        return {"error": "protected"}
    root, here = xml(members[package]), dirname(package)
    items = {e.get("id", ""): (e.get("href", ""), e.get("media-type", ""), e.get("properties") or "") for e in root.iter("item")}
    spine = [items[e.get("idref")] for e in root.iter("itemref") if e.get("idref") in items]
    documents = [n for h, _, _ in spine if (n := find_member(members, normpath(join(here, unquote(h)))))]
    blocks, sections, anchors = [], [], {}
    for name in documents:
        own = blocks_of(decode_bytes(members[name])[0])
        if own:
            sections.append(len(blocks))
            anchors[name, ""] = len(blocks)
        for b in own:
            if b.get("id"):
                anchors.setdefault((name, b["id"]), len(blocks))
            blocks.append(b)
    toc = []
    for href, _, props in items.values():
        nav = find_member(members, normpath(join(here, unquote(href))))
        if nav and "nav" in props.split():
            toc = declared_nav(members[nav], nav, anchors)
    if not toc:
        ncx = next((find_member(members, normpath(join(here, unquote(h)))) for h, kind, _ in items.values() if kind == "application/x-dtbncx+xml"), None)
        toc = declared_ncx(members[ncx], ncx, anchors) if ncx else []
    if not toc:
        toc = [(b["t"], (b["l"] or 1) - 1, i) for i, b in enumerate(blocks) if b["k"] == "h"]
    authors = list(dict.fromkeys(said(e) for e in root.iter("creator") if said(e)))[:20]
    return {"title": said(next(root.iter("title"), None)), "author": ", ".join(authors), "language": said(next(root.iter("language"), None)).lower(), "blocks": blocks, "sections": sections, "toc": even_depths(toc), "error": "" if blocks else "empty"}


def target(href: str, base: str, anchors: dict) -> int | None:
    path, _, fragment = href.partition("#")
    name = normpath(join(dirname(base), unquote(path))) if path else base
    return anchors.get((name, unquote(fragment)), anchors.get((name, "")))


def declared_nav(data: bytes, base: str, anchors: dict) -> list[tuple]:
    out: list[tuple] = []

    def walk(e: ElementTree.Element, d: int) -> None:
        for c in e:
            if c.tag == "a" and c.get("href"):
                b = target(c.get("href"), base, anchors)
                if b is not None and said(c):
                    out.append((said(c), d - 1, b))
            else:
                walk(c, d + (c.tag == "ol"))

    walk(xml(data), 0)
    return out


def declared_ncx(data: bytes, base: str, anchors: dict) -> list[tuple]:
    out: list[tuple] = []

    def walk(e: ElementTree.Element, d: int) -> None:
        for p in e:
            if p.tag == "navpoint":
                content = next((c for c in p if c.tag == "content"), None)
                label = said(next((c for c in p if c.tag == "navlabel"), None))
                b = target(content.get("src", ""), base, anchors) if content is not None else None
                if b is not None and label:
                    out.append((label, d, b))
                walk(p, d + 1)
            elif p.tag == "navmap":
                walk(p, d)

    walk(xml(data), 0)
    return out


def even_depths(toc: list[tuple]) -> list[tuple]:
    """Depths from 0, each at most one below the entry before; an entry that repeats the one before goes."""
    out, open_ = [], []
    for t, d, b in toc:
        if out and (out[-1][0], out[-1][2]) == (t, b):
            continue
        open_ = [x for x in open_ if x < d]
        out.append((t, len(open_), b))
        open_.append(d)
    return out


def fb2(data: bytes) -> dict:
    if data[:4] == b"PK\x03\x04":
        members = zip_members(data)
        name = next((n for n in members if n.lower().endswith(".fb2")), None) or max(members, key=lambda n: len(members[n]), default=None)
        if name is None:
            return {"error": "missing"}
        data = members[name]
    root = xml(data)
    info = next(root.iter("title-info"), root)
    author = next(info.iter("author"), None)
    names = [said(e) for part in ("first-name", "middle-name", "last-name") for e in (author.iter(part) if author is not None else ())]
    blocks: list[dict] = []
    sections: list[int] = []
    toc: list[tuple] = []

    def walk(e: ElementTree.Element, d: int) -> None:
        for c in e:
            if c.tag == "section":
                if d == 0:
                    sections.append(len(blocks))
                walk(c, d + 1)
            elif c.tag == "title":
                t = " ".join(filter(None, (said(p) for p in c)))
                if t:
                    toc.append((t, max(d - 1, 0), len(blocks)))
                    blocks.append({"k": "h", "l": min(max(d, 1), 6), "t": t})
            elif c.tag in ("p", "v", "subtitle", "text-author"):
                if said(c):
                    blocks.append({"k": "p", "t": said(c).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")})
            elif c.tag in ("poem", "stanza", "cite", "epigraph"):
                walk(c, d)

    for body in root.iter("body"):
        walk(body, 0)
    return {"title": said(next(info.iter("book-title"), None)), "author": " ".join(filter(None, names)), "language": said(next(info.iter("lang"), None)).lower(), "blocks": blocks, "sections": sections or [0], "toc": even_depths(toc), "error": "" if blocks else "empty"}


def natural(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() and p.isascii() else (1, 0, p.casefold()) for p in re.findall(r"\d+|\D+", name)]


def comic(data: bytes) -> dict:
    pages = sorted((n for n in zip_members(data) if n.lower().endswith(PICTURES) and not any(p.startswith((".", "__MACOSX")) for p in n.split("/"))), key=lambda n: [natural(p) for p in n.split("/")])
    blocks = [{"k": "img", "t": n} for n in pages]
    toc = [(f"Page {i + 1}", 0, i) for i in range(0, len(pages), 10)]
    return {"title": "", "author": "", "language": "", "blocks": blocks, "sections": [0] if blocks else [], "toc": toc, "error": "" if blocks else "empty"}


CHAPTER = re.compile(r"^\s*(chapter|part|book|chapitre|partie|livre|kapitel|teil|buch|capítulo|parte|libro)\s+(\d+|[ivxlcdm]+)\b|^#{1,6} ", re.I)


def plain(data: bytes) -> dict:
    """Paragraphs of a text: at blank lines, or one a line where there are none; chapter lines are headings."""
    text = decode_bytes(data)[0].replace("\r\n", "\n").replace("\r", "\n").expandtabs(4)
    parts = re.split(r"\n[ \f]*\n", text) if re.search(r"\n[ \f]*\n", text.strip()) else text.split("\n")
    blocks = []
    for p in parts:
        line = " ".join(p.split())
        if line:
            head = CHAPTER.match(line) and len(line) < 120
            blocks.append({"k": "h" if head else "p", "l": 1 if head else None, "t": (line.lstrip("# ") if head else line).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")})
    toc = [(b["t"], 0, i) for i, b in enumerate(blocks) if b["k"] == "h"]
    return {"title": "", "author": "", "language": "", "blocks": blocks, "sections": [0] if blocks else [], "toc": toc, "error": "" if blocks else "empty"}


def page(data: bytes) -> dict:
    text = decode_bytes(data)[0]
    blocks = blocks_of(text)
    title = re.search(r"<title[^>]*>(.*?)</title>", text, re.S | re.I)
    lang = re.search(r"<html[^>]*\blang=[\"']?([\w-]+)", text, re.I)
    return {"title": " ".join(title[1].split()) if title else "", "author": "", "language": lang[1].lower() if lang else "", "blocks": blocks, "sections": [0] if blocks else [], "toc": [(b["t"], (b["l"] or 1) - 1, i) for i, b in enumerate(blocks) if b["k"] == "h"], "error": "" if blocks else "empty"}


def palm(data: bytes) -> dict:
    """Kindle books of the older kind: records of stored, LZ77 or Huffman-coded text, pages cut at page breaks."""
    count = struct.unpack(">H", data[76:78])[0]
    at = [struct.unpack(">I", data[78 + 8 * i : 82 + 8 * i])[0] for i in range(count)] + [len(data)]
    first = data[at[0] : at[1]]
    method, _, length, records, _, locked = struct.unpack(">HHIHHH", first[:14])
    if locked:
        return {"error": "protected"}
    if method not in (STORED, LZ77, HUFFMAN):
        return {"error": "unsupported"}
    unpack = {STORED: bytes, LZ77: lz77}.get(method)
    if method == HUFFMAN:
        codes, n = struct.unpack(">II", first[112:120])
        unpack = Phrases([data[at[i] : at[i + 1]] for i in range(codes, min(codes + n, count))]).text
    flags = struct.unpack(">H", first[242:244])[0] if len(first) >= 244 and first[16:20] == b"MOBI" else 0
    body = b"".join(unpack(trimmed(data[at[i] : at[i + 1]], flags)) for i in range(1, min(records, count - 1) + 1))[:length]
    out = page(body.replace(b"<mbp:pagebreak/>", b"<hr>"))
    out["title"] = out["title"] or data[:32].split(b"\0")[0].decode("latin-1").replace("_", " ")
    return out


def trimmed(record: bytes, flags: int) -> bytes:
    """A record without the entries at its end that the header's flags announce."""
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            size = 0
            for k, b in enumerate(reversed(record[-4:])):
                size |= (b & 0x7F) << (7 * k)
                if b & 0x80:
                    break
            record = record[: len(record) - size]
    if flags & 1 and record:
        record = record[: len(record) - (record[-1] & 3) - 1]
    return record


def lz77(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            for _ in range((pair & 7) + 3):
                if pair >> 3 == 0 or pair >> 3 > len(out):
                    break
                out.append(out[-(pair >> 3)])
    return bytes(out)


class Phrases:
    """Huffman-coded text: a record of code tables, then records of phrases, which may be coded themselves."""

    MOST, DEEPEST = 32 << 20, 32

    def __init__(self, records: list[bytes]):
        tables, *books = records
        if tables[:4] != b"HUFF" or any(b[:4] != b"CDIC" for b in books):
            raise ValueError("no code tables")
        by_byte, by_length = struct.unpack(">II", tables[8:16])
        self.short = [(v & 31, bool(v & 128), v >> 8) for v in struct.unpack(">256I", tables[by_byte : by_byte + 1024])]
        limits = struct.unpack(">64I", tables[by_length : by_length + 256])
        self.lowest, self.highest = (0, *limits[::2]), (0, *limits[1::2])  # by code length
        self.phrases: list[bytes] = []
        self.plain: list[bool] = []
        for b in books:
            total, bits = struct.unpack(">II", b[8:16])
            n = min(1 << min(bits, 16), total - len(self.phrases))
            for at in struct.unpack(f">{n}H", b[16 : 16 + 2 * n]):
                size = struct.unpack(">H", b[16 + at : 18 + at])[0]
                self.phrases.append(b[18 + at : 18 + at + (size & 0x7FFF)])
                self.plain.append(bool(size & 0x8000))

    def text(self, data: bytes, depth: int = 0) -> bytes:
        if depth > self.DEEPEST:
            raise ValueError("phrases within phrases without end")
        bits, left, at, out = int.from_bytes(data + bytes(8), "big"), 8 * len(data), 0, bytearray()
        width = left + 64
        while at < left:
            code = bits >> (width - at - 32) & 0xFFFFFFFF
            size, done, high = self.short[code >> 24]
            if not done:
                while code >> (32 - size) < self.lowest[size]:
                    size += 1
                high = self.highest[size]
            if not size or at + size > left:
                break
            out += self.phrase(high - (code >> (32 - size)), depth)
            at += size
            if len(out) > self.MOST:
                raise ValueError("text too long")
        return bytes(out)

    def phrase(self, i: int, depth: int) -> bytes:
        if not self.plain[i]:  # decoded once, kept plain from then on
            self.phrases[i], self.plain[i] = self.text(self.phrases[i], depth + 1), True
        return self.phrases[i]


READERS: dict[str, Callable[[bytes], dict]] = {"epub": epub, "fb2": fb2, "comic": comic, "text": plain, "html": page, "kindle": palm}
BOOK = "path string, kind string, title string, author string, language string, error string, sections array<int>, toc array<struct<t:string,d:int,b:int>>, blocks array<struct<k:string,l:int,t:string,m:string,rows:array<array<string>>,hdr:int,q:int>>"


def book(kind: str | None, data: bytes) -> dict:
    if kind == "zip":
        kind = zip_kind(list(zip_members(data)))
    if kind not in READERS:
        return {"kind": kind, "error": "unsupported"}
    try:
        return {"kind": kind} | READERS[kind](data)
    except Exception:  # noqa: BLE001  a file that a reader cannot take is a row, not a failed job
        return {"kind": kind, "error": "corrupt"}


def books(files: DataFrame) -> DataFrame:
    """files (path, content) to one row each: kind by content, then name; metadata, contents, sections and blocks, or an error code."""
    named = files.select("path", "content", F.coalesce(kind_by_magic(F.col("content")), kind_by_name(F.col("path"))).alias("kind"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data, kind in zip(part["path"], part["content"], part["kind"], strict=True):
                x = book(kind, bytes(data) if data is not None else b"")
                blocks = [{n: b.get(n) for n in ("k", "l", "t", "m", "rows", "hdr", "q")} for b in x.get("blocks") or []]
                rows.append((path, x["kind"], x.get("title"), x.get("author"), x.get("language"), x.get("error") or None, x.get("sections") or [], [{"t": t, "d": d, "b": b} for t, d, b in x.get("toc") or []], blocks))
            yield pd.DataFrame(rows, columns=["path", "kind", "title", "author", "language", "error", "sections", "toc", "blocks"])

    return named.mapInPandas(run, BOOK)


def picture(data: bytes) -> tuple[str, int, int, bool] | None:
    """(kind, width, height, may be transparent) from a picture's first bytes."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, _, colour = struct.unpack(">IIBB", data[16:26])
            return "png", w, h, colour in (4, 6) or b"tRNS" in data[:4096]
        if data[:3] == b"GIF":
            return "gif", *struct.unpack("<HH", data[6:10]), b"\x21\xf9\x04\x01" in data[:4096]
        if data[:2] == b"BM":
            return "bmp", *struct.unpack("<II", data[18:26]), False
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), bool(data[20] & 16)
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), bool(bits >> 28 & 1)
            return "webp", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30])), False
        if data[:2] == b"\xff\xd8":
            i = 2
            while i < len(data) - 9:
                if data[i] != 0xFF:
                    i += 1
                elif 0xC0 <= data[i + 1] <= 0xCF and data[i + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                    return "jpeg", w, h, False
                else:
                    i += 2 + (struct.unpack(">H", data[i + 2 : i + 4])[0] if data[i + 1] not in (0xFF, 0x01) and not 0xD0 <= data[i + 1] <= 0xD9 else 0)
        head = data[:2048].decode("utf-8", "replace")
        if "<svg" in head:
            w, h = (re.search(rf'\b{n}="([\d.]+)', head) for n in ("width", "height"))
            return "svg", int(float(w[1])) if w else 0, int(float(h[1])) if h else 0, True
    except (struct.error, IndexError, ValueError):
        pass
    return None


@F.pandas_udf(Y.StructType().add("kind", Y.StringType()).add("width", Y.IntegerType()).add("height", Y.IntegerType()).add("alpha", Y.BooleanType()))
def sniff_picture(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([picture(bytes(x)) or (None,) * 4 if x is not None else (None,) * 4 for x in data], columns=["kind", "width", "height", "alpha"]).astype({"width": "Int32", "height": "Int32"})
