"""Web pages to blocks: a tolerant parser as a table function, and what plain expressions can take from markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "b int, k string, l int, t string, m string, rows array<array<string>>, hdr int, q int, id string, href array<string>"
HIDDEN = {"script", "style", "head", "template", "noscript", "svg", "iframe", "object", "select", "button"}
BREAKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "dl", "dd", "dt", "figure", "figcaption", "address", "form", "fieldset", "center", "body", "html"}
INLINE = {"b": "b", "strong": "b", "i": "i", "em": "i", "cite": "i", "u": "u", "ins": "u", "s": "s", "del": "s", "strike": "s"}
MOST_DEPTH, MOST_BLOCKS = 256, 100_000


def escape(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class _Reader(HTMLParser):
    """Turns events into blocks; never raises on any input."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.open: list[str] = []
        self.hidden = 0
        self.kind, self.level = "p", None
        self.lists: list[list] = []
        self.marker: str | None = None
        self.quotes = 0
        self.table: list[list[str]] | None = None
        self.header_rows = 0
        self.header = True
        self.cell: list[str] | None = None
        self.ids: str | None = None
        self.hrefs: list[str] = []
        self.title: list[str] | None = None

    def flush(self) -> None:
        raw = "".join(self.text)
        for tag in reversed(self.open):
            raw += f"</{tag}>"
        keep = raw if self.kind == "pre" else re.sub(r"[ \t\n\r\f\x0b]+", " ", raw).strip(" ")
        if re.sub(r"<[^>]*>|[\s  ­]", "", keep) and len(self.out) < MOST_BLOCKS:
            k = "li" if self.marker is not None and self.kind == "p" else self.kind
            self.out.append({"k": k, "l": self.level, "t": keep.strip("\n") if k == "pre" else keep, "m": self.marker if k == "li" else None, "q": 1 if self.quotes else None, "id": self.ids, "href": self.hrefs or None})
            self.marker = "" if k == "li" else self.marker
            self.ids = None
        self.hrefs = []
        self.text = [f"<{t}>" for t in self.open]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs[:64])
        if self.hidden or tag in HIDDEN:
            self.hidden += tag in HIDDEN
            return
        if a.get("id") or (tag == "a" and a.get("name")):
            self.ids = self.ids or a.get("id") or a.get("name")
        if self.cell is not None:
            if tag in ("td", "th", "tr"):
                self.end_cell()
            else:
                if tag == "br":
                    self.cell.append("<br>")
                return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.kind, self.level = "h", int(tag[1])
        elif tag == "pre":
            self.flush()
            self.kind = "pre"
        elif tag == "br":
            self.text.append("\n" if self.kind == "pre" else "<br>")
        elif tag == "hr":
            self.flush()
            self.out.append({"k": "hr"})
        elif tag == "img":
            if a.get("alt") and a["alt"].strip():
                self.flush()
                self.out.append({"k": "img", "t": a["alt"].strip()})
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
            self.marker = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "•"
        elif tag == "blockquote":
            self.flush()
            self.quotes += 1
        elif tag == "table":
            self.flush()
            self.table, self.header_rows, self.header = [], 0, True
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table is not None:
            if not self.table:
                self.table.append([])
            self.cell = []
            if tag == "td":
                self.header = False
            elif self.header and not self.table[-1]:
                self.header_rows = len(self.table)
        elif tag in BREAKS:
            self.flush()
            if tag in ("ul", "ol") and len(self.lists) < MOST_DEPTH:
                self.lists.append([tag, 0])
        elif tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
        elif tag in INLINE and INLINE[tag] not in self.open:
            self.open.append(INLINE[tag])
            self.text.append(f"<{INLINE[tag]}>")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.hidden:
            return
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "table" and self.table is not None:
            self.end_cell()
            rows = [r for r in self.table if any(r)]
            if rows:
                self.out.append({"k": "tbl", "rows": rows, "hdr": min(self.header_rows, len(rows))})
            self.table = None
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "pre"):
            self.flush()
            self.kind, self.level = "p", None
        elif tag == "li":
            self.flush()
            self.marker = None
        elif tag == "blockquote":
            self.flush()
            self.quotes = max(0, self.quotes - 1)
        elif tag in BREAKS:
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.marker = None
        elif tag in INLINE and INLINE[tag] in self.open:
            while self.open:
                last = self.open.pop()
                self.text.append(f"</{last}>")
                if last == INLINE[tag]:
                    break

    def end_cell(self) -> None:
        if self.cell is not None and self.table:
            self.table[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
        self.cell = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        (self.cell if self.cell is not None else self.text).append(escape(data))


def blocks_of(markup: str | None) -> list[dict]:
    r = _Reader()
    if markup:
        r.feed(markup.replace("\0", ""))
        r.close()
        if r.table is not None:
            r.handle_endtag("table")
        r.flush()
    return [x for x in r.out if "<" not in (x.get("t") or "") or re.sub(r"<[^>]*>", "", x["t"]).strip()]


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the blocks of each page, in order; map-only. A null page has none."""
    names = ["k", "l", "t", "m", "rows", "hdr", "q", "id", "href"]

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for part in parts:
            rows = [(key_, b, *(x.get(n) for n in names)) for key_, h in zip(part["key"], part["html"], strict=True) for b, x in enumerate(blocks_of(h))]
            out = pd.DataFrame(rows, columns=["key", "b", *names])
            for n in ("l", "hdr", "q"):
                out[n] = out[n].astype("Int32")
            yield out

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key long, {BLOCKS}".replace("k string, l int, t string, m string", "k string, l int, t string, m string"))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def hidden_out(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(hidden_out(html), r"<[^>]*>", " "), r"[ \t\n\r\f\x0b]+", " "))


def links(html: Column) -> Column:
    """All targets of anchors, in order."""
    return F.regexp_extract_all(hidden_out(html), F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def unescaped(t: str) -> str:
    return unescape(t)


#: Markup that a block may carry.
SAFE = r"^(</?[bius]>|<br>|</a>|<a href=\"[^\"<>]*\">)$"


def contract_faults(blocks: DataFrame) -> DataFrame:
    """Blocks that break a rule of the block table, with the rule's name; an empty result is a pass."""
    tags = F.regexp_extract_all("t", F.lit("<[^>]*>?"), F.lit(0))
    unsafe = F.col("t").isNotNull() & (F.col("k") != "pre") & ~F.forall(tags, lambda x: x.rlike(SAFE))
    rules = [
        ("kind", ~F.col("k").isin("p", "h", "li", "pre", "img", "tbl", "hr")),
        ("text", F.col("k").isin("p", "h", "li", "pre") & (F.coalesce(F.trim("t"), F.lit("")) == "")),
        ("level", (F.col("k") == "h") & ~F.coalesce(F.col("l").between(1, 6), F.lit(False))),
        ("rows", (F.col("k") == "tbl") & (F.coalesce(F.size("rows"), F.lit(0)) < 1)),
        ("markup", unsafe),
    ]
    fault = F.coalesce(*(F.when(test, name) for name, test in rules))
    return blocks.select("key", "b", fault.alias("fault")).where("fault is not null")
