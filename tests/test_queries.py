"""Queries of the library proper against DuckDB at sf0.001, and operators on literal fixtures."""

import io
import os
import re
import struct
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import reading as R
from quire.functions import text as T
from quire.operators import catalog as C
from quire.operators import contents as N
from quire.operators import order as O
from quire.operators import sequence as S
from quire.plans.queries import ORACLE_SQL, QUERIES
from quire.sources import files as B
from quire.streaming import places as P

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, D)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert norm(map(tuple, got.collect()), got.columns) == norm(want.fetchall(), names)


def test_depths_and_budget(spark):
    e = spark.createDataFrame([(1, i, d) for i, d in enumerate([2, 3, 3, 1, 5, 2])], "key long, ord long, d int")
    assert S.fold_depths(e).first()["depths"] == [0, 1, 1, 0, 1, 1]
    x = spark.createDataFrame([(1, i, n) for i, n in enumerate([50, 60, 30, 20])], "key long, ord long, size long")
    assert [r["ord"] for r in S.within_budget(x, 3, 55, 100).orderBy("ord").collect()] == [0, 2, 3]


def test_labels_open_at_deeper_entries(spark):
    rows = [(1, 0, 0, None), (1, 1, 1, None), (1, 2, 2, 7), (1, 3, 1, None), (1, 4, 1, 9), (1, 5, 3, None)]
    got = N.labels_open(spark.createDataFrame(rows, "key long, ord long, d int, b long")).orderBy("ord").collect()
    assert [r["b"] for r in got] == [7, 7, 7, None, 9, None]


def test_mark_is_the_plain_loop(spark):
    def slow(t):
        if t == "" or re.fullmatch("#[0-9a-f]{14}", t):
            return t
        m, a, b = 2**32 - 1, 0xDEADBEEF, 0x41C6CE57
        raw = t.encode("utf-16-le")
        for c in struct.unpack(f"<{len(raw) // 2}H", raw):
            a, b = (a ^ c) * 2654435761 & m, (b ^ c) * 1597334677 & m
        a = ((a ^ a >> 16) * 2246822507 ^ (b ^ b >> 13) * 3266489909) & m
        b = ((b ^ b >> 16) * 2246822507 ^ (a ^ a >> 13) * 3266489909) & m
        return f"#{b & 0xFFFFFF:06x}{a:08x}"

    texts = ["", "a", "Call me Ishmael", "\U0001f600 x", "é" * 48, "#0123456789abcd", "#0123456789abcde"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.mark("t").alias("m")).collect()
    assert {r["t"]: r["m"] for r in got} == {t: slow(t) for t in texts}


def test_copied_text(spark):
    one = "a\u00a0b\u00ad \n\n\n\nc\u2028d "
    long = "x" * 30 + "\n\n" + "é" * 30
    got = spark.createDataFrame([(one,), (long,), ("é" * 60,), ("€" * 40,), ("\U0001f600" * 30,)], "t string").select(R.clipped(F.col("t"), 50).alias("t")).collect()
    assert [r["t"] for r in got] == ["a b\n\nc\nd", "x" * 30, "é" * 25, "€" * 16, "\U0001f600" * 12]


def test_running_sums_over_ranges(spark):
    x = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id")).repartition(5)
    got = O.running(x, [F.col("id")], F.col("id")).orderBy("id").collect()
    assert [(r["pos"], r["before"], r["whole"]) for r in got] == [(i + 1, i * (i - 1) // 2, 499500) for i in range(1000)]
    assert O.running(x.where("id < 0"), [F.col("id")], F.col("id")).isEmpty()


def test_recency_of_equal_and_missing_titles(spark, tmp_path):
    """Books with the same title and path go by key; missing titles and paths come last, as in the SQL."""
    same = spark.createDataFrame([(k, "p", "The T") for k in range(60, 0, -1)], "key long, path string, title string").coalesce(1)
    never = spark.createDataFrame([], "key long, t long")
    assert all(r["pos"] == r["key"] for r in C.recency(same, never).collect())
    rows = [(1, None, "<title>b</title>"), (2, "u", None), (3, "v", "<title></title>"), (4, "u", "<title>B</title>"), (5, "u", "<title>The İb</title>"), (6, "w", "<title>ib</title>"), (7, "t", "<title>iz</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.read.parquet(f"{D}/events.parquet").where("user_id = 3").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for name in ("pages", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["library_recency"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["library_recency"](spark, str(tmp_path)).select("key", "t", "pos").collect()) == sorted(want)


def test_reach_along_chains_and_branches(spark, monkeypatch):
    """A chain of 300 places takes the logarithm of its length in tables; hops are the least, whatever jumps found first."""
    tables, write = [], O.written
    monkeypatch.setattr(O, "written", lambda df: tables.append(1) or write(df))
    edges = [(i, i + 1) for i in range(300)] + [(5, 290), (300, 3), (300, None), (40, 1000), (1000, 1001), (1001, 299), (77, 77), (2000, 2001)]
    got = {r["id"]: r["hops"] for r in O.reachable(spark.range(1), spark.createDataFrame(edges, "a long, b long")).collect()}
    want, new = {0: 0}, [0]
    while new:
        new = list({b: want[a] + 1 for a in new for x, b in edges if x == a and b not in want}.items())
        want.update(new)
        new = [b for b, _ in new]
    assert got == want and len(want) == 304
    assert len(tables) < 50


def test_raised_and_visible(spark):
    got = spark.createDataFrame([("12+n",), ("1a",), (" \u00a0\u00ad",), ("",)], "t string").select(R.raised(F.col("t")).alias("r"), R.visible(F.col("t")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("¹²⁺ⁿ", True), (None, True), (None, False), (None, False)]


def test_contract_holds(spark):
    assert QUERIES["block_contract"](spark, D).isEmpty()


@pytest.mark.parametrize(
    ("markup", "kinds"),
    [
        ("<h2>T</h2><p>a<p>b<hr><ul><li>x<li>y</ul>", ["h", "p", "p", "hr", "li", "li"]),
        ("<script>var a='</p>'</script><style>p{}</style>plain", ["p"]),
        ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", ["tbl"]),
        ("<pre>a\n b</pre><blockquote>q</blockquote>", ["pre", "p"]),
        ("", []),
        ("<p>" * 2000 + "<b><i>x", ["p"]),
    ],
)
def test_html(markup, kinds):
    assert [b["k"] for b in H.blocks_of(markup)] == kinds


def test_decode():
    for text, name in (("Привет, это русский текст о книгах", "cp1251"), ("東京は日本の首都です。ひらがなとカタカナ", "shift_jis"), ("déjà vu à l'été", "cp1252")):
        assert T.decode_bytes(text.encode(name))[0] == text
    assert T.decode_bytes("﻿a".encode("utf-16-le")) == ("a", "utf-16-le")


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


EPUB = {
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
    "O/p.opf": '<package xmlns:dc="x"><metadata><dc:title>T</dc:title><dc:creator>A B</dc:creator><dc:language>EN</dc:language></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="n" href="n.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
    "O/a.xhtml": "<h1>One</h1><p>alpha</p>", "O/b.xhtml": '<h1>Two</h1><p id="x">beta</p>',
    "O/n.ncx": '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>In</text></navLabel><content src="b.xhtml#x"/></navPoint></navPoint></navMap></ncx>',
}


def test_books(spark):
    whole = archive(EPUB)
    fb = b"<FictionBook><description><title-info><book-title>F</book-title><author><first-name>X</first-name><last-name>Y</last-name></author></title-info></description><body><section><title><p>C</p></title><p>text</p></section></body></FictionBook>"
    rows = [("a.epub", whole), ("cut.epub", whole[:-60]), ("b.fb2", fb), ("c.cbz", archive({"2.jpg": "", "10.jpg": "", "1.jpg": ""})), ("d.txt", b"Chapter 1\n\nHello\nthere\n\nBye"), ("e.mobi", b"junk"), ("f.pdf", b"%PDF-1.4"), ("g.txt", None)]
    got = {r["path"]: r for r in B.books(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["a.epub"]["title"], got["a.epub"]["author"], got["a.epub"]["language"]) == ("T", "A B", "en")
    assert [tuple(t) for t in got["a.epub"]["toc"]] == [("One", 0, 0), ("In", 1, 3)]
    assert len(got["cut.epub"]["blocks"]) == 4 and got["a.epub"]["sections"] == [0, 2]
    assert (got["b.fb2"]["title"], got["b.fb2"]["author"], [b["k"] for b in got["b.fb2"]["blocks"]]) == ("F", "X Y", ["h", "p"])
    assert [b["t"] for b in got["c.cbz"]["blocks"]] == ["1.jpg", "2.jpg", "10.jpg"]
    assert [b["k"] for b in got["d.txt"]["blocks"]] == ["h", "p", "p"]
    assert [got[n]["error"] for n in ("e.mobi", "f.pdf", "g.txt")] == ["corrupt", "unsupported", "empty"]


def test_huffman_text():
    tables = b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + bytes(8) + struct.pack(">256I", *[8 | 128 | 255 << 8] * 256) + bytes(256)
    phrases = [(bytes([255 - i]), 0x8000) for i in range(256)]
    phrases[255 - 1] = (b"on", 0)  # byte 1: a phrase that is coded itself
    phrases[255 - 2] = (b"\x01\x01", 0)
    data, at = b"", []
    for p, plain in phrases:
        at.append(512 + len(data))
        data += struct.pack(">H", len(p) | plain) + p
    book = b"CDIC" + struct.pack(">III", 16, 256, 8) + struct.pack(">256H", *at) + data
    assert B.Phrases([tables, book]).text(b"<p>\x01\x02 and \x01") == b"<p>ononon and on"
    packed = b"<p>one</p><p>tw\x01</p>"
    first = struct.pack(">HHIHHH", B.HUFFMAN, 0, len(packed) + 1, 1, 4096, 0) + bytes(2) + b"MOBI" + bytes(92) + struct.pack(">II", 2, 2) + bytes(130)
    records = [first, packed, tables, book]
    start = 78 + 8 * len(records)
    spots = [start + sum(map(len, records[:i])) for i in range(len(records))]
    mobi = b"Name_of_it".ljust(60, b"\0") + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records)) + b"".join(struct.pack(">II", s, 0) for s in spots) + b"".join(records)
    got = B.book("kindle", mobi)
    assert (got["title"], [b["t"] for b in got["blocks"]], got["error"]) == ("Name of it", ["one", "twon"], "")
    phrases = struct.pack(">H", 1) + b"\x01"  # a phrase that holds itself
    endless = b"CDIC" + struct.pack(">III", 16, 256, 8) + struct.pack(">256H", *[512] * 256) + phrases
    assert B.book("kindle", mobi.replace(book, endless + bytes(len(book) - len(endless))))["error"] == "corrupt"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{D}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = P.latest(P.stream(spark, str(tmp_path / "in"), src.schema)).writeStream.outputMode("complete").format("memory").queryName("places").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = P.latest(src.withColumn("ts", src["ts"].cast("timestamp")))
    assert sorted(spark.table("places").collect()) == sorted(want.collect())


def test_names(spark):
    x = spark.createDataFrame([("Doe, Jane",), ("One",), ("a, b, c",)], "t string").select(C.natural_name(T.F.col("t")).alias("t")).collect()
    assert [r.t for r in x] == ["Jane Doe", "One", "a, b, c"]


def test_discover(spark, tmp_path):
    """Known files below the roots, once each: no dot names, no sidecars, at most eight folders deep from the nearest root."""
    from quire.sources.files import discover

    deep = tmp_path.joinpath(*"abcdefgh")
    deeper = deep / "i"
    for folder in (tmp_path, deep, deeper, tmp_path / ".hid", tmp_path / "x.sdr"):
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "book.txt").write_text("text")
    (tmp_path / "a" / "list.csv").write_text("1")
    found = lambda *roots: {r.path.removeprefix(f"file:{tmp_path}/") for r in discover(spark, [str(r) for r in roots]).select("path").collect()}
    assert found(tmp_path) == {"book.txt", "a/b/c/d/e/f/g/h/book.txt"}
    assert found(tmp_path, tmp_path / "a", tmp_path) == {"book.txt", "a/b/c/d/e/f/g/h/book.txt", "a/b/c/d/e/f/g/h/i/book.txt"}


def test_sharp_s_in_titles(spark):
    """remembered_places against its SQL on the table where titles have letters of two capitals."""
    import duckdb

    from quire.plans import queries as R

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    for name in ("remembered_places", "superseded_places"):
        got = R.QUERIES[name](spark, d)
        want = con.execute(R.ORACLE_SQL[name]).fetchall()
        columns = [c[0] for c in con.description]
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))
