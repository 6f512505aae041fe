"""Headings, titles, links and cutting of blocks on literal lines, and pieces of texts by their properties."""

import re

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import split as X
from quire.functions import text as E
from quire.functions import titles as T
from quire.operators import blocks as K
from quire.operators import contents as N
from quire.plans.queries import ORACLE_SQL, QUERIES


def told(spark, texts, of):
    rows = [(i, t) for i, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "i int, t string").select("i", of(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(found)]


def test_heading_kinds(spark):
    kinds = {
        "Chapter 3": "numbered", "CHAPTER XIV. The Storm": "numbered", "[Livre deuxième]": "numbered", "Глава 5": "numbered", "Part mmmmm": None, "Chapter one-horse": "numbered",
        "Chapter 12345": None, "Part twenty-one": "numbered", "Hoofdstuk iv:": "numbered", "chapter": None, "Chapter i’m": None, "Table of Contents": "named", "Appendix B.": "named",
        "ПРОЛОГ": "named", "第十二章 起点": "ideographic", "XIV.": "number", "1234": None, "12": "number", "": None, "IIII": None, "# A": "markdown", "#A": None, "====": "underline",
        "---": "underline", "* * *": "rule", "*": "rule", "plain words": None, "a\n---": None,
    }
    assert dict(zip(kinds, told(spark, kinds, T.heading_kind), strict=True)) == kinds


def test_lines_and_titles(spark):
    lines = ["THE STORM", "THE END", "Ab", "IT WAS.", "1984", "2 MEN AND", None]
    assert told(spark, lines, T.caps_heading) == [True, False, False, False, False, True, None]
    assert told(spark, ["so,", "It ended.", "CHAPTER I.", "Part 2.", "Why?", "", "É."], T.ends_like_prose) == [True, True, False, False, False, False, False]
    assert told(spark, ["T H E E N D", "T H E", "T H E e N D", "T H E E N D 1 2", "T  H E E N D", "T H E E N D 1"], T.spaced_capitals) == [True, False, False, False, False, True]
    assert told(spark, ["Title Page", "MyBook-v3_07-12", "My Book 2.1", "Cover", "x.1", ""], T.is_title) == [False, False, True, False, False, False]
    assert told(spark, ["image 12", "a cat", "cat.JPEG", "Figure-2", "", "art deco"], T.meaningful) == [False, True, False, False, False, True]
    assert told(spark, ["https://a/­b", "http:// /", "ftp://a", "MAILTO:x", "http:" + "x" * 3000, None], T.external) == ["https://a/b", "", None, "MAILTO:x", None, None]
    assert told(spark, [' a "b"\x01<c>　d ', "a&b"], T.safe_href) == ["a%20%22b%22%3Cc%3E%E3%80%80d", "a&b"]
    assert told(spark, ["it's a day", "l’an\xadnée", None, "ünder_x 1st"], T.capitalised) == ["It's A Day", "L’an\xadnée", None, "Ünder_x 1st"]


def test_links_to_blocks(spark):
    text = '<a href="\x1f0\x1f">a</a> <a href="\x1f1\x1f"><i>b</i></a> <a href="\x1f9\x1f">c</a> <a href="http:x">d</a>'
    rows = [(0, text, [7, None]), (1, None, [1]), (2, text, None)]
    got = spark.createDataFrame(rows, "i int, t string, to array<long>").select("i", T.relinked("t", "to").alias("x")).orderBy("i").collect()
    rest = '<i>b</i> c <a href="http:x">d</a>'
    assert [r["x"] for r in got] == ['<a href="b:7">a</a> ' + rest, None, "a " + rest]


words = st.lists(st.sampled_from(["ab", "c.", "d!”", "\n", "<br>", "&amp;", "<i>", "</i>", "x" * 30, "é"]), max_size=80)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(10, 60))
def test_pieces_keep_all_words_within_the_limit(found, limit):
    text = " ".join(w for w in found if w[0] != "<" and not w.startswith("&"))
    got = X.split_text(text, False, limit)
    assert len(text) <= limit or "".join("".join(t for t, _ in got).split()) == "".join(text.split())
    assert all(len(t) <= limit for t, _ in got)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(20, 60))
def test_pieces_with_markup_are_whole(found, limit):
    text, depth = "", 0
    for w in found:
        if w == "<i>" and depth or w == "</i>" and not depth:
            continue
        depth += (w == "<i>") - (w == "</i>")
        text += w + " "
    text += "</i>" * depth
    got = X.split_text(text, True, limit)
    said = lambda t, f: re.sub(r"\s", "", re.sub("<[^<>]*>", "", t).replace("&amp;", "&") if f else t)
    assert "".join(said(t, f) for t, f in got) == said(text, 1)
    assert all(t.count("<i>") == t.count("</i>") and "&am" not in t.replace("&amp;", "") for t, f in got if f)
    assert all(f or len(t) <= limit for t, f in got)
    assert all(len(t.replace("&amp;", "x")) <= limit + len("<i></i>") for t, f in got) or len(got) == 1


def test_where_pieces_end():
    assert X.split_text("aaaa bbbb. cccc dddd", False, 15) == [("aaaa bbbb.", 0), ("cccc dddd", 0)]  # a sentence before a later blank
    assert X.split_text("aaaaaa\nbbbb. cccc dddd", False, 15) == [("aaaaaa", 0), ("bbbb. cccc dddd", 0)]  # a line break before both
    assert X.split_text("a. bbbbbbbb cccccccc", False, 15) == [("a. bbbbbbbb", 0), ("cccccccc", 0)]  # too early a sentence
    assert X.split_text("x" * 25, False, 10) == [("x" * 10, 0), ("x" * 10, 0), ("x" * 5, 0)]
    assert X.split_text("<b>aaaa bbbb. cccc</b> dd", True, 16) == [("<b>aaaa bbbb.</b>", 1), ("<b>cccc</b> dd", 1)]
    assert "".join(t for t, _ in X.split_text("a b " + "&amp;" * 12, True, 10)).count("&") == 12
    assert X.split_pre("aaaa\n\nbbbb\ncccc", 10) == ["aaaa", "bbbb\ncccc"]
    assert X.split_pre("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and X.split_pre(" \n ", 10) == []


def test_long_blocks_are_numbered_anew(spark):
    rows = [(1, 0, "h", "T", 0, None), (1, 1, "li", "a. " * 900, 0, "1."), (1, 2, "img", None, None, None), (1, 3, "h", "w " * 1500, 0, None), (2, 0, "p", "x", 0, None)]
    got = K.cut_long(spark.createDataFrame(rows, "key int, b int, k string, t string, f int, m string")).orderBy("key", "b").collect()
    assert [(r["key"], r["b"], r["k"], r["m"], r["c"]) for r in got] == [(1, 0, "h", None, None), (1, 1, "li", "1.", None), (1, 2, "li", "", 1), (1, 3, "img", None, None), (1, 4, "p", None, None), (1, 5, "p", None, 1), (2, 0, "p", None, None)]


def test_found_contents_and_table_parts(spark):
    e = spark.createDataFrame([(1, 0, 0, "Book One"), (1, 1, 1, "The Storm"), (1, 2, 1, "A storm again"), (1, 3, 0, "Stormy")], "key int, ord long, d int, t string")
    assert [(r["ord"], r["path"]) for r in N.matching(e, "STORM").orderBy("ord").collect()] == [(1, "Book One"), (2, "Book One"), (3, "")]
    t = spark.createDataFrame([([[str(i)] for i in range(130)], 61), ([], 0)], "rows array<array<string>>, hdr int")
    got = [[(len(p["rows"]), p["hdr"]) for p in r["x"]] for r in t.select(X.row_parts(F.col("rows"), F.col("hdr")).alias("x")).collect()]
    assert got == [[(60, 60), (60, 1), (10, 0)], []]


def test_texts_become_objects_in_slices(spark, monkeypatch):
    """However large an Arrow batch, only about SLICE characters of it are Python objects before they are Arrow again; rows keep their order."""
    made, array = [], E.pa.array
    texts = ["it's " * 50, None, "", "y. " * 900] * 40
    monkeypatch.setattr(E, "SLICE", 3000)
    given = pa.array(texts), pa.array(["p"] * len(texts)), pa.array([0] * len(texts))
    want = [[{"t": t, "f": f} for t, f in X.split_text(x, False)] if x is not None else [] for x in texts]
    monkeypatch.setattr(E.pa, "array", lambda x, *kind: made.append(len(x)) or array(x, *kind))
    assert X.pieces.func(*given).to_pylist() == want
    assert T.capitalised.func(given[0]).to_pylist() == [x and x.replace("it", "It").replace("y", "Y") for x in texts]
    assert max(made) <= 8 and sum(made) == 2 * len(texts)
    assert T.capitalised.func(given[0][:0]).to_pylist() == []
    K.cut_long(spark.createDataFrame([], "key int, b int, k string, t string, f int, m string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{E.BATCH}b"


def test_letters_one_by_one(spark):
    """Capitals and small letters are those of the SQL, for every character and whatever stands beside it."""
    texts = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF] + ["Straße", "ΟΔΟΣ Ǆ", "THE ﬁN", "plain", "", None]
    want = duckdb.sql("SELECT upper(t), lower(t) FROM (SELECT unnest($1) AS t, generate_subscripts($1, 1) AS i) ORDER BY i", params=[texts]).fetchall()
    for start in range(0, len(texts), 300_000):
        part = texts[start : start + 300_000]
        assert list(zip(told(spark, part, E.upper), told(spark, part, E.lower), strict=True)) == want[start : start + 300_000]


def test_case_in_queries_is_that_of_the_sql(spark, tmp_path):
    """Letters whose capital the JVM writes as two, small raised letters, and an accented title word."""
    each = ["Chß Chß Chß Chß Chß Chß Chß Chß Chß Chß Chß", "ßa, b", "ŉ ǰ ΐ word", "ﬁn ﬁn", "Capítulo ii.", "THE ﬁNE", "PART 3ª.", "Ⅳ.", "CAPÍTULO ii.", "ΟΔΟΣ ẞ", "İSTANBUL", "Straße ᾳ ᾼ."]
    docs = [(i, "\n".join(each[(i + j) % len(each)] for j in range(len(each)))) for i in range(len(each))]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pages = [(i, f"http://a/{i}", f"<title>{t}</title>") for i, t in enumerate([*each, *map(str.lower, each), *each])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("heading_tests", "caps_lines", "shared_titles", "remembered_places"):
        want = con.execute(ORACLE_SQL[name]).fetchall()
        columns = [c[0] for c in con.description]
        assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(columns).collect()))) == sorted(map(str, want)), name
