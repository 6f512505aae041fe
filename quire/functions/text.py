"""Scalar functions on text: cleaning, decoding, sort keys, and tests of lines."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

# Characters that are dropped, and spaces that become a plain one.
DROPPED = "".join(map(chr, [*range(0, 9), 11, 12, *range(14, 32), 127, 0x200B, 0x2060, 0xFEFF]))
SPACES = "".join(map(chr, [*range(0x2000, 0x200B), 0x205F, 0x3000, 0x1680]))


def collapse_space(t: Column) -> Column:
    """Runs of ASCII white space as one blank; no-break spaces stay."""
    return F.trim(F.regexp_replace(t, "[ \t\n\r\f\x0b]+", " "))


def clean(t: Column) -> Column:
    """Without control and invisible characters, with exotic spaces as blanks."""
    return F.translate(t, SPACES + DROPPED, " " * len(SPACES))


#: Characters of texts that are Python objects at a time, and bytes of a batch where the session leaves Spark's default.
SLICE, BATCH = 1 << 20, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session with Arrow batches of BATCH bytes if it has Spark's default: the JVM and the worker each hold some."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH}b")
    return df


def sliced(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one(...) of each row, whose values are made Arrow again after SLICE characters of the first column, so a batch is never Python objects as a whole."""
    parts, held, size = [], [], 0
    for row in zip(*columns, strict=True):
        row = [x.as_py() for x in row]
        held.append(one(*row))
        size += len(row[0] or "")
        if size >= SLICE:
            parts.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*parts, pa.array(held, kind)])


@cache
def _pairs(capitals: bool) -> tuple[str, str]:
    """Letters with another form that is one character, and those forms."""
    whole = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    if capitals:
        forms = ["ẞ" if c == "ß" else next((f for f in (c.upper(), c.title()) if len(f) == 1), c) for c in whole]
    else:
        forms = [c.lower()[0] for c in whole]
    kept = [(c, f) for c, f in zip(whole, forms, strict=True) if c != f]
    return "".join(c for c, _ in kept), "".join(f for _, f in kept)


def upper(t: Column) -> Column:
    """Capitals letter by letter, as SQL has them: none becomes two, and a sharp s has its own. (The JVM makes SS of it.)"""
    return F.when(F.octet_length(t) == F.length(t), F.upper(t)).otherwise(F.translate(t, *_pairs(True)))


def lower(t: Column) -> Column:
    """Small letters one by one, whatever stands beside them."""
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, *_pairs(False)))


def caps_line(t: Column) -> Column:
    return (upper(t) == t) & (lower(t) != t)


def numbered_heading(t: Column) -> Column:
    """A line that says part or chapter and a number, in four languages."""
    return t.rlike(r"(?i)^\s*(chapter|part|book|chapitre|partie|livre|kapitel|teil|buch|capítulo|parte|libro)\s+([0-9]+|[ivxlcdm]+)\b")


def prose_end(t: Column) -> Column:
    return t.rlike(r"[.!?…][\"'”’»)\]]*$")


def letter_spaced(t: Column) -> Column:
    """Five upper-case letters or more with single blanks between."""
    return t.rlike(r"^\p{Lu}( \p{Lu}){4,}$")


@F.pandas_udf(Y.StringType())
def title_sort_key(t: pd.Series) -> pd.Series:
    """Compatibility-decomposed, case-folded, without accents, punctuation and a leading article."""

    def key(x: str | None) -> str | None:
        if x is None:
            return None
        flat = "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c))
        flat = " ".join(re.sub(r"[^\w\s]", " ", flat).split())
        return re.sub(r"^(the|an|a|der|die|das|le|la|les|el|los|las) (?=.)", "", flat)

    return t.map(key)


@F.pandas_udf(Y.ArrayType(Y.StructType().add("n", Y.LongType()).add("s", Y.StringType())))
def natural_key(t: pd.Series) -> pd.Series:
    """Digits by value, other text case-folded: page 2 before page 10."""

    def key(x: str | None) -> list | None:
        if x is None:
            return None
        parts = re.findall(r"\d+|\D+", x)
        return [{"n": int(p[:18]), "s": ""} if p.isdigit() and p.isascii() else {"n": None, "s": p.casefold()} for p in parts]

    return t.map(key)


#: Single-byte and multi-byte encodings tried in order, each with the letters that speak for it.
CANDIDATES = [
    ("cp1251", range(0x410, 0x450)), ("koi8-r", range(0x410, 0x450)), ("gb18030", range(0x4E00, 0x9FA6)), ("shift_jis", range(0x3040, 0x3100)),
    ("euc_kr", range(0xAC00, 0xD7A4)), ("cp1253", range(0x391, 0x3CA)), ("cp1250", range(0x100, 0x180)), ("cp1254", range(0xC0, 0x160)), ("cp1252", range(0xC0, 0x100)),
]


def decode_bytes(data: bytes, declared: str | None = None) -> tuple[str, str]:
    """(text, encoding): byte-order mark, declared encoding, UTF-8, then the legacy encoding that reads most as words."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    head = data[:4000]
    if len(head) >= 4:
        even, odd = head[::2].count(0), head[1::2].count(0)
        for zeros, name in ((odd, "utf-16-le"), (even, "utf-16-be")):
            if zeros > len(head) // 4:
                return data.decode(name, "replace"), name
    for name in (declared, "utf-8"):
        try:
            return data.decode(name), name
        except (LookupError, UnicodeDecodeError, TypeError):
            continue
    best = ("", "cp1252", float("-inf"))
    for name, own in CANDIDATES:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        high = [c for c in text if ord(c) > 127]
        inside = sum(ord(c) in own for c in high)
        lower = sum(c.islower() for c in high)
        mixed = len(re.findall(r"[a-zа-яё][A-ZА-ЯЁ]|[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]", text))  # no word has two alphabets
        score = (inside + 0.5 * lower - 2 * mixed) / max(len(high), 1) + (0.3 if len(high) * 2 > len(text) and name not in ("cp1252", "cp1250", "cp1254") else 0)
        if name == "shift_jis" and inside * 4 > len(high):
            score += 1  # a quarter of kana is Japanese, whatever else the bytes may spell
        if score > best[2]:
            best = (text, name, score)
    return (best[0], best[1]) if best[2] > float("-inf") else (data.decode("cp1252", "replace"), "cp1252")


@F.pandas_udf(Y.StructType().add("text", Y.StringType()).add("encoding", Y.StringType()))
def decoded(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(bytes(x)) if x is not None else (None, None) for x in data], columns=["text", "encoding"])
