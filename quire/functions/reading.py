"""Scalar functions of reading: opening words and their mark, copied text, markers, titles, authors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

SNIPPET, CLIPBOARD = 48, 100_000


def plain_block(t: Column) -> Column:
    """The visible characters of a block with inline markup: breaks as new lines, no tags, entities as characters."""
    x = F.regexp_replace(F.regexp_replace(t, r"<br\s*/?>", "\n"), r"<[^>]*>", "")
    for said, meant in (("&#160;", "\u00a0"), ("&#8239;", "\u202f"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(said), F.lit(meant))
    return x


def escape(t: Column) -> Column:
    for meant, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(meant), F.lit(said))
    return t


def snippet(t: Column) -> Column:
    """The opening words that a place is known by."""
    return F.substring(F.trim(F.regexp_replace(F.replace(t, F.lit("\u00ad"), F.lit("")), r"(?U)\s+", " ")), 1, SNIPPET)


@F.pandas_udf(Y.StringType())
def mark(words: pd.Series) -> pd.Series:
    """A 56-bit fingerprint of opening words as # and 14 hex digits; empty stays empty and a fingerprint is itself. All rows step together."""
    texts = words.fillna("")
    is_mark = texts.str.fullmatch("#[0-9a-f]{14}")
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32) for t in texts]
    size = np.array([len(u) for u in units], np.int64)
    # Seeds and factors of the fingerprint.
    a, b = (np.full(len(texts), s, np.uint32) for s in (0xDEADBEEF, 0x41C6CE57))
    step_a, step_b, end_a, end_b = (np.uint32(x) for x in (2654435761, 1597334677, 2246822507, 3266489909))
    for k in range(size.max() if len(size) else 0):
        on = np.flatnonzero(size > k)
        c = np.array([units[i][k] for i in on], np.uint32)
        a[on], b[on] = (a[on] ^ c) * step_a, (b[on] ^ c) * step_b
    fold = lambda h, by, f: (h ^ (h >> np.uint32(by))) * f
    a = fold(a, 16, end_a) ^ fold(b, 13, end_b)
    b = fold(b, 16, end_a) ^ fold(a, 13, end_b)
    out = pd.Series([f"#{int(y) & 0xFFFFFF:06x}{int(x):08x}" for x, y in zip(a, b, strict=True)], index=texts.index)
    return out.where(~is_mark & (texts != ""), texts)


def clean_copy(t: Column) -> Column:
    """Text for a clipboard: plain line ends and blanks, no soft hyphens, at most one empty line between paragraphs."""
    x = F.translate(t, "\u2028\u2029\u00a0\u202f\u00ad", "\n\n  ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def clipped(t: Column, most: int = CLIPBOARD) -> Column:
    """Clean text of at most so many UTF-8 bytes, cut between characters, at a paragraph if one ends in the second half."""
    whole = clean_copy(t)
    data = whole.cast("binary")
    inside = lambda k: F.hex(F.substring(data, most + 1 - k, 1)).between("80", "BF")
    back = F.when(inside(0), F.when(inside(1), F.when(inside(2), 3).otherwise(2)).otherwise(1)).otherwise(0)
    cut = F.substring(data, F.lit(1), F.lit(most) - back).cast("string")
    at = F.length(cut) - F.instr(F.reverse(cut), "\n\n") - 1  # characters before the last empty line
    ended = F.when((F.instr(cut, "\n\n") > 0) & (at > F.length(cut) / 2), F.substring(cut, F.lit(1), at.cast("int"))).otherwise(cut)
    return F.when(F.octet_length(whole) <= most, whole).otherwise(F.regexp_replace(ended, r"(?U)^\s+|\s+$", ""))


def roman(n: Column) -> Column:
    """Small Roman numerals of 1 to 3999."""
    place = lambda one, five, ten: F.array(*(F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)))
    digit = lambda by: (F.floor(n / by) % 10 + 1).cast("int")
    return F.concat(F.element_at(place("m", "", ""), digit(1000)), F.element_at(place("c", "d", "m"), digit(100)), F.element_at(place("x", "l", "c"), digit(10)), F.element_at(place("i", "v", "x"), digit(1)))


def roman_value(t: Column) -> Column:
    """The number that Roman numerals say: a smaller one before a larger one is taken off."""
    worth = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)) for x in p)), c), F.lit(0))
    back = F.reverse(F.split(F.lower(t), ""))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("high"))
    step = lambda acc, c: F.struct((acc["sum"] + F.when(worth(c) < acc["high"], -worth(c)).otherwise(worth(c))).alias("sum"), F.greatest(acc["high"], worth(c)).alias("high"))
    return F.aggregate(back, start, step, lambda acc: acc["sum"])


def letter_marker(n: Column) -> Column:
    """a to z, then aa, ab and so on, to zz."""
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (i + 1).cast("int"), F.lit(1))
    low, high = (n - 1) % 26, F.floor((n - 1) / 26) - 1
    return F.concat(F.when(high >= 0, letter(high)).otherwise(""), letter(low))


def raised(t: Column) -> Column:
    """Text as superscript characters, if each has one; else null."""
    return F.when(t.rlike(r"^[0-9+=()n-]+$"), F.translate(t, "0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"))


def contents_title(t: Column, most: int = 120) -> Column:
    """One line; a longer one is cut at a word and ends in an ellipsis."""
    line = F.trim(F.regexp_replace(t, r"\s+", " "))
    cut = F.regexp_replace(F.regexp_replace(F.substring(line, 1, most), r" [^ ]*$", ""), r"[ ,;:-]+$", "")
    return F.when(F.length(line) > most, F.concat(cut, F.lit("…"))).otherwise(line)


def author_line(names: Column, most: int = 20, length: int = 300) -> Column:
    """Names in order, each once, at most so many, as one line."""
    line = F.array_join(F.slice(F.array_distinct(F.filter(names, lambda n: n != "")), 1, most), ", ")
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length), F.lit("…"))).otherwise(line)


def visible(t: Column) -> Column:
    """Whether a block has more than blanks and soft hyphens."""
    return F.translate(t, " \n\u00a0\u202f\u00ad", "") != ""


def clamp(x: Column, low: float, high: float) -> Column:
    """Within bounds; what is no number is the lower one."""
    return F.when(x.isNull() | F.isnan(x), F.lit(low)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), x)))


def noisy(t: Column) -> Column:
    """More than one control character in fifty: no text."""
    controls = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return controls * 50 > F.length(t)
