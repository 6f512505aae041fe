"""Benchmark decontamination by template canonicalisation.

Words (letters, digits, non-ASCII bytes; A-Z lower-cased) become template tokens: runs of numbers are <number>,
runs of capitalised words inside a sentence <name>, a unit after a number <unit>. Each window of ``WIDTH`` template
tokens is hashed, in four forms: with names as placeholders; without regard to case with names as words; with number
words as numbers; and with these and names also where they open a sentence (any capitalised word but ``OPENERS``).
Items too short or too full of placeholders for a window are matched by their words and numbers as they are. The
windows of documents that a fixed-size sieve of the benchmark's windows lets pass are hash-joined with them.
A document leaks an item if, at one alignment, windows that cover ``RUN`` starts of the item (all, if it has
fewer) match, and their slots are consistent: equal values of the item stand for equal values of the document.
So a question asked again with other numbers or names is caught, and a chance mixture of values is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SALT_LOWER, Rolling, blocks, given_id, mix, sieve, signed, table, text_digest, with_id, without, words, written

WIDTH, RUN, LITERAL = 8, 5, 4
# Units that count as such after a number.
UNIT_WORDS = "mm cm m km in ft mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur kb mb gb tb hz khz mhz ghz v volt volts w watt watts kw j joule joules n newton newtons k degree degrees".split()

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen".split()
# Words that open a sentence and are no names.
OPENERS = "a about after all also although an and another any are as at because been before both but by can could did do does during each either every few for from had has have he her here his how i if in into is it its many more most much my neither no not now of on once one only or other our over she should since so some such than that the their them then there these they this those though through thus to under until up was we were what when where whether which while who whom whose why with within without would you your".split()

_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_STOP = np.array([chr(b) in ".!?:;\n\r\"" for b in range(256)])
NUMBER, NAME, UNIT = 1, 2, 3
_MARK = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _hashed(of: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(of).encode(), np.uint8)
    start, end, _ = words(buf, np.array([0, len(buf)]))
    return np.sort(Rolling(buf, SALT_LOWER).of(start, end))


UNITS, NUMBERS, PLAIN = _hashed(UNIT_WORDS), _hashed(NUMBER_WORDS), _hashed(OPENERS)
#: Forms: whether names are placeholders, also at a sentence's start, and whether number words are
FORMS = [(True, False, False), (False, False, False), (True, True, True), (True, False, True)]
LITERALLY = len(FORMS)  # the form of the words as they are
_CAPITALS = np.array([c > 0xFF and (chr(c).isupper() or chr(c).istitle()) for c in range(1 << 17)])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _letter(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point at each place of well-formed UTF-8 (0 at the end of the word), and the place after it."""
    b = [np.where(at + k < end, buf[np.minimum(at + k, len(buf) - 1)], 0).astype(np.int64) for k in range(4)]
    size = np.where(b[0] < 0xC0, 1, np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4)))
    low = [x & 0x3F for x in b]
    point = np.select([size == 1, size == 2, size == 3], [b[0], (b[0] & 0x1F) << 6 | low[1], (b[0] & 0xF) << 12 | low[1] << 6 | low[2]], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3])
    return np.minimum(point, len(_CAPITALS) - 1), at + size


def templates(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of FORMS and the literal one: token hashes, slot values (0: a literal word) and rows."""
    start, end, row = words(buf, off, _BETWEEN)
    h = Rolling(buf, SALT_LOWER).of(start, end)
    n = len(h)
    lead, second = buf[start] if n else buf[:0], buf[np.minimum(start + 1, end - 1)] if n else buf[:0]
    digits, spelled = _DIGIT[lead], _among(h, NUMBERS)
    latin = (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    capital = (_UPPER[lead] & ~((end - start > 1) & _UPPER[second])) | latin
    if n and (lead >= 0xC4).any():  # of other scripts
        far = np.flatnonzero(lead >= 0xC4)
        point, after = _letter(buf, start[far], end[far])
        capital[far] |= _CAPITALS[point] & ~_CAPITALS[_letter(buf, after, end[far])[0]]
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    opens = np.ones(n, bool)
    opens[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    units, plain = _among(h, UNITS), _among(h, PLAIN)
    for names, at_start, in_words in FORMS:
        number = digits | spelled if in_words else digits
        unit = np.zeros(n, bool)
        unit[1:] = number[:-1] & (row[1:] == row[:-1])
        unit &= units
        name = capital & (~opens | ~plain if at_start else ~opens) & names
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0)))
        same = np.zeros(n, bool)  # a placeholder's later words
        same[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & (row[1:] == row[:-1]) & ~((kind[1:] == NAME) & opens[1:])
        at = np.flatnonzero(~same)
        value = np.add.reduceat(mix(h), at) if n else h
        first = kind[at]
        yield np.where(first > 0, _MARK[first], h[at]), np.where(first > 0, value | np.uint64(1), np.uint64(0)), row[at]
    yield h, np.zeros(n, np.uint64), row


def windows(token: np.ndarray, slot: np.ndarray, row: np.ndarray, width: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of width tokens inside a row that has enough literal words."""
    m = max(len(token) - width + 1, 0)
    h = np.full(m, width * 8 + form, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9DDFEA08EB382D69) + token[k : k + m]
    literal = np.concatenate([[0], np.cumsum(slot == 0)])
    good = (row[:m] == row[width - 1 : width - 1 + m]) & (literal[width : width + m] - literal[:m] >= min(LITERAL, (width + 1) // 2))
    at = np.flatnonzero(good)
    return at, mix(h[at])


_WINDOW = "id {}, form int, pos int, h long, slots array<long>"


def _rows(ids: pa.Array, i: int, form: int, row: np.ndarray, slot: np.ndarray, at: np.ndarray, h: np.ndarray, width: int) -> pa.RecordBatch:
    first = np.searchsorted(row, row[at])  # of its row
    slots = slot[at[:, None] + np.arange(width)].ravel()
    lists = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * width).astype(np.int32)), pa.array(signed(slots)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(i + row[at])), pa.array(np.full(len(at), form, np.int32)), pa.array((at - first).astype(np.int32)), pa.array(signed(h)), lists], names=["id", "form", "pos", "h", "slots"])


def item_windows(items: DataFrame, least_words: int) -> DataFrame:
    """Windows of items(id, text); one of fewer than WIDTH tokens is one window of its own length. The literal form only where no other has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in blocks(batch["text"]):
                has = np.zeros(j - i, bool)
                for form, (token, slot, row) in enumerate(templates(buf, off)):
                    count = np.bincount(row, minlength=j - i)
                    for width in range(max(least_words, 1), WIDTH + 1):
                        at, h = windows(token, slot, row, width, form)
                        keep = np.ones(len(at), bool) if width == WIDTH else count[row[at]] == width
                        if form == LITERALLY:
                            keep &= ~has[row[at]]
                        else:
                            has[row[at[keep]]] = True
                        yield _rows(batch["id"], i, form, row, slot, at[keep], h[keep], width)

    return items.mapInArrow(run, _WINDOW.format("long"))


def leaks(docs: DataFrame, items: DataFrame, least_words: int = 3) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, exact for each document that holds an item of the benchmark.

    docs(doc_id, text), items(item_id, text). n_windows: the item's window starts; n_matched: those found, in the
    best form and alignment; exact: all slots of them have the item's values. An item without
    a window (fewer than least_words template tokens, or too few literal words in each window) leaks where its words and numbers
    stand as they are, all of them and in order; asked again with other numbers it is out of reach. Null and empty
    texts, and items of fewer than least_words words, numbers counted each, leak nothing. Null identifiers count as one and come back as null;
    repeated rows give one result row; other columns are ignored.
    """
    return _leaks(docs.select(with_id().alias("id"), "text"), items, least_words)


def _leaks(docs: DataFrame, items: DataFrame, least_words: int = 3) -> DataFrame:
    """leaks of docs(id, text); the doc_id that it returns is id, of any type."""
    asked = written(item_windows(items.select(with_id("item_id").alias("id"), "text").where("text is not null"), least_words))
    sizes = sorted(tuple(r) for r in asked.select("form", F.size("slots").alias("n")).distinct().collect())  # WIDTH for each form at most
    shared = docs.sparkSession.sparkContext.broadcast((sieve(asked, "h"), sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        for batch in batches:
            for i, _, buf, off in blocks(batch["text"]):
                for form, (token, slot, row) in enumerate(templates(buf, off)):
                    for width in (n for f, n in sizes if f == form):
                        at, h = windows(token, slot, row, width, form)
                        keep = known.has(h)
                        yield _rows(batch["id"], i, form, row, slot, at[keep], h[keep], width)

    seen = docs.where("text is not null").mapInArrow(run, _WINDOW.format(docs.schema["id"].dataType.simpleString()))
    per_item = asked.groupBy("id", "form").agg(F.countDistinct("pos").alias("n_windows"))
    a = asked.select(F.col("id").alias("item_id"), "form", F.col("pos").alias("p"), "h", F.col("slots").alias("asked"))
    b = seen.select(F.col("id").alias("doc_id"), "form", F.col("pos").alias("q"), "h", "slots")
    hits = a.join(b, ["form", "h"]).select("doc_id", "item_id", "form", "p", (F.col("q") - F.col("p")).alias("shift"), "asked", "slots")
    place = ["doc_id", "item_id", "form", "shift"]
    values = hits.select(*place, "p", F.explode(F.arrays_zip("asked", "slots")).alias("z")).groupBy(*place, F.col("z.asked").alias("v")).agg(F.min("z.slots").alias("lo"), F.max("z.slots").alias("hi"), F.collect_set("p").alias("ps"))
    runs = values.groupBy(*place).agg(
        F.bool_and((F.col("v") == 0) | (F.col("lo") == F.col("hi"))).alias("consistent"),
        F.bool_and((F.col("v") == F.col("lo")) & (F.col("v") == F.col("hi"))).alias("exact"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("n_matched"),
    )
    found = runs.where("consistent").join(per_item.withColumnRenamed("id", "item_id"), ["item_id", "form"])
    found = found.where(F.col("n_matched") >= F.when(F.col("form") == LITERALLY, F.col("n_windows")).otherwise(F.least(F.lit(RUN), F.col("n_windows"))))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "exact", "n_windows")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n_matched").cast("long").alias("n_matched"), F.col("x.n_windows").cast("long").alias("n_windows"), F.col("x.exact").alias("exact"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(given_id(), given_id("item_id"), "n_matched", "n_windows", "exact")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item. A row goes by its identifier and its text, so rows of null or repeated identifiers are judged each."""
    rows = docs.select(F.struct(with_id().alias("doc_id"), text_digest().alias("digest")).alias("id"), "text")
    return without(docs, written(_leaks(rows, items).select("doc_id.doc_id", "doc_id.digest").distinct()))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op6_decontaminate": op6_decontaminate}
