"""Toxicity by noisy-channel deobfuscation and a linear model on the restored text.

Tokens that may be disguised (letters mixed with look-alike digits and signs, a letter three times running, runs of
single letters) become character lattices: each sign may stand for itself or a letter it looks like, a separator
or a repeat for nothing. Viterbi decoding under a character trigram model takes the likeliest word; a token
without such signs has one path and is taken as it is. Restored words and their prefixes are features. A run may
hold several words, so it is read as one word, as the words of a lattice that may end a word after each letter, and
from each of its letters on: words of four letters or more are found by that wherever they start, shorter ones where
the lattice or a wider gap sets them apart. Runs and tokens of any length are decoded, long ones in pieces.

The trigrams are counted over all texts, labelled or not. Only the classifier is learned from a bounded sample:
the ``SAMPLE`` rows of each label with the smallest hashes. Up to
``FEATURES`` features with the largest association are weighed by logistic regression, with the sample's share of
each label put right by what all labelled rows show. The model is bounded and broadcast; scoring is map-only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, SALT_LOWER, SPACE, Rolling, blocks, mix, signed, table, words, written

SAMPLE, FEATURES, LEAST = 10_000, 2048, 5
PREFIXES, WHOLE = (4, 5, 6), np.uint64(0x5555)
TOKEN, PIECE = 64, 4096  # a longer token is read as a run of letters; pieces in which long ones are decoded
# What signs may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*~'`/\\,:;^"
SAME, LOOKS, REPEAT, SKIP, DROP = -0.05, -1.2, -0.7, -0.3, -2.5

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_SIGN = np.array([b < 128 and (chr(b) in LOOKALIKES or chr(b) in "._-*~'`/\\") for b in range(256)])
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])  # the first byte of a code point
_EDGE = np.array([b < 128 and not chr(b).isalnum() and chr(b) not in "@$|+(" for b in range(256)])


class Channel:
    """A character trigram model, and the decoder of lattices under it."""

    def __init__(self, counts: dict[str, int]):
        self.logs: dict[str, float] = {}
        context: dict[str, int] = {}
        for g, n in counts.items():
            context[g[:2]] = context.get(g[:2], 0) + n
        self.logs = {g: float(np.log((n + 0.1) / (context[g[:2]] + 0.1 * 60))) for g, n in counts.items()}
        self.rare = {c: float(np.log(0.1 / (n + 0.1 * 60))) for c, n in context.items()}
        self.none = float(np.log(1 / 60))
        self._cached()

    def _cached(self) -> None:
        self._short = lru_cache(1 << 16)(self._decode)

    def step(self, state: str, c: str) -> float:
        p = self.logs.get(state + c)
        return p if p is not None else self.rare.get(state, self.none)

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest word; if spaced, words: a blank may follow each letter, and one in the token is likely one."""
        return (self._short if len(token) <= TOKEN else self._decode)(token, spaced)

    def _decode(self, token: str, spaced: bool) -> str:
        best: dict[tuple[str, str], tuple[float, tuple | str]] = {("  ", ""): (0.0, "")}  # (last two letters, last sign) to (score, letters back to a text)
        done: list[str] = []
        for i, o in enumerate(token):
            gap = spaced and o == " "
            arcs: list[tuple[str, float]] = []
            if o.isalnum():
                arcs.append((o, SAME if o.isalpha() else DROP))
            arcs += [(c, LOOKS) for c in LOOKALIKES.get(o, "")]
            if o in SEPARATORS or not arcs:
                arcs.append(("", DROP if gap else SKIP))
            found: dict[tuple[str, str], tuple[float, tuple | str]] = {}
            for (state, last), (score, word) in best.items():
                options = [*arcs, ("", REPEAT)] if o == last and not gap else arcs
                for c, cost in options:
                    key = ((state[1] + c) if c else state, o)
                    x = score + cost + (self.step(state, c) if c else 0.0)
                    if key not in found or x > found[key][0]:
                        found[key] = (x, (word, c) if c else word)
            if spaced:
                for (state, _), (score, word) in [kv for kv in found.items() if kv[0][0] != "  "]:
                    x = score + self.step(state, " ") - (DROP if gap else 0.0)
                    if ("  ", o) not in found or x > found["  ", o][0]:
                        found["  ", o] = (x, (word, " "))
            best = dict(sorted(found.items(), key=lambda kv: -kv[1][0])[:32]) if len(found) > 32 else found
            if i % PIECE == PIECE - 1:  # what all paths agree on is settled
                texts = {k: _text(w) for k, (_, w) in best.items()}
                same = os.path.commonprefix(list(texts.values()))
                done.append(same)
                best = {k: (x, texts[k][len(same) :]) for k, (x, _) in best.items()}
        ends = [(s + (self.step(state, " ") if state != "  " else 0.0), w) for (state, _), (s, w) in best.items()]
        most = max(s for s, _ in ends)
        return "".join(done) + max(_text(w) for s, w in ends if s == most)


def _text(word: tuple | str) -> str:
    out = []
    while not isinstance(word, str):
        word, c = word
        out.append(c)
    return word + "".join(reversed(out))


def features(buf: np.ndarray, off: np.ndarray, channel: Channel | None, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each row's restored words, and their rows. inside: also those from any letter of a run or long token."""
    start, end, row = words(buf, off)
    letters, signs, points = (np.concatenate([[0], np.cumsum(t[buf])]) for t in (_LETTER, _SIGN, _POINT))
    for _ in range(3):  # quotes, brackets, full stops around a word
        start = start + ((start < end - 1) & _EDGE[buf[start]])
        end = end - ((start < end - 1) & _EDGE[buf[end - 1]])
    out, rows = [_hashes(buf, start, end)], [row]
    if channel:
        low = LOWER[buf]
        triple = np.zeros(len(buf) + 1, np.int64)
        triple[3:] = np.cumsum((low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & _LETTER[low[2:]] & (low[2:] < 128)) if len(buf) > 2 else 0
        odd = ((letters[end] > letters[start]) & (signs[end] > signs[start])) | (triple[end] > triple[np.minimum(start + 2, end)])
        texts, of, whole, whole_of = [], [], [], []
        data = buf.tobytes()

        def spelled(text: str, r: int) -> None:
            one = channel.decode(text.replace(" ", ""))
            found = {one, *channel.decode(text, True).split(" ")} - {""}
            texts.extend(found)
            of.extend([r] * len(found))
            whole.append(one)
            whole_of.append(r)

        for k in np.flatnonzero(odd):
            text = data[start[k] : end[k]].decode("utf-8", "replace").lower()
            if end[k] - start[k] > TOKEN:
                spelled(text, row[k])
            else:
                texts.append(channel.decode(text))
                of.append(row[k])
        single = np.flatnonzero((points[end] - points[start] == 1) & (_LETTER[buf[start]] | _SIGN[buf[start]])) if len(start) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(single) > 1) | (np.diff(row[single]) > 0)])) if len(single) else single
        size = np.diff(np.concatenate([first, [len(single)]]))
        for lo, n in zip(single[first[size > 1]], size[size > 1], strict=True):
            gaps = start[lo + 1 : lo + n] - end[lo : lo + n - 1]
            wide = np.concatenate([[False], gaps > gaps.min()])  # between words
            spelled("".join((" " if w else "") + data[a:b].decode("utf-8", "replace").lower() for a, b, w in zip(start[lo : lo + n], end[lo : lo + n], wide, strict=True)), row[lo])
        if texts:
            more = np.frombuffer(" ".join(t.replace(" ", "") or "-" for t in texts).encode("utf-8", "replace"), np.uint8)
            s, e, _ = words(more, np.array([0, len(more)]))
            out.append(_hashes(more, s, e))
            rows.append(np.array(of, np.int64))
        if whole and inside:
            more = np.frombuffer(" ".join(t or "-" for t in whole).encode("utf-8", "replace"), np.uint8)
            _, e, _ = words(more, np.array([0, len(more)]))
            roll, s = Rolling(more, SALT_LOWER), np.flatnonzero(_POINT[more] & ~SPACE[more])
            which = np.searchsorted(e, s, "right")
            for n in PREFIXES:  # a word from there on has n letters, or more
                fits = s + n <= e[which]
                h = roll.of(s[fits], s[fits] + n)
                out.append([h, h ^ WHOLE])
                rows.append(np.array(whole_of, np.int64)[which[fits]])
    h, r = np.concatenate([x for o in out for x in o]), np.concatenate([x for o, w in zip(out, rows, strict=True) for x in [w] * len(o)])
    return h, r


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    roll = Rolling(buf, SALT_LOWER)
    whole = roll.of(start, end) ^ WHOLE
    return [whole, *(np.where(end - start > n, roll.of(start, np.minimum(start + n, end)), whole) for n in PREFIXES)]


def trigrams(docs: DataFrame) -> dict[str, int]:
    """Character trigrams of the words of docs(text): of the common letters only, so bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(64**3, np.int64)
            for _, _, buf, off in blocks(batch["text"]):
                low = LOWER[buf]
                code = np.where((low >= 97) & (low < 123), low - 96, np.where(SPACE[low], 0, 27)).astype(np.int64)
                code = np.insert(code, off, 0)  # rows begin and end with a blank, so counts don't depend on batches
                code = code[np.concatenate([[True], (code[1:] > 0) | (code[:-1] > 0)])] if len(code) else code
                code = np.repeat(code, np.where(code == 0, 2, 1))  # a word starts with two blanks before it
                if len(code) > 2:
                    total += np.bincount((code[:-2] * 64 + code[1:-1]) * 64 + code[2:], minlength=64**3)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])

    cells = docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    shown = " abcdefghijklmnopqrstuvwxyz\x00"
    parts = [(g // 4096, g // 64 % 64, g % 64, n) for g, n in cells]
    return {shown[a] + shown[b] + shown[c]: n for a, b, c, n in parts if 27 not in (a, b, c)}


class Model:
    def __init__(self, h: np.ndarray, w: np.ndarray, bias: float, channel: Channel):
        order = np.argsort(h)
        self.h, self.w, self.bias, self.channel = h[order], w[order], bias, channel
        self.low = np.zeros(1 << 16, bool)
        self.low[(h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __getstate__(self):
        x = dict(self.__dict__)
        x["channel"] = {k: v for k, v in self.channel.__dict__.items() if k != "_short"}
        return x

    def __setstate__(self, x):
        channel = Channel({})
        channel.__dict__.update(x.pop("channel"))
        self.__dict__.update(x, channel=channel)

    def find(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) of those that the model knows."""
        maybe = self.low[(h & np.uint64(0xFFFF)).astype(np.int64)]
        h, row = h[maybe], row[maybe]
        if not len(self.h) or not len(h):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        cell = np.unique(row[hit] * len(self.h) + at[hit])
        return cell // len(self.h), cell % len(self.h)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, at = self.find(*features(buf, off, self.channel))
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, self.w[at], len(off) - 1), -30, 30)))


def logistic(row: np.ndarray, at: np.ndarray, y: np.ndarray, m: int, penalty: float = 1e-5, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Weights of m features and bias, by accelerated gradient steps."""
    w, b, v, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    n = max(len(y), 1)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))  # both labels alike
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[at], n) + vb, -30, 30)))
        g = (p - y) * weight
        nw, nb = v - 2.0 * (np.bincount(at, g[row], m) + penalty * v), vb - 2.0 * g.sum()
        k = t / (t + 3)
        w, b, v, vb = nw, nb, nw + k * (nw - w), nb + k * (nb - b)
    return w, b


def fit(docs: DataFrame, labels: DataFrame | None = None) -> Model:
    """Of docs(doc_id, text) and labels(doc_id, toxic), or docs with toxic; rows whose toxic is null left out. Labels meet identifiers, texts only the sample. Needs both labels, else all scores are the share of 1."""
    labelled = (docs if labels is None else docs.select("doc_id").join(labels, "doc_id")).select("doc_id", "toxic").where("toxic is not null")
    share = dict(labelled.groupBy((F.col("toxic") > 0).cast("int").alias("y")).count().collect())
    texts = None
    for y in (0, 1):  # TakeOrdered: each partition sends at most SAMPLE identifiers
        part = labelled.where((F.col("toxic") > 0) == F.lit(bool(y))).select("doc_id", F.lit(y).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        texts = part if texts is None else texts.unionByName(part)
    # 2 * SAMPLE identifiers at most: a proven bound
    chosen = written(docs.select("doc_id", "text").join(F.broadcast(texts), "doc_id").dropDuplicates(["text"]))
    channel = Channel(trigrams(docs))  # of all texts, labelled or not: at most 28**3 cells reach the driver
    shared = docs.sparkSession.sparkContext.broadcast(Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, channel))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch["y"].to_numpy()
            for i, j, buf, off in blocks(batch["text"]):
                h, row = features(buf, off, shared.value.channel, inside=False)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, toxic = h[new], y[i:j][row[new]]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(np.add.reduceat(toxic, at).astype(np.int64) if len(at) else at), pa.array(np.diff(np.concatenate([at, [len(h)]])))], names=["h", "a", "n"])

    chosen = chosen.select("text", "y")
    n1, n0 = max(min(share.get(1, 0), SAMPLE), 1), max(min(share.get(0, 0), SAMPLE), 1)
    seen = chosen.mapInArrow(count, "h long, a long, n long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where(f"a >= {LEAST}")
    odds = F.log((F.col("a") + 0.5) / (F.col("n") - F.col("a") + 0.5) * n0 / n1)
    top = seen.withColumn("o", odds).where("o > 1").orderBy(F.desc(F.col("a") * F.col("o")), "h").limit(FEATURES).toArrow()
    h = np.sort(top["h"].to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)
    model = Model(h, np.zeros(len(h)), 0.0, channel)
    probe = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in blocks(batch["text"]):
                row, at = probe.value.find(*features(buf, off, probe.value.channel))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["y"][i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))], names=["y", "at"])

    data = chosen.mapInArrow(rows, "y int, at array<int>").toArrow()  # 2 * SAMPLE short lists at most
    y = data["y"].to_numpy().astype(float)
    lists = data["at"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.array(data["at"].to_pylist(), pa.list_(pa.int32()))
    sizes = np.array([len(x) for x in lists.to_pylist()], np.int64)
    w, b = logistic(np.repeat(np.arange(len(y)), sizes), np.concatenate([np.array(x, np.int64) for x in lists.to_pylist()] or [np.zeros(0, np.int64)]), y, len(h))
    both = sum(share.values())
    prior = np.log((share.get(1, 0) + 0.5) / (both - share.get(1, 0) + 0.5))
    return Model(h, w, float(b + 0.5 * prior) if share.get(1) and share.get(0) else float(prior), channel)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) with score and predicted, without the text. Null texts are empty, which is a text of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    schema = docs.select(others).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for i, j, buf, off in blocks(batch["text"]):
                s[i:j] = shared.value.score(buf, off)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*others, "text").mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 0. A null doc_id counts as the empty text."""
    held = lambda: F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(docs, labels)
    return score(docs.withColumn("held_out", held()), model)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op4_toxicity": op4_toxicity}
