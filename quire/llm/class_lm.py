"""Language-model scoring by Brown class-based bigrams.

P(word | previous) = P(class | previous class) * P(unit | class) * P(word | unit). Every training word
of ``PLACED`` occurrences or more is a unit of its own, the end token is one, and rarer words belong to the unit of their
shape (a hash of their last two bytes). The ``WORDS`` most frequent words, the end and the shapes are put into classes by
exchange clustering: each in turn is moved to the class that raises the likelihood of all class bigrams most. Then all
other words of their own are moved at once from their shape's class to the class under which their own bigrams are
likeliest, by the classes of the words before and after them, counted in Spark. The class bigrams are counted again
after that. The statistics come from the whole training corpus, combined on the map side; the driver sees unit
bigrams, at most (WORDS + SHAPES + 1)**2 numbers, and three numbers for each word of its own.

Words are 64-bit identifiers: 56 bits of a hash of the lower-cased bytes, and the shape. The counts of the
``COUNTED`` most frequent words, and of all words of their own if those are more, are broadcast (24 bytes a word, so
they grow with the types of PLACED occurrences, not with the tokens); all rarer words get theirs by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quire.llm.common import LOWER, SALT_LOWER, Rolling, blocks, mix, signed, table, words, written

WORDS, SHAPES, COUNTED, CLASSES, ROUNDS, PLACED = 2048, 256, 1 << 17, 64, 5, 5
UNITS = WORDS + SHAPES + 1
END_UNIT = UNITS - 1
END = 1 << 62
BACK_OFF, EVEN = 1.0, 0.5


def word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifier and row of each word of a block; the low byte of an identifier is the word's shape."""
    start, end, row = words(buf, off)
    h = Rolling(buf, SALT_LOWER).of(start, end)
    low = LOWER[buf] if len(buf) else buf
    last, before = low[end - 1].astype(np.uint64), np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    shape = mix(last * np.uint64(257) + before) & np.uint64(SHAPES - 1)
    return signed((h & ~np.uint64(SHAPES - 1)) | shape), row


def word_counts(docs: DataFrame) -> DataFrame:
    """All words of docs(text) and the end token: h, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [word_ids(buf, off)[0] for _, _, buf, off in blocks(batch["text"])]
            h, n = np.unique(np.concatenate([*parts, np.full(batch.num_rows, END)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Lexicon:
    """Frequent words: sorted identifiers, counts and units. Units after END_UNIT are of words that were placed."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        first = [i for i in np.lexsort((h, -n)) if h[i] != END][:WORDS]
        unit = (h & (SHAPES - 1)) + WORDS
        unit[first] = np.arange(len(first))
        unit[h == END] = END_UNIT
        order = np.argsort(h)
        self.h, self.n, self.unit = h[order], n[order], unit[order].astype(np.int64)

    def place(self, h: np.ndarray) -> None:
        """Words become units of their own."""
        self.unit[np.searchsorted(self.h, h)] = END_UNIT + 1 + np.arange(len(h))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether found, count (0 if not), unit."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), (h & (SHAPES - 1)) + WORDS
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[at] == h
        return found, np.where(found, self.n[at], 0), np.where(found, self.unit[at], (h & (SHAPES - 1)) + WORDS)


def sequence(unit: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous unit, unit and row of each token; each row ends with the end token, which also stands before its first."""
    at = np.arange(len(unit)) + row
    n = len(unit) + rows
    ends = np.searchsorted(row, np.arange(rows), "right") + np.arange(rows)
    now, of = np.full(n, END_UNIT), np.zeros(n, np.int64)
    now[at], of[at], of[ends] = unit, row, np.arange(rows)
    prev = np.full(n, END_UNIT)
    prev[1:] = now[:-1]
    return prev, now, of


def unit_bigrams(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, j, buf, off in blocks(batch["text"]):
                h, row = word_ids(buf, off)
                prev, now, _ = sequence(shared.value.find(h)[2], row, j - i)
                parts.append(prev * UNITS + now)
            code, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    cells = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS * UNITS)
    out[cells["code"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(UNITS, UNITS)


def _log_move(pair: np.ndarray) -> np.ndarray:
    share = (pair.sum(0) + 1) / (pair.sum() + CLASSES)
    return np.log10((pair + BACK_OFF * share) / (pair.sum(1, keepdims=True) + BACK_OFF))


def placed(docs: DataFrame, lexicon: Lexicon, of: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of PLACED occurrences beyond the WORDS most frequent, and the class of each: the likeliest of its bigrams."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, of, _log_move(pair), np.log10(pair.sum(0) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, of, _, _ = shared.value
        for batch in batches:
            words_, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, buf, off in blocks(batch["text"]):
                h, row = word_ids(buf, off)
                _, count, unit = lexicon.find(h)
                _, now, _ = sequence(unit, row, j - i)
                at = np.arange(len(h)) + row
                tail = (unit >= WORDS) & (count >= PLACED)
                c = of[now]
                before = np.where(at[tail] > 0, c[at[tail] - 1], of[END_UNIT])
                words_ += [h[tail]] * 2
                codes += [before, CLASSES + c[at[tail] + 1]]
            h, code = np.concatenate(words_), np.concatenate(codes)
            order = np.lexsort((code, h))
            h, code = h[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])])) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(code[first].astype(np.int32)), pa.array(np.diff(np.concatenate([first, [len(h)]])))], names=["h", "code", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, log_move, log_mass = shared.value
        both = np.concatenate([log_move, log_move.T])  # from the class before; to the class after
        for batch in batches:
            lists = batch["cells"]
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            cells = lists.flatten()
            code, n = cells.field("code").to_numpy(), cells.field("n").to_numpy()
            counts = np.zeros((len(lists), 2 * CLASSES))
            counts[row, code] = n
            gain = counts @ both - counts[:, :CLASSES].sum(1, keepdims=True) * log_mass
            gain[:, 0] = -np.inf  # the end's
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(gain.argmax(1))], names=["h", "c"])

    cells = docs.select("text").mapInArrow(run, "h long, code int, n long").groupBy("h", "code").agg(F.sum("n").alias("n"))
    found = cells.groupBy("h").agg(F.collect_list(F.struct("code", "n")).alias("cells")).mapInArrow(choose, "h long, c long").toArrow()
    order = np.argsort(found["h"].to_numpy())
    return found["h"].to_numpy()[order], found["c"].to_numpy()[order]


def class_bigrams(docs: DataFrame, lexicon: Lexicon, of: np.ndarray) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, of = shared.value
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for i, j, buf, off in blocks(batch["text"]):
                h, row = word_ids(buf, off)
                prev, now, _ = sequence(lexicon.find(h)[2], row, j - i)
                total += np.bincount(of[prev] * CLASSES + of[now], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    cells = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[cells["code"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit. The end unit keeps class 0 for itself; units are visited by falling frequency."""
    freq = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-freq, kind="stable") if u != END_UNIT]
    of = np.zeros(len(bigrams), np.int64)
    for k, u in enumerate(order):
        of[u] = 1 + k % (classes - 1)
    one = np.eye(classes)[of]
    right, left = bigrams @ one, bigrams.T @ one  # of a unit: followers and predecessors by class
    pair = one.T @ right
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not freq[u]:
                continue
            a, self_ = of[u], bigrams[u, u]
            r, le = right[u].copy(), left[u].copy()
            r[a] -= self_
            le[a] -= self_
            pair[a] -= r
            pair[:, a] -= le
            pair[a, a] -= self_
            old = _f(pair)
            gain = (_f(pair + r) - old).sum(1) + (_f(pair.T + le) - old.T).sum(1)
            d = np.diag(pair)
            gain += _f(d + r + le + self_) - _f(d + r) - _f(d + le) + _f(d)
            rows, cols = pair.sum(1), pair.sum(0)
            gain -= _f(rows + r.sum() + self_) - _f(rows) + _f(cols + le.sum() + self_) - _f(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pair[b] += r
            pair[:, b] += le
            pair[b, b] += self_
            if b != a:
                moved += 1
                of[u] = b
                right[:, a] -= bigrams[:, u]
                right[:, b] += bigrams[:, u]
                left[:, a] -= bigrams[u]
                left[:, b] += bigrams[u]
        if not moved:
            break
    return of


class Model:
    """Broadcast with the lexicon: classes, log10 transition and emission probabilities, and what the shapes' words share."""

    def __init__(self, lexicon: Lexicon, of: np.ndarray, pair: np.ndarray, unit: np.ndarray, shapes: np.ndarray, total: int, types: int, once: int, twice: int):
        self.lexicon, self.total, self.types = lexicon, total, types
        self.of, self.move = of, _log_move(pair)
        mass, members = np.bincount(of, unit, CLASSES), np.bincount(of, minlength=CLASSES)
        self.emit = np.log10((unit + EVEN) / (mass + EVEN * members)[of])
        #: Absolute discounting within a shape: what is taken from its known words is the unknown word's
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.shape_tokens, self.shape_types = shapes

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.types + 1))

    def word(self, unit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(word | unit): 0 for units of one word."""
        s = np.clip(unit - WORDS, 0, SHAPES - 1)
        n, v = self.shape_tokens[s], self.shape_types[s]
        p = np.where(count > 0, count - self.discount, self.discount * v) / np.maximum(n, 1)
        return np.where((unit < WORDS) | (unit >= END_UNIT), 0.0, np.where(n > 0, np.log10(np.maximum(p, 1e-300)), 0.0))


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs(text), and the table of all word counts that scoring joins with."""
    counts = written(word_counts(docs))
    total, types, once, twice = (x or 0 for x in counts.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first())
    top = counts.orderBy(F.desc("n"), "h").limit(COUNTED).toArrow()
    if top.num_rows == COUNTED and top["n"][-1].as_py() >= PLACED:
        top = counts.where(F.col("n") >= PLACED).toArrow()
    lexicon = Lexicon(top["h"].to_numpy().copy(), top["n"].to_numpy().copy())
    bigrams = unit_bigrams(docs, lexicon)
    of, unit = exchange(bigrams), bigrams.sum(0)
    one = np.eye(CLASSES)[of]
    pair = one.T @ bigrams @ one
    h, c = placed(docs, lexicon, of, pair)
    if len(h):
        _, n, was = lexicon.find(h)
        np.subtract.at(unit, was, n)
        lexicon.place(h)
        of, unit = np.concatenate([of, c]), np.concatenate([unit, n])
        pair = class_bigrams(docs, lexicon, of)
    shape = np.zeros((2, SHAPES))
    tail = counts.where(F.col("h") != END).groupBy(F.col("h").bitwiseAND(SHAPES - 1).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    shape[:, tail["s"].to_numpy()] = tail["n"].to_numpy(), tail["v"].to_numpy()
    alone = (lexicon.unit < WORDS) | (lexicon.unit > END_UNIT)  # their counts are not the shape's
    np.subtract.at(shape[0], lexicon.h[alone] & (SHAPES - 1), lexicon.n[alone])
    np.subtract.at(shape[1], lexicon.h[alone] & (SHAPES - 1), 1)
    return Model(lexicon, of, pair, unit, shape, total, types, once, twice), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, ...): n_tokens, n_known, base_score, score beside docs' other columns but the text.

    Scores are log10 probabilities of the whole text and its end token; a null or empty text is the end token
    alone. Repeated rows are scored each. An empty training set gives every unit equal shares.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    schema = numbered.select(*others, "row").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"), ("rare", ArrayType(LongType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        end_count = m.lexicon.find(np.array([END]))[1][0]
        for batch in batches:
            n = batch.num_rows
            tokens, known, base, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            rare, sizes = [], np.zeros(n, np.int64)
            for i, j, buf, off in blocks(batch["text"]):
                h, row = word_ids(buf, off)
                found, count, unit = m.lexicon.find(h)
                prev, now, of = sequence(unit, row, j - i)
                total[i:j] = np.bincount(of, m.move[m.of[prev], m.of[now]] + m.emit[now], j - i) + np.bincount(row[found], m.word(unit[found], count[found]), j - i)
                base[i:j] = np.bincount(row[found], m.base(count[found]), j - i) + m.base(end_count)
                known[i:j] = np.bincount(row[found], minlength=j - i) + (end_count > 0)
                tokens[i:j] = np.bincount(of, minlength=j - i)
                rare.append(h[~found])
                sizes[i:j] = np.bincount(row[~found], minlength=j - i)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*rare, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*others, "row")), *map(pa.array, (tokens, known, base, total)), lists], names=schema.names)

    parts = written(numbered.mapInArrow(run, schema))
    log10 = lambda a, b: F.log10(a.cast("double") / b)
    n = F.coalesce("n", F.lit(0))
    stats = [(s, float(t), float(v)) for s, (t, v) in enumerate(zip(model.shape_tokens, model.shape_types, strict=True))]
    tokens, types = (F.create_map(*(F.lit(x) for s in stats for x in (s[0], s[k]))) for k in (1, 2))
    shape = F.col("h").bitwiseAND(SHAPES - 1).cast("int")
    looked_up = parts.select("row", F.explode("rare").alias("h")).join(counts, "h", "left").groupBy("row", shape.alias("s"), n.alias("n")).agg(F.count("*").alias("k"))
    of_shape, in_shape = F.element_at(tokens, F.col("s")), F.element_at(types, F.col("s"))
    p = F.when(F.col("n") > 0, F.col("n") - model.discount).otherwise(model.discount * in_shape)
    word = F.when(of_shape > 0, log10(F.greatest(p, F.lit(1e-300)), of_shape)).otherwise(0.0)
    rare = looked_up.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("k"),
        F.sum(F.col("k") * log10(F.col("n") + 1, F.lit(float(model.total + model.types + 1)))).alias("b"),
        F.sum(F.col("k") * word).alias("s"),
    )
    zero = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    out = parts.join(rare, "row", "left")
    return out.select(*others, "n_tokens", (F.col("n_known") + zero("k", 0)).alias("n_known"), (F.col("base_score") + zero("b", 0.0)).alias("base_score"), (F.col("score") + zero("s", 0.0)).alias("score"))


def op2_class_lm(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 7 is not 2. A null doc_id counts as the empty text."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold.alias("held_out"))
    model, counts = fit(docs.where("not held_out"))
    out = score(docs, model, counts)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op2_class_lm": op2_class_lm}
