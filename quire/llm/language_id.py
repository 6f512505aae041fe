"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is a sequence of lower-cased letters; whatever is no letter is one separator symbol. Its 1- to 3-grams
are hashed into ``BUCKETS``. Training counts buckets by language over all labelled rows, as sums that combine
on the map side; the log-probability matrix (languages x BUCKETS, float32) is broadcast. Its size is bounded by
``MOST_LANGS`` x BUCKETS x 4 bytes = 32 MB; more languages than that fail loudly. Scoring gathers the matrix at
the sparse positions of a block of texts and sums by text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import blocks, bounded, mix, table

BUCKETS, ORDERS, MOST_LANGS = 1 << 15, (1, 2, 3), 256
UNDETERMINED = "und"
SMOOTH = 0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 where it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and rows of all n-grams of a block, and which rows have a letter."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    if at[-1] != len(points):  # bytes that are no UTF-8: each text by itself
        parts = [np.frombuffer(buf[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
        points, at = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    low = _letters()[points]
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    lettered = np.bincount(row[low > 0], minlength=len(off) - 1) > 0
    keep = np.ones(len(low), bool)  # runs of separators are one
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0) | (row[1:] != row[:-1])
    low, row = low[keep].astype(np.uint64), row[keep]
    out, rows = [], []
    for n in ORDERS:
        m = max(len(low) - n + 1, 0)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + low[k : k + m]
        whole = row[:m] == row[n - 1 : n - 1 + m]
        if n == 1:
            whole &= low[:m] > 0
        out.append((mix(h[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        rows.append(row[:m][whole])
    return np.concatenate(out), np.concatenate(rows), lettered


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and float32 log-probabilities (languages + the prior's row, BUCKETS): of docs(text, lang) with neither null."""
    bounded(docs.sparkSession)
    langs = sorted(r[0] for r in docs.where("lang is not null and text is not null").select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    code = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * (BUCKETS + 1), np.int64)  # the last column counts texts
        for batch in batches:
            which = np.array([code[x] for x in batch["lang"].to_pylist()], np.int64)
            for i, j, buf, off in blocks(batch["text"]):
                g, row, _ = grams(buf, off)
                total += np.bincount(which[i:j][row] * (BUCKETS + 1) + g, minlength=len(total))
            total += np.bincount(which * (BUCKETS + 1) + BUCKETS, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    model = np.zeros((len(langs), BUCKETS + 1))
    if langs:
        cells = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        model.ravel()[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    texts, model = model[:, -1:], model[:, :-1] + SMOOTH
    logs = np.log(model / model.sum(1, keepdims=True)) if langs else model
    prior = np.log((texts + 1) / (texts + 1).sum()) if langs else texts
    return langs, np.concatenate([logs, np.broadcast_to(prior, (len(langs), 1))], axis=1).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (posterior, 0 to 1), map-only. Null texts and texts with no letter are ``und`` with score 0."""
    langs, table_ = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table_))
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in fields]
    schema = docs.select(names).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            best, score, has = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for i, j, buf, off in blocks(batch["text"]):
                if not langs:
                    break
                g, row, lettered = grams(buf, off)
                sums = np.stack([np.bincount(row, weights=w[g], minlength=j - i) for w in logs]) + logs[:, -1:]
                best[i:j], top = sums.argmax(0), sums.max(0)
                score[i:j] = np.where(lettered, 1 / np.exp(sums - top).sum(0), 0)
                has[i:j] = lettered
            named = pa.array([langs[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), named, pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.select(names).mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 4 is not 2. A null doc_id counts as the empty text."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold.alias("held_out"))
    model = fit(docs.where("not held_out").select("text", "lang"))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those rejected: no letter at all, or no language with a posterior of ``least``; columns as they were."""
    model = fit(docs.select("text", "lang"))
    named = predict(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c in ("lang_pred", "score")}), model)
    kept = named.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"in_lang_pred": "lang_pred", "in_score": "score"}).select(docs.columns)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op7_language_id": op7_language_id}
