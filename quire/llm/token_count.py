"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

The lowest-ranked pair (leftmost of equals) is merged again and again; a word's count is its initial symbols
less its merges, so no identifiers are made. Counts of words are kept in a table per Python worker, of at most
``CACHE`` words (emptied when full), since words repeat. Map-only: the text never leaves its partition.

The vocabulary file's settings that matter: NFC, lower case by code point, words by the pattern below, UTF-8
bytes as symbols, the last one marked as a word's end. Special strings in a text are one token each, and text
around them is treated by itself.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table

CACHE = 1 << 19
LIMIT = 2048


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    out, spare = [], 256
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b if shown else spare))
        spare += not shown
    return out


class Counter:
    """Counts tokens as the library for a word-level byte-pair vocabulary file does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[number(a), number(b)] = (rank, number(a + b))
        shown = byte_symbols()
        vocab = model["vocab"]
        self.first = [number(s) if s in vocab else -1 for s in shown]
        self.last = [number(s + self.end) if s + self.end in vocab else -1 for s in shown]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.seen: dict[str, int] = {}

    def word(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass")
        first = self.first
        sym = [first[b] for b in data[:-1]]
        sym.append(self.last[data[-1]])
        if -1 in sym:
            sym = [s for s in sym if s >= 0]
        n = count = len(sym)
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            p = pairs.get((sym[i], sym[i + 1]))
            if p:
                heap.append((p[0], i, p[1]))
        if not heap:
            return count
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i, made = heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n:
                continue
            p = pairs.get((sym[i], sym[j]))
            if not p or p[0] != rank:  # a neighbour has been merged meanwhile
                continue
            sym[i], sym[j] = made, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                p = pairs.get((made, sym[k]))
                if p:
                    heappush(heap, (p[0], i, p[1]))
            k = before[i]
            if k >= 0:
                p = pairs.get((sym[k], made))
                if p:
                    heappush(heap, (p[0], k, p[1]))
        return count

    def piece(self, text: str) -> int:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # by code point: no final form
        total, seen = 0, self.seen
        for w in self.words.findall(text):
            c = seen.get(w)
            if c is None:
                c = self.word(w)
                if len(w) <= 64:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[w] = c
            total += c
        return total

    def text(self, text: str) -> int:
        if self.split is None or not any(s in text for s in self.special):
            return self.piece(text)
        parts = self.split.split(text)
        return len(parts) - 1 + sum(map(self.piece, parts))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of docs(doc_id, text), in place.

    path: the vocabulary file, at the same place on every executor. Null texts are empty: no bytes, no tokens.
    Any identifier, repeated rows and empty tables pass through; other columns are ignored.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = np.fromiter((count.text(t.as_py() or "") for t in batch["text"]), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_count(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op8_token_count": op8_token_count}
