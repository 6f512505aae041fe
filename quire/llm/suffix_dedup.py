"""Removal of repeated 100-byte strings with per-shard suffix arrays.

Only places that may repeat reach a suffix array. Each 100-byte window has an anchor, its smallest-hashed
``GRAM``-byte string (leftmost of equals), so equal windows have equal anchors at equal places. A context is the
bytes that the windows of one anchor cover. Occurrences of equal (anchor, context) beyond the first are repeated
whole: within a batch at once, across batches by a sort of the batches' first ones. What is left are anchors with
several contexts, which are sharded by content: by the anchor, or, where an anchor has more than ``SHARD_CONTEXTS`` of
them, by the bytes that all windows of a zone of ``ZONE`` places around the anchor cover. So equal windows are in one
shard, however many contexts an anchor has; zones that share these bytes with no other one hold no repeat and are left out. Each shard's text gets a suffix array by Larsson-Sadakane refinement (only
groups not yet sorted are sorted, by twice the depth, until none is left), common prefixes by Kasai's rule in all
contexts at once, and from these the classes of equal windows. Where a zone's bytes too are in more than
``SHARD_CONTEXTS`` different places, these are dealt over several shards; each puts out its distinct windows
as a sorted run of 128-bit fingerprints, and the runs are merged one after another: each window of a run is looked up in
what is merged so far by binary search.

All judge the input: a window counts as repeated if it also starts earlier (smaller doc_id, or same document).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import SALT, Rolling, Scratch, among, arrays, blocks, given_id, mix, parted, pieces, sieve, signed, table, text_digest, with_id

LENGTH, GRAM, ZONE = 100, 24, 10
SHARD_CONTEXTS, SHARD_BYTES, PIECE = 1024, 1 << 21, 1 << 23
_SECOND = mix(SALT)


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: row, start in the row, windows, anchor hash, context hash, and how far the anchor is from the start."""
    n, span = len(buf), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    roll = Rolling(buf, SALT)
    g = roll.windows(GRAM)
    low = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])[: n - LENGTH + 1]
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(np.diff(off) >= LENGTH)
    edge = np.zeros(n + 2, np.int64)
    edge[off[long]] += 1
    np.subtract.at(edge, off[long + 1] - LENGTH + 1, 1)
    valid = np.cumsum(edge)[: len(at)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    p = at[a]
    row = np.searchsorted(off, a, "right") - 1
    context = mix(roll.of(a, b + LENGTH) + (p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, a - off[row], b - a + 1, g[p], context, p - a


def batch_anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch: row, start, windows, anchor, context, whether a smaller (doc_id, start) of the batch has the same two, place of the anchor."""
    parts = []
    for i, _, buf, off in blocks(batch["text"]):
        row, start, n, h, c, lead = anchors(buf, off)
        parts.append((row + i, start, n, h, c, lead))
    row, start, n, h, c, lead = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
    ids = batch["doc_id"].to_numpy()[row]
    order = np.argsort(mix(h) + c, kind="stable")
    key = (mix(h) + c)[order]
    alike = np.zeros(len(key) + 1, bool)
    alike[1:-1] = key[1:] == key[:-1]
    several = np.flatnonzero(alike[1:] | alike[:-1])  # only these need their order by place
    part = order[several]
    order[several] = part[np.lexsort((start[part], ids[part], c[part], h[part], key[several]))]
    row, start, n, h, c, ids, lead = (x[order] for x in (row, start, n, h, c, ids, lead))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return row, start, n, h, c, (ids != ids[head]) | (start != start[head]), lead


def firsts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, "text", PIECE)):
            row, start, n, h, c, again, _ = batch_anchors(batch)
            keep = ~again
            ids = batch["doc_id"].to_numpy()[row[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[keep])), pa.array(signed(c[keep])), pa.array(ids), pa.array(start[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32))], names=["h", "c", "doc_id", "start", "n"])

    return docs.mapInArrow(run, "h long, c long, doc_id long, start int, n int")


def zones(buf: np.ndarray, base: np.ndarray, start: np.ndarray, n: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows cut by the distance of the window from its anchor: of each part its run, start, windows, key and fingerprint.

    base: first byte in buf; lead: the anchor's distance from the first window. The windows of a zone all cover the same
    LENGTH + 1 - ZONE bytes, at the same distance from the anchor; the key is of these.
    """
    last, first = lead // ZONE, (lead - n + 1) // ZONE
    many = last - first + 1
    of = np.repeat(np.arange(len(n)), many)
    zone = last[of] - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    far, near = np.minimum(lead[of], ZONE * zone + ZONE - 1), np.maximum((lead - n + 1)[of], ZONE * zone)
    skip = lead[of] - far
    roll = Rolling(buf, SALT)
    core = base[of] + lead[of] - ZONE * zone
    key = mix(roll.of(core, core + LENGTH + 1 - ZONE) + zone.astype(np.uint64))
    size = far - near + 1
    return of, start[of] + skip, size, key, roll.of(base[of] + skip, base[of] + skip + size - 1 + LENGTH)


_READ = ["key", "c", "doc_id", "start", "n", "bytes"]


def second_reading(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Of the anchors in frequent(h, contexts) the contexts or, if they are many, their zones: key, c (a zone's fingerprint), doc_id, start, n, bytes.

    Rows without bytes are spans that repeat within their batch.
    """
    known, wide = sieve(frequent, "h"), sieve(frequent.where(F.col("contexts") > SHARD_CONTEXTS), "h")
    shared = docs.sparkSession.sparkContext.broadcast((known, wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wide = shared.value
        for batch in (p for b in batches for p in pieces(b, "text", PIECE)):
            row, start, n, h, _, again, lead = batch_anchors(batch)
            ids = batch["doc_id"].to_numpy()
            order = np.flatnonzero(again)
            order = order[np.lexsort((start[order], row[order]))]
            r, s, e = row[order], start[order], start[order] + n[order] - 1 + LENGTH
            new = np.ones(len(r), bool)  # windows of neighbouring anchors follow each other
            new[1:] = (r[1:] != r[:-1]) | (s[1:] > e[:-1])
            at = np.flatnonzero(new)
            ends = e[np.concatenate([at[1:], [len(e)]]).astype(np.int64) - 1] if len(at) else e
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(ids[r[at]]), pa.array(s[at].astype(np.int32)), pa.array((ends - s[at] - LENGTH + 1).astype(np.int32)), pa.nulls(len(at), pa.binary())], names=_READ)
            buf, off = arrays(batch["text"])
            base = off[row] + start
            some = np.flatnonzero(~again & known.has(h)) if len(h) else np.zeros(0, np.int64)
            hot = wide.has(h[some]) if len(some) else np.zeros(0, bool)
            keep = some[~hot]
            data = [buf[b : b + k - 1 + LENGTH].tobytes() for b, k in zip(base[keep], n[keep], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[keep])), pa.nulls(len(keep), pa.int64()), pa.array(ids[row[keep]]), pa.array(start[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), pa.array(data, pa.binary())], names=_READ)
            keep = some[hot]
            if not len(keep):
                continue
            of, s, k, key, c = zones(buf, base[keep], start[keep], n[keep], lead[keep])
            doc = ids[row[keep]][of]
            by = np.lexsort((s, doc, c, key))
            first = np.ones(len(by), bool)
            first[1:] = (key[by[1:]] != key[by[:-1]]) | (c[by[1:]] != c[by[:-1]])
            data = np.full(len(by), None, object)
            for i in by[first]:
                b = base[keep][of[i]] + s[i] - start[keep][of[i]]
                data[i] = buf[b : b + k[i] - 1 + LENGTH].tobytes()
            same = np.zeros(len(by), bool)  # an equal part of one place only
            head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
            same[by] = ~first & (doc[by] == doc[head]) & (s[by] == s[head])
            at = np.flatnonzero(~same)
            whole = np.array([x is not None for x in data[at]], bool)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key[at]), mask=~whole), pa.array(signed(c[at]), mask=~whole), pa.array(doc[at]), pa.array(s[at].astype(np.int32)), pa.array(k[at].astype(np.int32)), pa.array(data[at], pa.binary())], names=_READ)

    return docs.mapInArrow(run, "key long, c long, doc_id long, start int, n int, bytes binary")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes in order. Sorted wholly, past LENGTH too: Kasai's rule holds in a full order only."""
    n = len(text)
    wide = np.concatenate([text.astype(np.uint64) & np.uint64(0xFFFF), np.zeros(4, np.uint64)])
    key = (wide[:n] << np.uint64(48)) | (wide[1 : n + 1] << np.uint64(32)) | (wide[2 : n + 2] << np.uint64(16)) | wide[3 : n + 3]
    order = np.argsort(key)  # equal keys stay one group, so no sort here need be stable
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 4
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        todo = np.flatnonzero(~alone)  # places of groups that are not sorted yet
        if not len(todo):
            break
        i = order[todo]
        key = rank[i] * (n + 1) + rank[np.minimum(i + h, n)] + 1
        by = np.argsort(key)
        i, key = i[by], key[by]
        order[todo] = i
        split = np.ones(len(i), bool)
        split[1:] = key[1:] != key[:-1]
        new[todo] = split
        rank[i] = todo[np.maximum.accumulate(np.where(split, np.arange(len(i)), 0))]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to most, that each suffix shares with the one before it in order: Kasai's rule, in step in all pieces (start, length)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int32), np.full(most + 1, -1, np.int32)])
    by = np.argsort(-length, kind="stable")
    start, length = start[by], length[by]
    common = np.zeros(len(start), np.int64)
    for j in range(int(length.max()) if len(length) else 0):
        k = int(np.searchsorted(-length, -j, "left"))  # pieces longer than j
        i = start[:k] + j
        q = before[i]
        common = np.maximum(common[:k] - 1, 0)
        common[q < 0] = 0
        live = np.flatnonzero((q >= 0) & (common < most))
        while len(live):
            x, y = i[live] + common[live], q[live] + common[live]
            live = live[(padded[x] == padded[y]) & (padded[x] >= 0)]
            common[live] += 1
            live = live[common[live] < most]
        out[i] = common
    return out


def _shard(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(rows).combine_chunks()
    t = t.to_batches()[0]
    text, off = arrays(t["bytes"])
    ids, start = t["doc_id"].to_numpy(), t["start"].to_numpy()
    # of equal contexts the first one speaks for all: the others' windows are known to repeat
    one, two = (Rolling(text, x).of(off[:-1], off[1:]) for x in (SALT, _SECOND))
    by = np.lexsort((start, ids, two, one))
    head = np.ones(len(by), bool)
    head[1:] = (one[by[1:]] != one[by[:-1]]) | (two[by[1:]] != two[by[:-1]])
    t = t.take(pa.array(np.sort(by[head])))
    text, off = arrays(t["bytes"])
    ids, start, n, wide = (t[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "n", "wide"))
    # a sign of its own ends each context, so no match runs on into the next
    pieces_ = np.arange(len(n))
    signs = np.insert(text.astype(np.uint32) + 1, off[1:], (257 + pieces_ % 65000).astype(np.uint32))
    begin = off[:-1] + pieces_
    order = suffix_array(signs)
    shared = common_prefixes(signs, order, begin, np.diff(off) + 1, LENGTH)[order]
    kind = np.cumsum(shared < LENGTH)  # class of equal LENGTH-byte prefixes, in order
    piece = np.repeat(pieces_, np.diff(off) + 1)[order]
    inside = order - begin[piece]
    own = inside < n[piece]
    kind, piece, place, byte = kind[own], piece[own], (start[piece] + inside)[own], (off[piece] + inside)[own]
    doc = ids[piece]
    by = np.lexsort((place, doc, kind))
    kind, piece, place, byte, doc = (x[by] for x in (kind, piece, place, byte, doc))
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0))
    again = (doc != doc[head]) | (place != place[head])
    yield _runs(doc[again], place[again])
    rep = first & wide[piece]
    roll = [Rolling(text, s).of(byte[rep], byte[rep] + LENGTH) for s in (SALT, _SECOND)]
    yield pa.RecordBatch.from_arrays([pa.array(signed(roll[0])), pa.array(signed(roll[1])), pa.array(doc[rep]), pa.array(place[rep].astype(np.int32)), pa.array(np.ones(rep.sum(), np.int32))], names=_OUT)


_OUT = ["f1", "f2", "doc_id", "start", "n"]
_FOUND = "f1 long, f2 long, doc_id long, start int, n int, run long"


def _runs(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Window starts as runs of n following ones."""
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(doc)]]).astype(np.int64) - 1
    n = place[ends] - place[at] + 1 if len(at) else place
    return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(doc[at]), pa.array(place[at].astype(np.int32)), pa.array(n.astype(np.int32))], names=_OUT)


def shard_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard key; whole keys are gathered to suffix arrays of about SHARD_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        key = batch["key"].to_numpy()
        bytes_ = arrays(batch["bytes"])[1]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            same = held and held[-1]["key"][-1].as_py() == key[lo]
            if size >= SHARD_BYTES and not same:
                yield from _numbered(held)
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += int(bytes_[hi] - bytes_[lo])
    if held:
        yield from _numbered(held)


def _numbered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's rows with its number, the first key."""
    key = held[0]["key"][0].as_py()
    for batch in _shard(held):
        yield batch.append_column("run", pa.array(np.full(batch.num_rows, key)))


def merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of window fingerprints, block by block of the fingerprints' space: the places of windows that a smaller place has too.

    Rows come by (block, run, f1, f2). Each run is merged into those before it: its windows are looked up by binary search.
    A block is a 4096th of a partition's windows, so what is held is bounded by the partition.
    """
    none = np.zeros(0, np.int64)
    block, held = None, (none,) * 4
    for batch in batches:
        blocks_, run = batch["block"].to_numpy(), batch["run"].to_numpy()
        cuts = [0, *(np.flatnonzero((blocks_[1:] != blocks_[:-1]) | (run[1:] != run[:-1])) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if blocks_[lo] != block:
                block, held = blocks_[lo], (none,) * 4
            f1, f2, doc, place = (batch[c].to_numpy()[lo:hi].astype(np.int64) for c in _OUT[:4])
            h1, h2, hdoc, hplace = held
            at = np.searchsorted(h1, f1)
            found = np.zeros(len(f1), bool)
            todo = np.flatnonzero(at < len(h1))
            while len(todo):  # past windows that share the first half only
                todo = todo[h1[at[todo]] == f1[todo]]
                ok = h2[at[todo]] == f2[todo]
                found[todo[ok]] = True
                todo = todo[~ok]
                at[todo] += 1
                todo = todo[at[todo] < len(h1)]
            i = at[found]
            d, p = doc[found], place[found]
            later = (d > hdoc[i]) | ((d == hdoc[i]) & (p > hplace[i]))
            sooner = (d < hdoc[i]) | ((d == hdoc[i]) & (p < hplace[i]))
            yield _runs(np.concatenate([d[later], hdoc[i][sooner]]), np.concatenate([p[later], hplace[i][sooner]]))
            hdoc[i[sooner]], hplace[i[sooner]] = d[sooner], p[sooner]
            new = ~found
            to = np.searchsorted(h1, f1[new])
            held = tuple(np.insert(x, to, y[new]) for x, y in zip(held, (f1, f2, doc, place), strict=True))


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, start, end of byte spans that cover each repeated string of docs(doc_id, text not null); spans may overlap."""
    first = F.first(F.struct("doc_id", "start"))
    here = lambda *key: first.over(W.partitionBy(*key).orderBy("doc_id", "start"))
    # a repeated row needs its place only, a first one its anchor only: the other columns stay null and take no room
    seen = firsts(docs).withColumn("again", here("h", "c") != F.struct("doc_id", "start")).select(F.when(~F.col("again"), F.col("h")).alias("h"), *(F.when(F.col("again"), F.col(c)).alias(c) for c in ("doc_id", "start", "n")))
    seen = scratch.written(seen)
    frequent = scratch.written(seen.where("h is not null").groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    both = scratch.written(second_reading(docs, frequent))
    ends = lambda df: df.select("doc_id", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("end"))
    spans = ends(seen.where("doc_id is not null")).union(ends(both.where("bytes is null")))
    # zones: equal ones beyond the first are repeated; keys that have many different ones go to several shards
    parts = both.where("c is not null").select("key", "c", "doc_id", "start", "n").withColumn("again", here("key", "c") != F.struct("doc_id", "start"))
    parts = scratch.written(parts)
    equal = parts.where("again")
    keys = scratch.written(parts.where("not again").groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    wide = keys.where(F.col("contexts") > SHARD_CONTEXTS)
    # the windows of a zone differ, and equal windows have equal keys: where a key has one zone there is nothing more to find
    zoned = among(both.where("bytes is not null and c is not null").drop("c"), keys, ["key"])
    place = ["key", "doc_id", "start"]
    zoned = scratch.written(zoned.join(equal.select(place), place, "left_anti"))
    shards = F.ceil(F.lit(wide.agg(F.max("contexts")).first()[0] or 1) / SHARD_CONTEXTS)
    many, few = parted(zoned, wide, ["key"])
    many = many.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("doc_id", "start"), shards)))
    contexts = both.where("bytes is not null and c is null").drop("c").unionByName(few).withColumn("wide", F.lit(False)).unionByName(many.withColumn("wide", F.lit(True)))
    found = scratch.written(contexts.repartition("key").sortWithinPartitions("key").mapInArrow(shard_classes, _FOUND))
    block = F.shiftrightunsigned("f1", 52).alias("block")
    across = found.where("f1 is not null").select(block, "run", "f1", "f2", "doc_id", "start").repartition("block").sortWithinPartitions("block", "run", "f1", "f2").mapInArrow(merge_shards, "f1 long, f2 long, doc_id long, start int, n int")
    return spans.union(ends(equal)).union(ends(found.where("f1 is null"))).union(ends(across))


def _rows(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """docs with doc_id as a number of its own for each text of an identifier, in the order of identifiers; and the table back to them.

    Only where identifiers repeat or are null; else docs as they are.
    """
    several = docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    if several.isEmpty():
        return docs, None
    keyed = docs.withColumn("digest", text_digest())
    texts = scratch.written(keyed.select("doc_id", "digest").distinct().repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("part", F.spark_partition_id()))
    sizes, before = dict(texts.groupBy("part").count().collect()), {}  # one row a partition
    for part in sorted(sizes):
        before[part] = sum(sizes[p] for p in before)
    in_order = W.partitionBy("part").orderBy("doc_id", "digest")
    base = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    ranks = scratch.written(texts.withColumn("rank", base[F.col("part")] + F.row_number().over(in_order)).drop("part"))
    return scratch.written(keyed.join(ranks, ["doc_id", "digest"]).select(F.col("rank").cast("long").alias("doc_id"), "text")), ranks.select("doc_id", F.col("rank").cast("long").alias("rank"))


def remove_repeats(docs: DataFrame, kept: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (the remaining bytes).

    Texts are UTF-8 bytes, null is empty; a text below LENGTH bytes keeps all. A null doc_id counts as the
    smallest. Different texts of one doc_id (or of none) are documents of their own, in the order of their digests; rows
    that repeat doc_id and text are one document: what is removed from one is removed from all. Other columns are
    ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    docs, back = _rows(docs.select(with_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), scratch)
    spans = repeated(docs, scratch).groupBy("doc_id").agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = arrays(batch["text"])
            rows = []
            for k, (s, e) in enumerate(zip(batch["s"], batch["e"], strict=True)):
                data = buf[off[k] : off[k + 1]]
                size, gone, runs = len(data), 0, 0
                if s.is_valid and len(s):
                    edge = np.zeros(size + 1, np.int64)
                    np.add.at(edge, np.minimum(s.values.to_numpy(), size), 1)
                    np.subtract.at(edge, np.minimum(e.values.to_numpy(), size), 1)
                    out = np.cumsum(edge)[:-1] > 0
                    gone = int(out.sum())
                    runs = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                    data = data[~out]
                left = data.tobytes()
                rows.append((size, gone, runs, hashlib.sha256(left).hexdigest(), *([left] if kept else [])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds) + 1])

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if kept else 4]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")
    out = docs.join(spans, "doc_id", "left").mapInArrow(run, schema)
    if back is not None:
        out = out.withColumnRenamed("doc_id", "rank").join(back, "rank").select("doc_id", *out.columns[1:])
    return scratch.done(out)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), kept=False)
    return out.select(given_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
