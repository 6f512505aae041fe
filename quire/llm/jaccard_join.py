"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct word shingles. Equal sets are one document from here on. Sets
are ordered by (frequency level, hash): shingles counted as frequent come last; any order that all sets share is
right, so the table of frequent shingles may be bounded. Two sets that link share a shingle in their prefixes, at
positions that leave room for the overlap they need. Documents of equal prefix and size are one group.

A passage that some documents share gives each of its shingles the same list of documents, so lists of equal
members are one list from then on, with each member's first position in it. A group of thousands of near copies
would make the square of its size in pairs. So candidates come in rounds of stars: each document is compared with
its group's first member and with one leader, the document that stands first in most of the prefix entries they share;
the links found give components, and documents are compared with their other lists' leaders in other components. Then
every pair of the remaining candidates whose ends lie in different components is compared, whole. A link between
documents that are connected already would not change a component, so none is lost. A pair that shares many
lists leaves few of them: each document's lists are in the order of their positions, and a list does not put out a pair
that has one of the ``BEFORE`` lists before it in common as well. The first list that two documents share always puts them out.

Comparisons first bound the overlap by the histograms of both sets, of a cell for ``LOAD`` hashes, then intersect the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import SALT_LOWER, Rolling, Scratch, anti, blocks, components, given_id, lane, lane_groups, mix, parted, sieve, signed, table, text_digest, with_id, without, words

LOAD, HEAVY, LOCAL, BEFORE = 4, 1 << 18, 4, 8


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the distinct shingles of a block, sorted by row; fewer words than width make one shingle."""
    start, end, row = words(buf, off)
    h = Rolling(buf, SALT_LOWER).of(start, end)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    step = np.uint64(0x9DDFEA08EB382D69)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    m = max(len(h) - width + 1, 0)
    s = np.zeros(m, np.uint64)
    for k in range(width):
        s = s * step + h[k : k + m]
    whole = row[:m] == row[width - 1 : width - 1 + m]
    out, of = [mix(s[whole])], [row[:m][whole]]
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        s = np.full(len(short), n, np.uint64)
        for k in range(n):
            s = s * step + h[first[short] + k]
        out.append(mix(s + np.uint64(n)))
        of.append(short)
    value, of = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new]


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to HEAVY shingles of the most documents, sorted, and the level (log2) of each. Counted where LOCAL documents of a batch share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shingles(buf, off, width)[0] for _, _, buf, off in blocks(batch["text"])]
            h, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[n >= LOCAL])), pa.array(n[n >= LOCAL])], names=["h", "n"])

    top = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], np.log2(n[order]).astype(np.uint64)


def histograms(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of n hashes each: 16-bit counts by the first bits of the hash, a power of two of cells for each row, and where its bytes end."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(n / LOAD, 1))).astype(np.int64), 5)
    begin = np.concatenate([[0], np.cumsum(1 << bits)])
    cell = begin[row] + (h >> (64 - bits[row]).astype(np.uint64)).astype(np.int64)
    return np.bincount(cell, minlength=begin[-1]).astype(np.uint16), 2 * begin


def most_common(x: bytes, y: bytes) -> tuple[int, int]:
    """Of two sets' histograms: at most so many hashes are in both, at least so many in either."""
    a, b = np.frombuffer(x, np.uint16).astype(np.int64), np.frombuffer(y, np.uint16).astype(np.int64)
    cells = min(len(a), len(b))
    both = int(np.minimum(a.reshape(cells, -1).sum(1), b.reshape(cells, -1).sum(1)).sum())
    return both, int(a.sum() + b.sum()) - both


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (of the whole set), prefix, cells (histogram) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, level = shared.value
        names = ["doc_id", "n", "s1", "s2", "prefix", "cells"]
        for batch in batches:
            for i, j, buf, off in blocks(batch["text"]):
                rows = j - i
                h, row = shingles(buf, off, width)
                n = np.bincount(row, minlength=rows)
                begin = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(x)))]) for x in (0x51, 0xA3)]
                s1, s2 = (signed(s[begin[1:]] - s[begin[:-1]]) for s in sums)
                lev = np.zeros(len(h), np.uint64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    lev = np.where(heavy[at] == h, level[at], lev)
                order = np.lexsort((h, lev, row))
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                rank = np.arange(len(h)) - begin[row]
                cells, ends = histograms(h, row, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"][i:j], pa.array(n), pa.array(s1), pa.array(s2),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(signed(h[order][rank < length[row]]))),
                        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cells)]),
                    ],
                    names=names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>, cells binary")


def shared_tokens(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """id, n, p (position), t of the prefix entries of reps, but for those that only one prefix has: most of them.

    The counting pass deals out tokens alone. What it finds is a fixed-size sieve, which lets others pass but loses none.
    """
    often = scratch.written(reps.select(F.explode("prefix").alias("t")).groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t"))
    shared = reps.sparkSession.sparkContext.broadcast(sieve(often, "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = batch["prefix"].offsets.to_numpy().astype(np.int64)
            t = batch["prefix"].values.to_numpy()[off[0] : off[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            keep = np.flatnonzero(shared.value.has(t.copy()))
            of = row[keep]
            p = (keep - (off[of] - off[0])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(of)), batch["n"].take(pa.array(of)), pa.array(p), pa.array(t[keep])], names=["id", "n", "p", "t"])

    return reps.select("id", "n", "prefix").mapInArrow(run, "id long, n long, p int, t long")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and sorted whole set of those rows of docs whose doc_id is in ids(id); read again from the text, not stored."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.value.has(batch["doc_id"].to_numpy().copy())))
            for i, j, buf, off in blocks(batch["text"]):
                h, row = shingles(buf, off, width)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(h)))], names=["id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, set array<long>")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those pairs (a, b) that link, a table. Repeated identifiers (rows of equal doc_id) are compared each."""
    pairs = scratch.written(pairs)
    ids = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [100 * both >= percent * either for both, either in map(most_common, batch["ca"].to_pylist(), batch["cb"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (xo, xv), (yo, yv) = ((batch[c].offsets.to_numpy(), batch[c].values.to_numpy().view(np.uint64)) for c in ("sa", "sb"))
            for k in range(batch.num_rows):
                x, y = xv[xo[k] : xo[k + 1]], yv[yo[k] : yo[k + 1]]
                both = _overlap(x, y)
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    cells = parted(reps.select("id", "cells"), ids, ["id"])[0]
    near = pairs.join(cells.withColumnsRenamed({"id": "a", "cells": "ca"}), "a").join(cells.withColumnsRenamed({"id": "b", "cells": "cb"}), "b")
    near = scratch.written(near.mapInArrow(bound, "a long, b long").distinct())
    sets = sets_of(docs, near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    # b first: it is the side that few pairs share; a (a leader) may be in many, whose join splits
    full = near.join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b").join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a")
    return scratch.written(full.mapInArrow(whole, "a long, b long").distinct())


def _room(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether two sets of sizes n with a first common shingle at positions p can link."""
    need = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Sets of shingles of width words (A-Z lower-cased; fewer words: the sequence as one) link when
    100 * |both| >= percent * |either|. Null, empty and blank texts have no set and link with nothing. A null
    identifier counts as the smallest and comes back as null; rows of one identifier are told apart by their sets
    only. Other columns are ignored. Empty tables give empty results.
    """
    docs = docs.select(with_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(sketches(docs, width, percent).withColumn("lane", lane("doc_id", "s1")))
    key = ["n", "s1", "s2"]
    full = rows.where("n > 0")
    lanes, groups = lane_groups(full, key, "doc_id")
    copies = scratch.written(lanes.join(groups.select(*key, "first"), key))
    # only rows that may have copies meet them in a join, with their prefixes
    may, alone = parted(full, copies, ["s1"])
    firsts = may.join(copies, ["lane", *key], "left").where("first is null or first = doc_id").dropDuplicates(["doc_id", "lane", *key])
    rep = [F.col("doc_id").alias("id"), "lane", "n", "prefix", "cells"]
    reps = alone.select(rep).union(scratch.written(firsts.select(rep)))
    # groups of equal size and prefix, named by their first member
    grouped = reps.select("id", "lane", F.xxhash64("n", "prefix").alias("g"))
    g_lanes, g_groups = lane_groups(grouped, ["g"], "id")
    g_first = scratch.written(g_lanes.join(g_groups.select("g", "first"), "g"))
    members = scratch.written(grouped.join(g_first, ["lane", "g"]).select("id", F.col("first").alias("gid")))
    inside = members.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    others = members.where("id <> gid").select("id").distinct()
    entries = scratch.written(shared_tokens(anti(reps, others, ["id"]), scratch))
    # lists of the same documents are one list; should two different ones share its number, it has the pairs of both
    sign = F.xxhash64("id", F.lit(1)).bitwiseAND((1 << 31) - 1)
    numbers = entries.groupBy("t").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(sign).alias("y")).where("k > 1").select("t", F.xxhash64("k", "x", "y").alias("l"))
    lists = scratch.written(entries.join(numbers, "t").groupBy("l", "id", "n").agg(F.min("p").alias("p"), F.count("*").alias("w")))
    leaders = lists.groupBy("l").agg(F.min(F.struct("p", "id", "n")).alias("first"), F.count("*").alias("k")).where("k > 1")
    lists = scratch.written(lists.join(leaders.select("l", F.col("first.id").alias("lid"), F.col("first.p").alias("lp"), F.col("first.n").alias("ln")), "l"))
    star = scratch.written(lists.where((F.col("id") != F.col("lid")) & _room(F.col("n"), F.col("p"), F.col("ln"), F.col("lp"), percent)).groupBy("lid", "id").agg(F.sum("w").alias("w")))
    best = star.groupBy("id").agg(F.max_by("lid", F.struct("w", -F.col("lid"))).alias("a"))
    first_round = scratch.written(inside.union(best.select("a", F.col("id").alias("b"))))
    links = verified(first_round, reps, docs, width, percent, scratch)
    labels = components(links, scratch)
    c = lambda df, i, name: df.join(labels.withColumnsRenamed({"id": i, "c": name}), i, "left").withColumn(name, F.coalesce(name, i))
    # the other leaders of each document
    second_round = scratch.written(c(c(star.select(F.col("lid").alias("a"), F.col("id").alias("b")), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b").join(first_round, ["a", "b"], "left_anti"))
    if not second_round.isEmpty():
        links = links.union(verified(second_round, reps, docs, width, percent, scratch))
        labels = components(links, scratch)
    # what is left: pairs of groups of which neither leads, or that have more members than the leaders have met
    of_member = c(members, "id", "c")
    of_group = of_member.groupBy("gid").agg(F.min("c").alias("c1"), F.max("c").alias("c2"))
    ranged = lists.join(of_group.withColumnRenamed("gid", "id"), "id", "left").withColumn("several", F.col("c1").isNotNull()).withColumn("leads", F.col("id") == F.col("lid"))
    ranged = scratch.written(c(ranged, "id", "own").withColumn("c1", F.coalesce("c1", "own")).withColumn("c2", F.coalesce("c2", "own")).drop("own", "lid", "lp", "ln", "w"))
    mixed = ranged.groupBy("l").agg(F.min("c1").alias("lo"), F.max("c2").alias("hi"), F.count("*").alias("k"), F.bool_or("several").alias("s")).where("lo <> hi and (k > 2 or s)").select("l")
    before = F.collect_list("l").over(W.partitionBy("id", "n").orderBy("p", "l").rowsBetween(-BEFORE, -1))
    open_ = scratch.written(ranged.join(mixed, "l").withColumn("before", before))
    x, y = (open_.select("l", *(F.col(k).alias(k + s) for k in ("id", "n", "p", "c1", "c2", "several", "leads", "before"))) for s in ("x", "y"))
    apart = (F.col("c1x") != F.col("c2x")) | (F.col("c1y") != F.col("c2y")) | (F.col("c1x") != F.col("c1y"))
    order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("idx") < F.col("idy")))
    unmet = F.col("severalx") | F.col("severaly") | ~(F.col("leadsx") | F.col("leadsy"))
    # positions before p leave more room, so a pair that passes here passes there too, or met there as leader and member
    new = ~F.arrays_overlap("beforex", "beforey")
    met = x.join(y, "l").where(order & apart & unmet & _room(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"), percent) & new)
    heads_left = scratch.written(met.select(F.col("idx").alias("gx"), F.col("idy").alias("gy")).distinct())
    all_members = of_member.select("gid", "id", "c")
    ends = lambda df, g, i, name: df.join(all_members.withColumnsRenamed({"gid": g, "id": i, "c": name}), g, "left").withColumn(i, F.coalesce(i, g))
    cross = ends(ends(heads_left, "gx", "a", "ca"), "gy", "b", "cb").select("a", "b")
    within = all_members.join(of_group.where("c1 <> c2").select("gid"), "gid", "left_semi")
    within = within.select("gid", F.col("id").alias("a"), F.col("c").alias("ca")).join(within.select("gid", F.col("id").alias("b"), F.col("c").alias("cb")), "gid").where("a < b and ca <> cb").select("a", "b")
    left = c(c(cross.union(within).distinct(), "a", "ca"), "b", "cb").where("ca <> cb")
    left = scratch.written(left.join(first_round, ["a", "b"], "left_anti").select("a", "b"))
    if not left.isEmpty():
        labels = components(links.union(verified(left, reps, docs, width, percent, scratch)), scratch)
    # back to all rows, along the lanes
    named = c(reps.select("id"), "id", "c").select("id", "c").distinct()
    of_copies = copies.join(named, copies["first"] == named["id"], "left").select("lane", *key, F.coalesce("c", "first").alias("component"))
    single = rows.select("doc_id", "lane", *key).join(of_copies, ["lane", *key], "left").join(labels.withColumnsRenamed({"id": "doc_id", "c": "own"}), "doc_id", "left")
    return scratch.done(single.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "own", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = similar(table(spark, sf_dir, "documents"), 4, 85)
    return out.select(given_id(), "n_shingles", given_id("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group only (five words, similarity 0.8): that of the smallest identifier.

    A row goes by its identifier and its text, so another text of the same identifier, or of a null one, which counts as
    the smallest, is judged by itself. Repeated rows of one identifier and text stay or go together; of equal texts
    of one group, that of the smallest identifier stays. Columns are as they were.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    ids = scratch.written(docs.select(key.alias("key"), with_id().alias("doc_id"), text_digest().alias("digest")).distinct())
    groups = similar(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("c")).distinct()
    several = scratch.written(groups.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c"))
    rows = scratch.written(groups.join(several, "c").join(ids, "key"))
    # should two texts share a key, both stay: which of them has the copy is not known
    alone = rows.groupBy("key").agg(F.count("*").alias("k")).where("k = 1").select("key")
    first = rows.groupBy("c").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    gone = rows.join(alone, "key").join(first, "c").where(F.struct("doc_id", "digest") != F.col("first")).select("doc_id", "digest")
    gone = scratch.done(gone)
    return without(docs, gone)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op9_jaccard_join": op9_jaccard_join}
