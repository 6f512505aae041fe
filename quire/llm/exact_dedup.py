"""Exact deduplication by a tree-merge of sorted digest runs.

A text's digest is the SHA-256 of its UTF-8 bytes after lower-casing A-Z. The map side writes one run per
lane (a lane is a hash of the identifier), with one row per digest: so a digest that a third of all rows
share is one row per lane. Runs are exchanged in binomial rounds of radix ``RADIX``: in round r, the lanes
that differ in digit r only form a tree node; each hands the part of its run whose digest has another digit
r to the sibling responsible, and each sibling merges the sorted parts, keeping the best identifier and the
number of rows. After the last round a digest lives in one lane. Decisions flow back along (digest, lane),
which is as even as the lanes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, given_id, lower_ascii, parted, table, text_digest, with_id, without, written

RADIX, ROUNDS = 8, 2
LANES = RADIX**ROUNDS
RUN = "node int, digest binary, keep_id long, n long, n_bytes long"


def merge_runs(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, digest) to one row for each: the smallest (largest) identifier and the sum of n.

    Works on a stream of any batch size: the last group of a batch is carried into the next one. Rows of one
    digest must agree on the byte length, else the digest is not proof of equality and the job fails.
    """
    carry: pa.RecordBatch | None = None
    best = np.maximum if largest else np.minimum
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        node = batch["node"].to_numpy()
        digest = batch["digest"].cast(pa.binary(32))
        words = np.frombuffer(digest.buffers()[1], np.uint64)[digest.offset * 4 : (digest.offset + len(digest)) * 4].reshape(-1, 4)
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (words[1:] != words[:-1]).any(1)
        at = np.flatnonzero(new)
        size = batch["n_bytes"].to_numpy()
        if (np.maximum.reduceat(size, at) != np.minimum.reduceat(size, at)).any():
            raise ValueError("two texts of different lengths share a SHA-256 digest")
        merged = pa.RecordBatch.from_arrays(
            [batch["node"].take(pa.array(at)), batch["digest"].take(pa.array(at)), pa.array(best.reduceat(batch["keep_id"].to_numpy(), at)), pa.array(np.add.reduceat(batch["n"].to_numpy(), at)), pa.array(size[at])],
            names=["node", "digest", "keep_id", "n", "n_bytes"],
        )
        carry = merged.slice(merged.num_rows - 1)
        yield merged.slice(0, merged.num_rows - 1)
    if carry is not None:
        yield carry


def tree_merge(runs: DataFrame, largest: bool) -> DataFrame:
    """runs (lane, digest, keep_id, n, n_bytes) to one row per digest."""
    for r in range(ROUNDS):
        # digit r of the lane gives way to digit r of the digest; the other digits stay
        digit = F.pmod(F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 3 * r), F.lit(RADIX)).cast("int")
        here, step = (F.col("lane") / F.lit(RADIX**r)).cast("int") % RADIX, RADIX**r
        sent = runs.select((F.col("lane") + (digit - here) * step).cast("int").alias("node"), "digest", "keep_id", "n", "n_bytes")
        # one lane may be many partitions: the exchange is by lane and digest, runs stay sorted within
        runs = sent.repartition("node", "digest").sortWithinPartitions("node", "digest").mapInArrow(lambda it: merge_runs(it, largest), RUN).withColumnRenamed("node", "lane")
    return runs.drop("lane")


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, n_bytes, keep_id, group_size, kept.

    keep: "smallest" or "largest" identifier of equal texts. Null texts equal the empty text. A null identifier
    counts as below all others. Of repeated rows of one identifier and text all have kept = true or none; other
    columns of docs are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    return scratch.done(_groups(docs, keep == "largest", scratch))


def _groups(docs: DataFrame, largest: bool, scratch: Scratch) -> DataFrame:
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    hashed = docs.select(with_id().alias("doc_id"), text_digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).withColumn("lane", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(LANES)).cast("int"))
    hashed = scratch.written(hashed)
    pick = F.max if largest else F.min
    runs = hashed.groupBy("lane", "digest", "n_bytes").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("n"))
    merged = scratch.written(tree_merge(runs, largest))
    shared = merged.where("n > 1").select("digest", "keep_id", "n")
    # back along the lanes: only digests of several rows travel, one row for each lane that holds them
    lanes = runs.select("lane", "digest").join(shared, "digest")
    out = hashed.join(lanes, ["lane", "digest"], "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (keep_id == F.col("doc_id")).alias("kept"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"), "largest")
    return out.select(given_id(), given_id("keep_id"), "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text, A-Z lower-cased, a row of a smaller identifier has.

    A row goes by its identifier and its text, so another text of the same identifier stays. Repeated rows of one
    identifier and text stay once; a null identifier is one identifier, below all others.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    scratch = Scratch(docs.sparkSession)
    # of the rows of the identifier that stays, the text with the smallest digest stays
    groups = scratch.written(_groups(docs, False, scratch).where("group_size > 1").select("doc_id", F.unhex("text_sha256").alias("same"), "kept").distinct())
    keyed = docs.select(with_id().alias("doc_id"), "text")
    rows = parted(keyed, groups, ["doc_id"])[0].select("doc_id", text_digest(lower_ascii(raw)).alias("same"), text_digest().alias("digest")).groupBy("doc_id", "same", "digest").agg(F.count("*").alias("n"))
    rows = scratch.written(rows.join(groups, ["doc_id", "same"]))
    stays = rows.where("kept").groupBy("doc_id", "same").agg(F.min("digest").alias("digest"))
    gone = written(rows.join(stays, ["doc_id", "same", "digest"], "left_anti").select("doc_id", "digest"))
    again = written(rows.join(stays, ["doc_id", "same", "digest"], "left_semi").where("n > 1").select("doc_id", "digest"))
    scratch.clear()
    out = without(docs, gone)
    if again.isEmpty():
        return out
    rest = without(out, again)
    key = ["quire id", "quire digest"]
    again = again.select(F.col("doc_id").alias("quire id"), F.col("digest").alias("quire digest"))
    may = parted(out.withColumn("quire id", with_id()), again, ["quire id"])[0].withColumn("quire digest", text_digest())
    once = may.join(again, key, "left_semi").dropDuplicates(key)
    return rest.union(once.select(docs.columns))


ORACLE_SQL = {
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d"""
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
