"""Ordered-document analytics: blocks with offsets, positions and lookups, all as windows, joins and aggregates.

A block table has key, b (0-based order), t. Windows are by document, so a task holds one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights that positions count by: a picture's, and a rule's or an empty block's.
PICTURE_WEIGHT, LEAST_WEIGHT = 400, 1
REACH = 3000


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One block per line: key, b, t."""
    return docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("b", "t"))


def by_block(*keys: str) -> W:
    return W.partitionBy(*(keys or ("key",))).orderBy("b")


def weight(t: Column, k: Column | None = None) -> Column:
    """A block's share of its document: its characters, at least 1; a picture's is fixed."""
    plain = F.greatest(F.lit(LEAST_WEIGHT), F.length(t)).cast("long")
    return plain if k is None else F.when(k == "img", PICTURE_WEIGHT).when(k.isin("hr"), LEAST_WEIGHT).otherwise(plain)


def offsets(blocks: DataFrame) -> DataFrame:
    """Adds w, off (weights before the block) and total."""
    w = blocks.withColumn("w", weight(F.col("t")))
    before = by_block().rowsBetween(W.unboundedPreceding, -1)
    return w.withColumn("off", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("total", F.sum("w").over(W.partitionBy("key")))


def progress(with_offsets: DataFrame, fraction: Column | None = None) -> DataFrame:
    """Adds p: how far into the document the block (and fraction of it) is, 0 to 1."""
    at = F.col("off") + F.col("w") * (fraction if fraction is not None else F.lit(0.0))
    return with_offsets.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), at / F.col("total"))))


def block_at(with_offsets: DataFrame, per_mille: Column) -> DataFrame:
    """key, b: the last block that starts at or before per_mille / 1000 of its document."""
    return with_offsets.where(F.col("off") * 1000 <= per_mille * F.col("total")).groupBy("key").agg(F.max("b").alias("b"))


def as_of(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ord: of the entries (key, ord, b), the last listed of those with the largest b at or before the block's."""
    last = entries.groupBy("key", "b").agg(F.max("ord").alias("e"))
    return blocks.join(last, ["key", "b"], "left").withColumn("ord", F.last("e", True).over(by_block())).drop("e")


def neighbours(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds prev_b and next_b: the nearest entry starts strictly before and after the block."""
    starts = entries.select("key", "b").distinct().withColumn("s", F.col("b"))
    x = blocks.join(starts, ["key", "b"], "left")
    before, after = by_block().rowsBetween(W.unboundedPreceding, -1), by_block().rowsBetween(1, W.unboundedFollowing)
    return x.withColumn("prev_b", F.last("s", True).over(before)).withColumn("next_b", F.first("s", True).over(after)).drop("s")


def nearest(places: DataFrame, blocks: DataFrame, reach: int = REACH) -> DataFrame:
    """places (key, b, x) to key, b, found: the block of text x nearest to b within reach, the earlier of two."""
    other = blocks.select("key", F.col("b").alias("found"), F.col("t").alias("x"))
    near = places.join(other, ["key", "x"]).where(F.abs(F.col("found") - F.col("b")) <= reach)
    first = W.partitionBy("key", "b").orderBy(F.abs(F.col("found") - F.col("b")), "found")
    return near.withColumn("n", F.row_number().over(first)).where("n = 1").select("key", "b", "found")


def islands(blocks: DataFrame, is_in: Column) -> DataFrame:
    """key, first_b, last_b, n of each run of following blocks for which is_in holds."""
    hit = blocks.where(is_in).withColumn("g", F.col("b") - F.row_number().over(by_block()))
    return hit.groupBy("key", "g").agg(F.min("b").alias("first_b"), F.max("b").alias("last_b"), F.count("*").alias("n")).drop("g")


def without_repeats(entries: DataFrame) -> DataFrame:
    """Entries (key, ord, t, b) without those whose (t, b) is that of the one before."""
    w = W.partitionBy("key").orderBy("ord")
    same = F.lag("t").over(w).eqNullSafe(F.col("t")) & F.lag("b").over(w).eqNullSafe(F.col("b")) & (F.row_number().over(w) > 1)
    return entries.withColumn("same", same).where("not same").drop("same")


def entry_ends(entries: DataFrame) -> DataFrame:
    """Adds end_b: the next larger start of the document's entries."""
    starts = entries.select("key", "b").distinct()
    return entries.join(starts.withColumn("end_b", F.lead("b").over(W.partitionBy("key").orderBy("b"))), ["key", "b"])


def reading_order(entries: DataFrame) -> DataFrame:
    """Adds pos: by target block; ties keep the listing's order."""
    return entries.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy("b", "ord")))


def column_widths(cells: DataFrame, least: int = 4, most: int = 36) -> DataFrame:
    """cells (key, col, t) to key, col, width, start: the longest cell of each column within bounds, and what stands left of it."""
    w = cells.groupBy("key", "col").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.max(F.length("t")))).cast("long").alias("width"))
    return w.withColumn("start", F.coalesce(F.sum("width").over(W.partitionBy("key").orderBy("col").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def fold_depths(entries: DataFrame) -> DataFrame:
    """key, depths: listed depths made 0-based with steps of at most one, by a stack of open depths (entries (key, ord, d))."""
    ds = F.transform(F.array_sort(F.collect_list(F.struct("ord", "d"))), lambda x: x["d"])
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        kept = F.filter(acc["stack"], lambda x: x < d)
        return F.struct(F.array_append(kept, d).alias("stack"), F.array_append(acc["out"], F.size(kept)).alias("out"))

    return entries.groupBy("key").agg(ds.cast("array<int>").alias("ds")).select("key", F.aggregate("ds", start, step, lambda acc: acc["out"]).alias("depths"))


def parents(entries: DataFrame) -> DataFrame:
    """Adds parent: ord of the last entry before with a smaller depth d."""
    a, b = entries.alias("a"), entries.select("key", F.col("ord").alias("o"), F.col("d").alias("pd")).alias("b")
    up = a.join(b, "key").where((F.col("o") < F.col("ord")) & (F.col("pd") < F.col("d"))).groupBy("key", "ord").agg(F.max("o").alias("parent"))
    return entries.join(up, ["key", "ord"], "left")


def within_budget(items: DataFrame, count: int, each: int, total: int) -> DataFrame:
    """Of items (key, ord, size), in order: those that still fit. One that does not is skipped and the next is tried."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("size").cast("long").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < count) & (x["size"] <= each) & (acc["sum"] + x["size"] <= total)
        return F.struct(acc["n"] + fits.cast("long"), acc["sum"] + F.when(fits, x["size"]).otherwise(0), F.when(fits, F.array_append(acc["kept"], x["ord"])).otherwise(acc["kept"])).cast("struct<n:bigint,sum:bigint,kept:array<bigint>>")

    return items.groupBy("key").agg(listed.alias("l")).select("key", F.explode(F.aggregate("l", start, step, lambda acc: acc["kept"])).alias("ord"))
