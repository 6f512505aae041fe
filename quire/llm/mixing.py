"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys (MD5 of the identifier), a source's keys are ranges of equal key intervals, at least
``BUCKETS`` and one for each ``PER_BUCKET`` rows of the table, and token counts are prefix-summed in two levels: within
a bucket by a window over its rows, and over the buckets of a source by a window over one row per bucket. So the
hottest source is spread over many tasks. Each source is cut at its exact budget; a budget beyond the source repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import table

BUCKETS, PER_BUCKET = 4096, 1 << 16
MOST_EPOCHS = 3


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(totals: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """totals (source, source_size) with weight and target: sources by code point, null last, weigh 1, 2, 3, repeating.

    Targets share the sum of all sizes by weight; none exceeds ``most`` times its source, and the excess is shared
    again by weight. That ends at the level L at which sum(min(weight * L, cap)) is the whole: with sources by
    cap / weight, those below L are at their cap and the others share the rest. One row per source only.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    x = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    everything = W.partitionBy()
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    x = x.withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("capped", F.col("rest") * F.col("weight") > F.col("cap") * F.col("left"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), "source", "rest", "left"))).over(everything)
    x = x.withColumn("at", level)
    target = F.when(F.col("capped") | F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.col("at.rest") * F.col("weight") / F.col("at.left"))
    return x.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, most: int = MOST_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target, epochs, taken, and the columns of carry.

    taken: the words that the mix takes of the document, whole epochs included: the text epochs times, then its first
    taken - epochs * size words. In the last epoch the document at which the budget (the target, rounded down) ends
    gives the words up to it, so each source's taken words sum to its budget exactly. A null text has no words; null is
    a source of its own; null identifiers sort first; repeated rows count each; an empty table gives an empty result.
    Reruns agree: keys are hashes, ties go by identifier and size. carry: of docs' columns, none named like the others.
    """
    bits = 12
    rows = docs.count()
    while bits < 32 and PER_BUCKET << bits < rows:
        bits += 1
    # null has a source's name of its own, so one exchange by (of, bucket, step) serves windows and join
    d = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("of"), *carry)
    d = d.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("bucket", F.shiftrightunsigned(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    # null identifiers, perhaps a third of all, share a key: there the steps of a bucket are the sizes, in the order of the window
    null_key = F.md5(F.lit("").cast("binary"))
    d = d.withColumn("step", F.when(F.col("key") < null_key, -1).when(F.col("key") == null_key, F.col("size")).otherwise(F.lit(2**62)))
    place = ["of", "bucket", "step"]
    of_bucket = d.groupBy(*place).agg(F.min("source").alias("source"), F.sum("size").alias("bucket_size"))
    targets = source_targets(of_bucket.groupBy("of").agg(F.min("source").alias("source"), F.sum("bucket_size").alias("source_size")).drop("of"), most)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("of"), "source_size", "target")
    over = W.partitionBy("of").orderBy("bucket", "step").rowsBetween(W.unboundedPreceding, -1)
    starts = of_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(over), F.lit(0))).join(targets, "of").select(*place, "before", "source_size", "target")
    within = W.partitionBy(*place).orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, place)
    budget = F.floor("target")
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inside")
    part = F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return d.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *carry)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS lft
      FROM c WINDOW w AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest, lft FROM r WHERE NOT rest * weight > cap * lft ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1),
t AS (SELECT r.source, source_size, CAST(CASE WHEN r.rest * weight > cap * r.lft OR l.rest IS NULL THEN cap ELSE CAST(l.rest * weight AS DOUBLE) / l.lft END AS DOUBLE) AS target FROM r LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p),
mixed AS (SELECT doc_id, source, size, source_size, target, epochs, CAST(epochs * size + greatest(0, least(floor(target) - epochs * source_size - before, size)) AS BIGINT) AS taken FROM m)
"""
ORACLE_SQL = {"op5_mix_sources": "WITH " + MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"}
QUERIES = {"op5_mix_sources": op5_mix_sources}
