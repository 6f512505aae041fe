"""Positions and running sums over whole tables, without a task that holds all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Jumps of 2^k edges are made up to this k; 2^40 places are more than any table has.
MOST_JUMPS = 40


def written(df: DataFrame) -> DataFrame:
    """df as a table under spark.checkpoint.dir (a temporary folder only where that is unset and the master is local, as in tests)."""
    base, master = df.sparkSession.conf.get("spark.checkpoint.dir", None), df.sparkSession.conf.get("spark.master", "")
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, by: list[Column], size: Column | None = None) -> DataFrame:
    """Adds pos (1-based, over all rows, in the order of by), before (sum of size over earlier rows) and whole (over all).

    Rows are dealt by ranges of by, and the deal is written, so that both passes see the same one; each range is a task. What
    earlier ranges hold is one row per range, which is what is broadcast. by should end with something unique.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("size_", (F.lit(0) if size is None else F.coalesce(size, F.lit(0))).cast("long"))
    dealt = written(dealt.repartitionByRange(ranges, *by).withColumn("range_", F.spark_partition_id()))
    each = dealt.groupBy("range_").agg(F.count("*").alias("n_"), F.sum("size_").alias("s_"))
    earlier = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    each = each.select("range_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("n_"), F.coalesce(F.sum("s_").over(earlier), F.lit(0)).alias("s_"), F.sum("s_").over(W.partitionBy()).alias("whole"))
    inside = W.partitionBy("range_").orderBy(*by)
    out = dealt.join(F.broadcast(each), "range_").withColumn("pos", (F.row_number().over(inside) + F.col("n_")).cast("long"))
    before = F.coalesce(F.sum("size_").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("s_")
    return out.withColumn("before", before).drop("range_", "size_", "n_", "s_")


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """id, hops of all that seeds (id) reach along edges (a, b), hops being the least, in rounds that are each a written table.

    In each round the last round's finds go along all edges, so there are no more rounds than hops; and all finds jump
    2^k times along one edge of each place, k growing while that finds anything, so a chain takes the logarithm of its length.
    """
    edges = written(edges.select("a", "b"))
    jumps, k = [written(edges.groupBy("a").agg(F.min("b").alias("b")))], 0
    found = written(seeds.select("id").distinct().select("id", F.lit(0).cast("long").alias("hops"), F.lit(True).alias("new"), F.lit(False).alias("far")))
    none = F.lit(None).cast("long")
    while True:
        near = found.where("new").join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id"), none.alias("old"), none.alias("jumped"), (F.col("hops") + 1).alias("hops"))
        far = found.join(jumps[k], F.col("id") == F.col("a")).select(F.col("b").alias("id"), none.alias("old"), (F.col("hops") + 2**k).alias("jumped"), (F.col("hops") + 2**k).alias("hops"))
        said = found.select("id", F.col("hops").alias("old"), none.alias("jumped"), "hops").unionByName(near).unionByName(far)
        best = said.groupBy("id").agg(F.min("hops").alias("hops"), F.min("old").alias("old"), F.min("jumped").alias("jumped"))
        new = F.col("old").isNull() | (F.col("hops") < F.col("old"))
        found = written(best.select("id", "hops", new.alias("new"), (new & F.coalesce(F.col("jumped") == F.col("hops"), F.lit(False))).alias("far")))
        any_new, any_far = found.agg(F.max("new"), F.max("far")).first()
        if not any_new:
            return found.select("id", "hops")
        k = (k + 1) % MOST_JUMPS if any_far else 0
        if k == len(jumps):
            to = jumps[-1].select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumps.append(written(jumps[-1].join(to, "b").select("a", F.col("c").alias("b"))))
