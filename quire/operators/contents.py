"""Contents, links and saved places: resolution, trees, and what a reader resumes at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import lower
from quire.operators import sequence as S


def resolve(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (key, id, name, fragment) with b of their target, null where dead.

    anchors (key, name, fragment, b): the first of equal ones counts; an empty fragment is the start of a document. A
    fragment is looked up as it is, then in lower case, and then the start of its document is the target.
    """
    exact = anchors.groupBy("key", "name", "fragment").agg(F.min("b").alias("b1"))
    folded = anchors.groupBy("key", "name", lower(F.col("fragment")).alias("low")).agg(F.min("b").alias("b2"))
    starts = anchors.where("fragment = ''").groupBy("key", "name").agg(F.min("b").alias("b3"))
    x = links.withColumn("low", lower(F.col("fragment"))).join(exact, ["key", "name", "fragment"], "left").join(folded, ["key", "name", "low"], "left").join(starts, ["key", "name"], "left")
    return x.withColumn("b", F.coalesce("b1", "b2", "b3")).drop("b1", "b2", "b3", "low")


def labels_open(entries: DataFrame) -> DataFrame:
    """entries (key, ord, d, b): a label without a target opens at the entry after it that has one, if that is deeper. key, ord, b."""
    listed = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("d").cast("int").alias("d"), F.col("b").cast("long").alias("b")))))
    item = "struct<ord:bigint,d:int,b:bigint>"
    start = F.struct(F.lit(None).cast(item).alias("next"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        b = F.coalesce(x["b"], F.when(acc["next"]["d"] > x["d"], acc["next"]["b"]))
        now = F.struct(x["ord"].alias("ord"), x["d"].alias("d"), b.alias("b"))
        return F.struct(F.when(b.isNotNull(), now).otherwise(acc["next"]).cast(item).alias("next"), F.array_append(acc["out"], now).alias("out")).cast(f"struct<next:{item},out:array<{item}>>")

    done = entries.groupBy("key").agg(listed.alias("l")).select("key", F.explode(F.aggregate("l", start, step, lambda acc: acc["out"])).alias("e"))
    return done.select("key", F.col("e.ord").alias("ord"), F.col("e.b").alias("b"))


def paths(entries: DataFrame, between: str = " › ") -> DataFrame:
    """entries (key, ord, d, t): key, ord, path, the titles from the outermost entry down to this one."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("d").cast("int").alias("d"), F.col("t").alias("t"))))
    kind = "struct<stack:array<struct<ord:bigint,d:int,t:string>>,out:array<struct<ord:bigint,path:string>>>"
    start = F.struct(F.array().cast("array<struct<ord:bigint,d:int,t:string>>").alias("stack"), F.array().cast("array<struct<ord:bigint,path:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stack = F.array_append(F.filter(acc["stack"], lambda o: o["d"] < x["d"]), x)
        path = F.array_join(F.transform(stack, lambda o: o["t"]), between)
        return F.struct(stack.alias("stack"), F.array_append(acc["out"], F.struct(x["ord"].alias("ord"), path.alias("path"))).alias("out")).cast(kind)

    done = entries.groupBy("key").agg(listed.alias("l")).select("key", F.explode(F.aggregate("l", start, step, lambda acc: acc["out"])).alias("e"))
    return done.select("key", F.col("e.ord").alias("ord"), F.col("e.path").alias("path"))


def with_children(entries: DataFrame) -> DataFrame:
    """Adds branch: whether the next entry lies deeper."""
    return entries.withColumn("branch", F.coalesce(F.lead("d").over(W.partitionBy("key").orderBy("ord")) > F.col("d"), F.lit(False)))


def page_starts(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    """Of starts (key, b), those that open a page: not the first block's, and not right after a heading. blocks (key, b, k)."""
    before = blocks.withColumn("was", F.lag("k").over(S.by_block()))
    return before.join(starts.select("key", "b").distinct(), ["key", "b"], "left_semi").where((F.col("b") > 0) & ~F.col("was").eqNullSafe("h")).select("key", "b")


def relocate(places: DataFrame, blocks: DataFrame, reach: int = S.REACH) -> DataFrame:
    """places (key, b, p per mille, x) to key, found, how: where reading goes on in blocks (key, b, t, x).

    "kept": the block has the remembered x. "moved": the nearest with it to where p says, the earlier of two. "share": the
    block at p. "last": the block of that number, or the last.
    """
    at = S.offsets(blocks)
    last = at.groupBy("key").agg(F.max("b").alias("last"))
    pl = places.join(last, "key")
    by_share = at.join(pl.where("p > 0").select("key", "p"), "key").where("off * 1000 <= p * total").groupBy("key").agg(F.max("b").alias("share"))
    pl = pl.join(by_share, "key", "left").withColumn("guess", F.coalesce("share", F.least("b", "last")))
    same = blocks.select("key", F.col("b").alias("found"), "x")
    near = pl.join(same, ["key", "x"]).where((F.abs(F.col("found") - F.col("guess")) <= reach) | (F.col("found") == F.col("b")))
    best = near.groupBy("key").agg(F.bool_or(F.col("found") == F.col("b")).alias("kept"), F.min(F.when(F.abs(F.col("found") - F.col("guess")) <= reach, F.struct(F.abs(F.col("found") - F.col("guess")).alias("n"), "found"))).alias("m"))
    x = pl.join(best, "key", "left")
    found = F.when(F.col("kept"), F.col("b")).otherwise(F.coalesce("m.found", "share", F.least("b", "last")))
    how = F.when(F.col("kept"), "kept").when(F.col("m").isNotNull(), "moved").when(F.col("share").isNotNull(), "share").otherwise("last")
    return x.select("key", found.alias("found"), how.alias("how"))


def remembered(books: DataFrame, places: DataFrame) -> DataFrame:
    """books (key, path, title) with the place (t) saved under their key, else the newest of the same path and title, whatever its case."""
    tidy = lower(F.trim("title"))
    own = places.groupBy("key").agg(F.max("t").alias("t1"))
    other = places.where("path <> ''").groupBy("path", tidy.alias("name")).agg(F.max("t").alias("t2"))
    x = books.withColumn("name", tidy).join(own, "key", "left").join(other, ["path", "name"], "left")
    return x.withColumn("t", F.coalesce("t1", "t2")).drop("name", "t1", "t2")


def superseded(places: DataFrame) -> DataFrame:
    """places (key, path, title, t) after all saves: the newest of each key, and of those of one path and title the newest."""
    newest = places.groupBy("key").agg(F.max_by(F.struct("path", "title", "t"), F.struct("t", "path")).alias("p")).select("key", "p.*")
    named = newest.where("path <> ''").groupBy("path", lower(F.trim("title")).alias("name")).agg(F.max_by("key", F.struct("t", "key")).alias("key"))
    return newest.join(named.select("key"), "key", "left_semi").unionByName(newest.where("path = ''"))


def capped_levels(headings: DataFrame, most: int) -> DataFrame:
    """headings (key, b, l) without the deepest levels, as many as it takes to have most at most; the first level stays."""
    n = headings.groupBy("key", "l").agg(F.count("*").alias("n"))
    upto = n.withColumn("upto", F.sum("n").over(W.partitionBy("key").orderBy("l"))).withColumn("first", F.min("l").over(W.partitionBy("key")))
    return headings.join(upto.where((F.col("upto") <= most) | (F.col("l") == F.col("first"))).select("key", "l"), ["key", "l"], "left_semi")


def reusable(files: DataFrame, index: DataFrame) -> DataFrame:
    """files (path, size, mtime) with good: whether index (path, size, mtime, key) holds them unchanged under a key."""
    known = index.where("key <> ''").select("path", "size", "mtime").distinct().withColumn("good", F.lit(True))
    return files.join(known, ["path", "size", "mtime"], "left").withColumn("good", F.coalesce("good", F.lit(False)))


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the last in order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def matching(entries: DataFrame, said: str) -> DataFrame:
    """key, ord, t and path (the entries above, outermost first) of entries (key, ord, d, t) whose titles hold all words of said, in any case."""
    terms = said.lower().split()
    found = entries.select("key", "ord", "t").join(paths(entries), ["key", "ord"])
    above = F.substr("path", F.lit(1), F.greatest(F.lit(0), F.length("path") - F.length("t") - 3))
    for term in terms:
        found = found.where(F.lower("t").contains(term))
    return found.select("key", "ord", "t", above.alias("path"))
