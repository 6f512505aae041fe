"""Rules over whole block tables (key, b, k, t): long blocks, section gaps, indents, running heads, titles before prose, contents.

Windows and aggregates are by document or by section of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import split as X
from quire.functions import titles as T
from quire.functions.text import small_batches

WORDS = ("p", "h", "li")
MIN_ENTRIES = 3


def cut_long(blocks: DataFrame) -> DataFrame:
    """blocks (key, b, k, t, f, m) with long ones in pieces, numbered anew: key, b, k, t, f, m, c (1: goes on from the block before).

    A heading too long for one is a paragraph. Later pieces of a list item have an empty marker.
    """
    kind = F.when((F.col("k") == "h") & (F.length(F.regexp_replace("t", "&#?[a-z0-9]+;", "x")) > X.TEXT), "p").otherwise(F.col("k"))
    x = small_batches(blocks).withColumn("k", kind).withColumn("f", F.coalesce("f", F.lit(0)))
    # only what is too long goes through Python
    short = F.length("t") <= F.when(F.col("k") == "pre", X.PRE).otherwise(X.TEXT)
    kept = x.where(F.coalesce(short, F.lit(False)) | ~F.col("k").isin(*WORDS, "pre")).withColumn("i", F.lit(0))
    long = x.where(~F.coalesce(short, F.lit(True)) & F.col("k").isin(*WORDS, "pre")).select("key", "b", "k", "m", F.posexplode(X.pieces("t", "k", "f")).alias("i", "p"))
    out = kept.select("key", "b", "i", "k", "t", "f", "m").unionByName(long.select("key", "b", "i", "k", "p.t", "p.f", "m"))
    order = W.partitionBy("key").orderBy("b", "i")
    goes_on = (F.col("i") > 0) & F.col("k").isin(*WORDS)
    return out.select("key", (F.row_number().over(order) - 1).alias("b"), "k", "t", "f", F.when(goes_on & (F.col("k") == "li"), "").otherwise(F.col("m")).alias("m"), F.when(goes_on, 1).alias("c"))


def section_gaps(blocks: DataFrame) -> DataFrame:
    """Adds s: 2 on the first block of each section (key, section), if it has words."""
    first = F.min("b").over(W.partitionBy("key", "section"))
    return blocks.withColumn("s", F.when((F.col("b") == first) & F.col("k").isin(*WORDS), 2))


def calm_indent(blocks: DataFrame) -> DataFrame:
    """blocks (key, section, k, i, a) with i less what all running text of a section is indented by (four paragraphs or more)."""
    of = W.partitionBy("key", "section")
    body = F.when((F.col("k") == "p") & F.col("a").isNull(), F.coalesce("i", F.lit(0)))
    shared = F.when(F.count(body).over(of) >= 4, F.min(body).over(of))
    x = blocks.withColumn("shared", shared)
    calmed = F.when(F.col("i") > F.col("shared"), F.col("i") - F.col("shared"))
    return x.withColumn("i", F.when((F.col("shared") > 0) & F.col("k").isin(*WORDS), calmed).otherwise(F.col("i"))).drop("shared")


def spaced_titles(blocks: DataFrame) -> DataFrame:
    """key, b, t of lines in spaced capitals that a document has once and that are no piece of a running head, nor one with its page number."""
    said = F.regexp_replace("t", r"\P{L}", "")
    x = blocks.where(T.spaced_capitals(F.col("t"))).select("key", "b", "t", said.alias("said"))
    counts = x.groupBy("key", "t", "said").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    heads = counts.where("n > 1").groupBy("key").agg(F.collect_set("said").alias("heads"))

    def is_head(h: Column) -> Column:
        at = F.instr(F.col("said"), h)
        rest = F.concat(F.substr("said", F.lit(1), at - 1), F.substr("said", at + F.length(h)))
        return h.contains(F.col("said")) | (F.col("said").contains(h) & rest.rlike(r"\A[IO]*\z"))

    once = counts.where("n = 1").join(heads, "key", "left")
    return once.where(~F.coalesce(F.exists("heads", is_head), F.lit(False))).select("key", "b", "t")


def titles_before_prose(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Those of found (key, b) whose next block is an unaligned paragraph or list item (k, a) and not found itself."""
    w = W.partitionBy("key").orderBy("b")
    x = blocks.select("key", "b", "k", "a").join(found.select("key", "b").distinct().withColumn("is", F.lit(True)), ["key", "b"], "left")
    after = F.lead(F.struct("k", "a", "is")).over(w)
    x = x.withColumn("after", after).where("is and after.is is null and after.k in ('p', 'li') and after.a is null")
    return x.select("key", "b")


def chosen_contents(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """key, chosen: the list of entries (key, list, b) that a document's contents are made of.

    Lists are declared, headings, sections, likes (headings and title-like lines) and numbered (all sections).
    targets (key, dead, targeted) says how many declared entries lead nowhere. Declared contents of three places stay
    unless most are dead; then the first list of three places that says more, else the better of what there is.
    """
    count = lambda name: F.count_if(F.col("list") == name).alias(name)
    names = ("declared", "headings", "sections", "likes", "numbered")
    n = entries.select("key", "list", "b").distinct().groupBy("key").agg(*map(count, names))
    x = targets.join(n, "key", "left").na.fill(0, list(names))
    places = F.greatest("headings", "sections")
    structure = F.when(F.col("headings") >= F.col("sections"), "headings").otherwise("sections")
    better = lambda c: F.when(F.col("declared") < MIN_ENTRIES, c > F.col("declared")).otherwise(c >= MIN_ENTRIES)
    whole = lambda c: (c >= MIN_ENTRIES) & better(c)
    likes, numbered = F.col("likes"), F.col("numbered")
    good = (F.col("declared") >= MIN_ENTRIES) & (F.col("dead") * 2 <= F.col("targeted"))
    chosen = F.when(good, "declared").when(whole(places), structure).when(whole(likes), "likes").when(whole(numbered), "numbered")
    return x.select("key", chosen.when(better(places), structure).when(better(likes), "likes").otherwise("declared").alias("chosen"))


def own_words(lines: DataFrame, start: str, end: str, search: int = 1000) -> DataFrame:
    """key, first, past: lines (key, b, t) between a start marker among the first and an end marker among the last of a document; all without a start."""
    n = lines.groupBy("key").agg(F.max("b").alias("last"), F.min(F.when((F.col("b") < search) & F.col("t").rlike(start), F.col("b"))).alias("at"))
    ends = lines.where(F.col("t").rlike(end)).select("key", "b")
    past = n.join(ends, "key").where((F.col("b") > F.greatest("at", F.col("last") + 1 - search))).groupBy("key").agg(F.max("b").alias("past"))
    return n.join(past, "key", "left").select("key", F.coalesce(F.col("at") + 1, F.lit(0)).alias("first"), F.when(F.col("at").isNotNull(), F.coalesce("past", F.col("last") + 1)).otherwise(F.col("last") + 1).alias("past"))
