"""The catalogue: fingerprints, duplicates, incremental refresh, search, order and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lower
from quire.operators.order import running

SALTS = 32


def content_key(text: Column) -> Column:
    """20 hex digits of the SHA-1 of the size and the bytes."""
    t = F.coalesce(text, F.lit(""))
    return F.substring(F.sha1(F.concat(F.octet_length(t).cast("string"), F.lit("\n"), t).cast("binary")), 1, 20)


def first_of_key(files: DataFrame, key: str, path: str) -> DataFrame:
    """Adds keeper: the smallest path of its key. Aggregated first by a salt of the path, so a key of many copies is no single task."""
    salted = files.withColumn("salt", F.pmod(F.xxhash64(path), F.lit(SALTS)))
    part = salted.groupBy(key, "salt").agg(F.min(path).alias("m"))
    best = part.groupBy(key).agg(F.min("m").alias("keeper"))
    return salted.join(part.select(key, "salt").join(best, key), [key, "salt"]).drop("salt")


def refresh(files: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """Files that the previous index does not hold."""
    return files.join(index, on, "left_anti")


def search(query: str, *columns: Column) -> Column:
    """Whether each blank-separated term of query is in the columns, whatever the case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for term in query.lower().split():
        out &= F.contains(hay, F.lit(term))
    return out


def title_key(t: Column) -> Column:
    """The list's sort key: lower case, no leading article."""
    return F.regexp_replace(lower(F.trim(t)), "^(the|an|a) +", "")


def recency(books: DataFrame, reads: DataFrame) -> DataFrame:
    """books (key, title, path) with t (last read, 0 for never) and pos: last read first, then title, then path, missing ones last, then key."""
    t = F.coalesce("t", F.lit(0)).cast("long")
    x = books.join(reads.groupBy("key").agg(F.max("t").alias("t")), "key", "left").withColumn("t", t)
    return running(x, [F.desc("t"), title_key(F.col("title")).asc_nulls_last(), F.asc_nulls_last("path"), F.col("key")]).drop("before", "whole")


def prune(entries: DataFrame, limit: int | Column) -> DataFrame:
    """entries (key, opened, size): those to drop, oldest first, until the rest is within limit (may use whole, the sum of sizes)."""
    most = limit if isinstance(limit, Column) else F.lit(limit)
    x = running(entries, [F.col("opened"), F.col("key")], F.col("size")).withColumn("kept", F.col("whole") - F.col("before"))
    return x.where(F.col("kept") > most).drop("whole", "before", "pos")


def folder_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Of roots (ord, root), how many paths lie below each; roots are a short list, compared by prefix."""
    return roots.join(paths, F.startswith(paths["path"], F.concat(roots["root"], F.lit("/"))), "left").groupBy("ord", "root").agg(F.count("path").alias("n"))


def file_title(path: Column) -> Column:
    """A title from a file's name: no folder, no known extension, separators as blanks."""
    name = F.regexp_replace(path, r"^.*/", "")
    bare = F.regexp_replace(name, r"(?i)\.(fb2\.zip|epub|mobi|azw3?|prc|fb2|txt|md|html?|xhtml|cbz|zip)$", "")
    return F.trim(F.regexp_replace(bare, r"[_\s]+", " "))


def natural_name(author: Column) -> Column:
    """"Last, First" as "First Last"; names with more than one comma or none stay."""
    one = F.length(author) - F.length(F.replace(author, F.lit(","), F.lit(""))) == 1
    swapped = F.concat_ws(" ", F.trim(F.element_at(F.split(author, ","), 2)), F.trim(F.element_at(F.split(author, ","), 1)))
    return F.when(one & author.rlike(r",\s*\S"), swapped).otherwise(author)


def shorten(t: Column, most: int) -> Column:
    """One line of at most most characters, an ellipsis for the rest."""
    line = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…"))).otherwise(line)


def percent_label(p: Column) -> Column:
    """Nothing at the start, whole percent after, never 100 before the end."""
    n = F.floor(p * 100 + 0.5)
    return F.when(p.isNull() | (p <= 0), "").when(p >= 1, "100%").otherwise(F.concat(F.greatest(F.lit(1), F.least(F.lit(99), n)).cast("string"), F.lit("%")))
