"""A corpus pipeline: stages over documents, each of them one operator, each result a Parquet table that the next reads.

1. language: texts without letters and of no sure language go. 2. exact copies: the smallest identifier stays.
3. near copies (five words, similarity 0.8): one document of each group stays. 4. documents that hold an item of
the benchmark go. 5. mixing: the documents of which the mix takes words, with their texts and how often they are
taken (epochs, and taken words in all: the text epochs times, then its first taken - epochs * size words).

Rows go by identifier and text, so null and repeated identifiers are judged row by row; a row that repeats both stays
once (stage 2). Null texts and texts without letters go in stage 1; so do all texts where no row has a language to
learn from. Very long texts are read whole. Further columns are kept as they are. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table, written
from quire.llm.decontaminate import without_leaks
from quire.llm.exact_dedup import drop_copies
from quire.llm.jaccard_join import one_of_each
from quire.llm.language_id import known_language
from quire.llm.mixing import mix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = {"size", "source_size", "target", "epochs", "taken"}
    carried = {c: f"in_{c}" if c in new else c for c in docs.columns if c not in ("doc_id", "source")}
    return mix(docs.withColumnsRenamed(carried), carry=tuple(carried.values())).where("taken > 0")


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("decontaminated", decontaminated), ("mixed", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage before it reads what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
