"""A corpus pipeline of five stages; each is one operator, and each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import mixing, ngram_join, packing, passage_dedup, quality
from loomline.llm.common import table, written
from loomline.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, all columns whatever their names. Null and empty texts are
    one empty line; every repeat of a row, and rows with a null doc_id, are judged alike. An empty table stays empty."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, all columns whatever their names. Rows with
    a null doc_id and texts without words stay; of rows of one doc_id with words, one. An empty table stays empty."""
    return ngram_join.first_of_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; documents of which nothing stays go. Null and blank texts,
    and rows with a null doc_id, stay as they are; rows of one doc_id take nothing from one another. Other columns stay,
    but for n_chars, which follows the text. An empty table stays empty."""
    return passage_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, all columns whatever their names. Null and blank texts go; a
    null source is one of the sources, the last; each repeat of a row is taken on its own account. An empty table stays
    empty."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. A null or empty text is its end id alone; repeats and null doc_ids are packed like
    others; further columns are left out. An empty table gives no pieces."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near copies", keep_first), ("passages", drop_passages), ("mixing", mix), ("packing", pack)]

#: SQL can't express the first stage and the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
