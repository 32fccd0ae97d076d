"""A corpus pipeline: quality, near duplicates, repeated passages, source mix, tokens.

Each stage takes all that the one before kept, returns the columns of documents (all but the last), whatever their names,
and gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, mix, neardup, quality, substring
from tidemill.llm.common import cut
from tidemill.llm.queries import VOCABULARY, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and vote model keep, repeated rows included. Null, empty and short texts go; null keys and
    sources don't matter. The model is fitted to all documents given."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least key. Rows with one key stay or go by their own texts,
    rows without a key stay."""
    return neardup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document with a smaller key has; ``n_chars`` is counted anew. Rows with
    one key don't clean each other, rows without a key are left as they are, null texts come back empty. No row goes."""
    return substring.clean(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, none to three times. A null source is a source of its own; rows with
    one key are drawn alike."""
    return mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document, one row for each row given; null and empty texts have no tokens."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The vote model and merge ranks are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
