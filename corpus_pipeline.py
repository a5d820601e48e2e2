"""A pipeline over documents: each stage's result is written and read again as the next one's documents.

Every stage takes any columns beside doc_id and text and, but for the last, returns the same ones. Null text counts as
empty, rows of null or repeated doc_id are rows of their own where a stage does not say otherwise, and an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from triplane.llm.common import cut, table
from triplane.llm.exact_dedup import drop_exact_duplicates
from triplane.llm.near_dedup import drop_near_duplicates
from triplane.llm.packing import pack_documents
from triplane.llm.suffix_dedup import drop_repeats
from triplane.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; an empty text is scored like any other."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the largest doc_id; of rows equal in doc_id and text one stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id; texts without words all stay."""
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat: every row stays, what repeats goes out of its text."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; an empty text is one piece of one id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]
#: Classifiers, tokens and packing are not SQL's to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents under ``sf_dir``, each stage on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
