"""From raw documents to packed training sequences, in stages that are each written and reread.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents.
The stages handle what their operators handle (see those): nulls, empty and very long texts, ties
and repeated rows, empty tables, and more columns, which stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ribospan.llm import language, lines, mixing, packing, simhash
from ribospan.llm.registry import table
from ribospan.llm.tokens import default_tokenizer
from ribospan.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leading language; those without letters or without one are rejected."""
    return language.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals."""
    return lines.dedup_documents(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("source mixing", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

#: A fitted language model and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
