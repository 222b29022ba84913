"""The corpus queries, one for each operator, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ribospan.llm import blocks, fingerprints, language, lines, mixing, nearest, ngram_join, packing, prefix_trie, records, secrets, simhash, turn_repair
from ribospan.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from ribospan.llm.tokens import default_tokenizer


@query()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(table(spark, sf_dir, "pages"))


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


@query(secrets.oracle())
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_report(table(spark, sf_dir, "documents"))


@query(lines.ORACLE)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(table(spark, sf_dir, "documents"))


@query()
def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


@query()
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


@query(mixing.ORACLE)
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query()
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_round_trip(table(spark, sf_dir, "documents"), default_tokenizer())


@query(ngram_join.ORACLE)
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_by_ngrams(table(spark, sf_dir, "documents"))


@query(prefix_trie.ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query(turn_repair.ORACLE)
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))
