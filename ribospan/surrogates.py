"""Inputs of the domain derived from the general-purpose test tables.

Sequences are whole document texts: letters are mapped onto bases and cut into
consecutive windows of 101, the last one shorter. Nothing is filtered or capped.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
WINDOW_ID_STEP = 1_000_000
WINDOW_LETTERS = 101
ROWS_AT_ONCE = 1 << 15
#: The base of each byte of a text, 0 for what is no letter.
_BASE_OF = np.zeros(256, np.uint8)
for _letter, _base in zip(LETTERS, BASES, strict=True):
    _BASE_OF[[ord(_letter), ord(_letter.upper())]] = ord(_base)

# The helpers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tiled(found):
    """``doc_id, rbp, cell, w, seq`` of the windows of a batch of texts: its letters in one pass, then cut by offsets."""
    for batch in found:
        text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        bases = _BASE_OF[raw]
        kept = np.concatenate([[0], np.cumsum(bases > 0)])[ends - ends[0]]
        bases, sizes = bases[bases > 0], np.diff(kept)
        many = -(-sizes // WINDOW_LETTERS)
        doc = np.repeat(np.arange(len(sizes)), many)
        w = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        starts = np.append(kept[:-1][doc] + w * WINDOW_LETTERS, kept[-1])
        for a in range(0, len(doc), ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, len(doc))
            offsets = (starts[a : b + 1] - starts[a]).astype(np.int32)
            seq = pa.StringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(bases[starts[a] : starts[b]]))
            own = batch.select(["doc_id", "rbp", "cell"]).take(pa.array(doc[a:b]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(w[a:b].astype(np.int32)), seq], names=[*own.schema.names, "w", "seq"])


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, doc_id, rbp, cell, dataset_id, label, seq)."""
    # Dealt out by id, so that a small file of long texts is not one task.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("rbp"), F.col("lang").alias("cell")).repartition("doc_id")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    tiles = docs.mapInArrow(_tiled, f"doc_id {kinds['doc_id']}, rbp {kinds['rbp']}, cell {kinds['cell']}, w int, seq string")
    return tiles.select(
        (F.col("doc_id") * WINDOW_ID_STEP + F.col("w")).alias("rec_id"), "doc_id", "rbp", "cell",
        F.concat_ws("_", "rbp", "cell").alias("dataset_id"),
        (F.col("doc_id") % 2).cast("int").alias("label"), "seq",
    )


def variant_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a strict-style header; one in seven has a wrong reference base."""
    w = windows(spark, sf_dir)
    idx = F.col("rec_id") % 101
    base = F.substr("seq", idx.cast("int") + 1, F.lit(1))
    shift = F.when(F.col("rec_id") % 7 == 0, F.translate(base, "ACGT", "CGTA")).otherwise(base)
    plus_ref = F.when(shift == "", "A").otherwise(shift)
    minus = F.col("rec_id") % 3 == 0
    ref = F.when(minus, F.translate(plus_ref, "ACGT", "TGCA")).otherwise(plus_ref)
    alt = F.translate(ref, "ACGT", "CGTA")
    start = F.col("rec_id") * 1000
    s = lambda c: c.cast("string")
    header = F.concat(
        F.lit(">variant_"), s(F.col("rec_id")), F.lit(" chr"), s(F.col("doc_id") % 22 + 1), F.lit(":"),
        s(start), F.lit("-"), s(start + F.length("seq")), F.when(minus, "(-)").otherwise("(+)"),
        F.lit("[utr]{NA} "), s(start + idx), F.lit(":"), ref, F.lit(">"), alt,
        F.lit(" ENSG"), s(F.col("doc_id")), F.lit("[0.01]{rs"), s(F.col("rec_id")), F.lit("}"),
    )
    return w.select("rec_id", "rbp", "cell", "dataset_id", header.alias("header"), "seq")


def catalog_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows under a catalog header, the position one too high for every fifth record."""
    v = variant_windows(spark, sf_dir)
    parts = F.split(F.substr("header", F.lit(2)), " ")
    snv = F.element_at(parts, 3)
    pos = F.substring_index(snv, ":", 1).cast("bigint") + F.when(F.col("rec_id") % 5 == 0, 1).otherwise(0)
    header = F.concat(
        F.substring_index(F.element_at(parts, 2), "[", 1), F.lit(" "), pos.cast("string"), F.lit(":"),
        F.substring_index(snv, ":", -1), F.lit(" "), F.col("rbp"), F.lit(" in "), F.col("cell"),
    )
    return v.select("rec_id", "rbp", "cell", "dataset_id", header.alias("header"), "seq")


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, rsid, rbp, cell, ref_score, alt_score, maf, line_no)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("variant"), F.col("user_id").alias("rsid"),
        (F.col("event_id") % 20).alias("rbp"), F.col("event_type").alias("cell"),
        ((F.col("value") - 245.0) / 100.0).alias("ref_score"),
        ((F.get_json_object("props", "$.k").cast("double") - 50.0) / 20.0).alias("alt_score"),
        (F.col("value") / 5000.0).alias("maf"), F.col("event_id").alias("line_no"),
    )


def pvalue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rsid, p_value, line_no) with repeated rsids."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("rsid"),
        ((F.col("o_totalprice") % 1000.0) / 1000.0).alias("p_value"),
        F.col("o_orderkey").alias("line_no"),
    )


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, grp, scores)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("rec_id"), F.col("label").alias("grp"),
        F.transform("embedding", lambda x: x.cast("double")).alias("scores"),
    )


def interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rbp, cell, chrom, start, end)."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 10 + F.col("l_partkey") % 10
    return li.select(
        F.col("l_returnflag").alias("rbp"), F.col("l_linenumber").cast("string").alias("cell"),
        (F.col("l_suppkey") % 5).cast("string").alias("chrom"),
        start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"),
    )


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, batch, label, prob, value) with ties in the probability."""
    li = table(spark, sf_dir, "lineitem")
    prob = (F.col("l_quantity") + F.col("l_discount") * 100.0) / 61.0
    return li.select(
        F.col("l_returnflag").alias("dataset_id"), F.col("l_linenumber").alias("batch"),
        F.when(F.col("l_extendedprice") + F.col("l_tax") * 500000.0 > 45000.0, 1).otherwise(0).alias("label"),
        prob.alias("prob"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"),
    )
