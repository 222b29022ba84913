"""K-mer tables over many datasets at once.

Every count is collapsed to at most 4^k rows per dataset in the task before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ribospan.functions import sequence as S
from ribospan.functions.scans import group_numbers, word_counts
from ribospan.operators.ordered import exact_quantiles
from ribospan.session import materialize

MOST_CELLS = 1 << 22

def kmer_counts(df: DataFrame, k: int, by: list[str], acgt_only: bool = True) -> DataFrame:
    """Overlapping k-mer counts per group; optionally skip k-mers with other letters.

    The k-mers of a batch of sequences are numbered and counted together, and a task holds one table of
    counts a group (about ``MOST_CELLS`` cells in all) until it is full. K-mers over any letters, or too long for such tables, are
    exploded.
    """
    if not acgt_only or len(S.DNA) ** k > MOST_CELLS:
        grams = df.select(*by, F.explode(S.kmers("seq", k)).alias("kmer"))
        if acgt_only:
            grams = grams.where(F.col("kmer").rlike("^[ACGT]+$"))
        return grams.groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))
    rows = df.select(*by, F.col("seq").alias("_seq"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "kmer string, n long"

    def run(found):
        held: dict[tuple, np.ndarray] = {}
        for batch in found:
            groups, which = group_numbers(batch, by)
            counts = word_counts(batch.column("_seq").to_pylist(), which, len(groups), k, S.DNA)
            for key, row in zip(groups, counts, strict=True):
                held[key] = held[key] + row if key in held else row
            if len(held) * len(S.DNA) ** k > MOST_CELLS:
                yield from _count_rows(held, batch.schema, by, k)
                held = {}
        if held:
            yield from _count_rows(held, batch.schema, by, k)

    return rows.mapInArrow(run, schema).groupBy(*by, "kmer").agg(F.sum("n").alias("n"))


def _count_rows(held: dict, schema: pa.Schema, by: list[str], k: int):
    """The counts that are not zero, a batch a group."""
    words = np.array(S.vocabulary_kmers(k, S.DNA), object)
    for key, row in held.items():
        used = np.flatnonzero(row)
        values = [pa.repeat(pa.scalar(v, schema.field(c).type), len(used)) for c, v in zip(by, key, strict=True)]
        yield pa.RecordBatch.from_arrays([*values, pa.array(words[used], pa.string()), pa.array(row[used])], names=[*by, "kmer", "n"])


def top_kmers(counts: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """Most frequent k-mers per group; equal counts are ordered by k-mer."""
    order = W.partitionBy(*by).orderBy(F.desc("n"), "kmer")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def base_composition(df: DataFrame, by: list[str]) -> DataFrame:
    """Totals of A, C, G and T per group."""
    def total(base: str):
        seq = F.col("seq")
        return F.sum(F.length(seq) - F.length(F.replace(seq, F.lit(base)))).alias(f"n_{base.lower()}")

    return df.groupBy(*by).agg(*[total(b) for b in S.DNA])


def records_per_dataset(df: DataFrame, by: list[str], positives_only: bool = True) -> DataFrame:
    rows = df.where(F.col("label") == 1) if positives_only else df
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"))


def complete_grid(counts: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Every k-mer for each group, zero where absent; the rows of a group come from an in-row array."""
    vocab = sorted(S.vocabulary_kmers(k, S.DNA))
    # The small count table is read twice below; the sequences are scanned once for it.
    counts = materialize(counts)
    grid = counts.select(*by).distinct().select(
        *by, F.explode(F.array(*[F.lit(v) for v in vocab])).alias("kmer")
    )
    return grid.join(counts, [*by, "kmer"], "left").select(
        *by, "kmer", F.coalesce("n", F.lit(0)).alias("n")
    )


def normalize_by_count(
    counts: DataFrame, records: DataFrame, by: list[str], value: str = "n"
) -> DataFrame:
    """Counts divided by the number of records of the same group; groups missing on one side drop out."""
    return counts.join(records, by).select(
        *counts.columns, (F.col(value) / F.col("n_records")).alias("rate")
    )


def scale_columns(df: DataFrame, column: str, value: str, out: str = "z") -> DataFrame:
    """Centre and scale each column of a long matrix by its mean and sample deviation."""
    moments = df.groupBy(column).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd")
    )
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return df.join(moments, column).withColumn(out, z).drop("_mean", "_sd")


def winsorize(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to quantiles taken over the whole table."""
    limits = exact_quantiles(df, [], value, {"lo": low, "hi": high})
    bounds = limits.select(F.struct("lo", "hi").alias("b")).scalar()
    clipped = F.greatest(F.least(F.col(value), F.col("_b.hi")), F.col("_b.lo"))
    return (
        df.withColumn("_b", bounds)
        .withColumn(value, F.when(F.col(value).isNotNull(), clipped))
        .drop("_b")
    )
