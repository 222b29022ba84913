"""Before/after scores to an annotated impact table in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.functions import scores as SC
from ribospan.operators import score_tables as T
from ribospan.operators.variants import pair_before_after


def annotate_impacts(
    before: DataFrame, after: DataFrame, keys: list[str], symbols: DataFrame | None,
    pvalues: DataFrame, pvalue_order: str, symbol_order: str | None = None,
) -> DataFrame:
    """Pairs by key, then delta, gene symbol and the last p-value of each rsid."""
    pairs = pair_before_after(before, after, keys).withColumn(
        "delta_score", SC.delta("alt_score", "ref_score")
    ).withColumn("abs_shift", SC.probability_shift("alt_score", "ref_score"))
    named = T.attach_gene_symbol(pairs, symbols, symbol_order) if symbols is not None else pairs.withColumn(
        "gene_name", F.lit("")
    )
    return T.attach_pvalue(named, pvalues, pvalue_order)
