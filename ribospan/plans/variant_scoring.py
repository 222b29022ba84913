"""Variant windows to scores: parse, apply, choose models, score.

The stages are stateless, so the same functions run on a streaming DataFrame. A scorer
is any ``(DataFrame) -> DataFrame`` that adds ``score`` from ``scored_seq`` and the model's
columns; the default is a linear k-mer model held in the ``models`` table. A scorer with a ``prepare`` gets
records and models before they are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospan.functions import sequence as S
from ribospan.functions.core import let
from ribospan.functions.special import listed_words
from ribospan.operators import variants as V

Scorer = Callable[[DataFrame], DataFrame]


def kmer_logit(seq: str | Column, k: int, weights: Column, bias: Column) -> Column:
    """``bias`` plus the weight of every k-mer occurrence (``map<kmer, weight>``), no sigmoid."""
    # Go over the weights and count each k-mer's occurrences by deleting it from the separated
    # text, instead of searching the map per position. Keys of another length are no k-mers.
    return let(
        F.array_join(S.kmers(seq, k), "|"),
        lambda joined: F.aggregate(
            F.filter(F.map_entries(weights), lambda e: F.length(e["key"]) == k),
            bias.cast("double"),
            lambda acc, e: acc
            + e["value"] * (F.length(joined) - F.length(F.replace(joined, e["key"]))) / F.lit(float(k)),
        ),
    )


class LinearScorer:
    """Scores with ``weights`` and ``bias`` columns joined from the model table.

    Before the join each record's k-mers are counted once, in the order of the models' k-mers, and the
    models' weights become arrays in that order. With more than ``most_keys`` different k-mers in the
    models they stay maps, and each (record, model) row is counted.
    """

    def __init__(self, k: int = 3, most_keys: int = 4096) -> None:
        self.k, self.most_keys = k, most_keys

    def prepare(self, records: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = models.select(F.explode(F.map_keys("weights")).alias("key")).where(F.length("key") == self.k).distinct()
        found = sorted(r["key"] for r in keys.limit(self.most_keys + 1).collect())
        if not found or len(found) > self.most_keys:
            return records, models
        names = F.array(*[F.lit(g) for g in found])
        counts = listed_words(found, self.k)("scored_seq")
        weights = F.transform(names, lambda g: F.coalesce(F.try_element_at("weights", g), F.lit(0.0)))
        return records.withColumn("_counts", counts), models.withColumn("weights", weights)

    def __call__(self, df: DataFrame) -> DataFrame:
        if "_counts" not in df.columns:
            return df.withColumn("score", kmer_logit("scored_seq", self.k, F.col("weights"), F.col("bias"))).drop("weights", "bias")
        products = F.zip_with("_counts", "weights", lambda n, w: n * w)
        score = F.aggregate(products, F.col("bias").cast("double"), lambda acc, x: acc + x)
        return df.withColumn("score", score).drop("weights", "bias", "_counts")


def linear_scorer(k: int = 3) -> Scorer:
    return LinearScorer(k)


def _prepared(records: DataFrame, models: DataFrame, scorer: Scorer | None) -> tuple[DataFrame, DataFrame, Scorer]:
    scorer = scorer or linear_scorer()
    if hasattr(scorer, "prepare"):
        records, models = scorer.prepare(records, models)
    return records, models, scorer


def score_gwas(records: DataFrame, models: DataFrame, mode: str = "after", scorer: Scorer | None = None) -> DataFrame:
    """The model of a record is named by its dataset (file stem)."""
    applied = V.apply_variant_gwas(records, mode).where(F.col("reject_reason").isNull())
    named, models, scorer = _prepared(applied.withColumn("model_id", F.col("dataset_id")), models, scorer)
    return scorer(V.model_lookup(named, models))


def score_catalog(
    records: DataFrame, models: DataFrame, mode: str = "after", from_stem: bool = False,
    scorer: Scorer | None = None, **rules,
) -> DataFrame:
    """The model is named ``<protein>_<cell>`` by the header, or by the file stem."""
    applied = V.apply_variant_catalog(records, mode, **rules).where(F.col("reject_reason").isNull())
    header_id = F.when(
        (F.col("parsed.protein") != "") & (F.col("parsed.cell_line") != ""),
        F.concat_ws("_", "parsed.protein", "parsed.cell_line"),
    )
    named = applied.withColumn("model_id", F.col("dataset_id") if from_stem else header_id)
    named, models, scorer = _prepared(named.where(F.col("model_id").isNotNull()), models, scorer)
    return scorer(V.model_lookup(named, models))


def score_ribosnitch(
    records: DataFrame, models: DataFrame, mode: str = "after", forced: bool = False,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Every model of either of the record's two cell lines."""
    applied = V.apply_variant_ribosnitch(records, mode, forced).where(F.col("reject_reason").isNull())
    applied, models, scorer = _prepared(applied, models, scorer)
    return scorer(V.record_model_expand(applied, models))


def rejects(applied: DataFrame, by: list[str]) -> DataFrame:
    """Rejected records per reason."""
    return (
        applied.where(F.col("reject_reason").isNotNull())
        .groupBy(*by, "reject_reason")
        .agg(F.count(F.lit(1)).alias("n_rejected"))
    )
