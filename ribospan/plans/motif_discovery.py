"""High-score regions to merged, enriched motif instances, for all datasets in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.operators import motifs as M
from ribospan.operators.stats import bh_adjust, hypergeom_enrichment
from ribospan.session import materialize

BY = ["dataset_id"]


def motif_table(instances: DataFrame) -> DataFrame:
    """Distinct motifs of a dataset with the place each was first seen."""
    return instances.groupBy(*BY, "motif").agg(
        F.min(F.struct("rec_id", "start")).alias("first_seen"), F.count(F.lit(1)).alias("n_regions")
    )


def enriched_motifs(
    records: DataFrame, motifs: DataFrame, p_cutoff: float = 5e-3
) -> DataFrame:
    """Motifs whose adjusted hypergeometric p is below the cutoff (strictly)."""
    # Everything after the scan of the records works on this table, one row per motif.
    counts = materialize(
        M.with_population(M.motif_containment(records, motifs, BY), records, BY)
    )
    tested = bh_adjust(hypergeom_enrichment(counts), BY)
    return tested.where(F.col("p_adj") < p_cutoff)


def discover_motifs(
    records: DataFrame, min_len: int = 4, width: int = 24, p_cutoff: float = 5e-3,
    min_instances: int = 3, all_ties: bool = True, condition=None, offset: int = 0,
    score_threshold: float | None = None,
) -> DataFrame:
    """Motif instances ``(dataset_id, motif, rec_id, start, end, window)``.

    ``records`` has ``dataset_id``, ``rec_id``, ``seq``, ``label`` and ``scores``; regions come
    from positives, enrichment from all records. The filter runs before the merge, so
    only enriched motifs are ever compared with each other.
    """
    positives = records.where(F.col("label") == 1)
    instances = materialize(
        M.region_instances(
            positives, [*BY, "rec_id"], "scores", min_len=min_len, condition=condition, offset=offset
        )
    )
    candidates = materialize(motif_table(instances))
    kept = enriched_motifs(
        records.select(*BY, "rec_id", "seq", "label"), candidates, p_cutoff=p_cutoff
    )
    seen = candidates.join(kept.select(*BY, "motif"), [*BY, "motif"], "left_semi")
    mapping = M.merge_similar_motifs(
        seen, BY, min_len=min_len, all_ties=all_ties, score_threshold=score_threshold
    )
    moved = instances.join(mapping, [*BY, "motif"])
    start = F.col("start") + F.col("shift")
    relocated = moved.select(
        *BY, F.col("target").alias("motif"), "rec_id", "seq",
        start.alias("start"), (start + F.length("target")).alias("end"),
    )
    placed = M.extract_windows(relocated, width)
    enough = (
        placed.groupBy(*BY, "motif")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_instances)
        .select(*BY, "motif")
    )
    return placed.join(enough, [*BY, "motif"], "left_semi")
