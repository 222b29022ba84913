"""Distance profiles of each dataset's motif at two splice sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.operators.score_tables import position_density

# Motifs of the position files, in row order.
MOTIFS = ["AGGU", "UGUGU", "AGG"]


def motif_choice(motif_map: DataFrame, order: str) -> DataFrame:
    """First supported motif listed for each dataset."""
    return (
        motif_map.where(F.col("motif").isin(MOTIFS))
        .groupBy("dataset_id")
        .agg(F.min_by("motif", order).alias("motif"))
    )


def splice_profile(
    three_prime: DataFrame, five_prime: DataFrame, motif_map: DataFrame, order: str,
    low: float = -50, high: float = 50, width: float = 1.0,
) -> DataFrame:
    """Binned density of the chosen motif at both sites; a dataset must occur at both."""
    chosen = motif_choice(motif_map, order)
    both = three_prime.select("dataset_id").intersect(five_prime.select("dataset_id"))
    sites = three_prime.withColumn("site", F.lit("3ss")).unionByName(
        five_prime.withColumn("site", F.lit("5ss"))
    )
    rows = sites.join(both, "dataset_id", "left_semi").join(chosen, ["dataset_id", "motif"])
    return position_density(rows, ["dataset_id", "motif", "site"], "distance", low, high, width)
