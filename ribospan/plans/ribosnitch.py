"""Cell-line dynamics of structure-changing variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.functions import scores as SC
from ribospan.operators import score_tables as T


def ribosnitch_dynamics(
    scores: DataFrame, cells: list[str], order: str = "line_no", inclusive: bool = False
) -> DataFrame:
    """Odds per RBP: all cell pairs by first row, then each fixed pair of ``cells``."""
    gated = scores.where(SC.score_gate("score", inclusive))
    columns = ["cell_line_pair", "rbp", "dynamic", "common", "odds_ratio"]
    everything = T.dynamic_common_first(gated, order).withColumn(
        "cell_line_pair", F.lit("All pairwise cells")
    )
    return everything.select(*columns).unionByName(
        T.dynamic_common_pairs(gated, cells).select(*columns)
    )
