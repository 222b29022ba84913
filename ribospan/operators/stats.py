"""Significance tests and multiple-testing rules over grouped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ribospan.functions.core import col, let
from ribospan.functions.special import hypergeom_sf, rank_sum_p, student_two_sided
from ribospan.operators.ordered import exact_quantiles, running_sums, suffix_min, value_counts
from ribospan.session import materialize

QQ_CHUNK = 100_000


def hypergeom_enrichment(counts: DataFrame, out: str = "p") -> DataFrame:
    """Adds P(X >= x) from columns ``total``, ``positives``, ``n_with``, ``n_pos_with``."""
    return counts.withColumn(out, hypergeom_sf("n_pos_with", "total", "positives", "n_with"))


def bh_adjust(df: DataFrame, by: list[str], p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted p per group (``p * m / rank``, suffix minimum, at most 1).

    Rows with p = 1, often most of a group, keep it: nothing larger could lower it. They meet no join.
    """
    counts = value_counts(df, by, p, p)
    ranked = running_sums(counts, by, [p], ["n"])
    raw = ranked.select(
        *by, p, (F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n"))).alias("_raw")
    )
    adjusted = suffix_min(raw, by, [p], "_raw", "_min").select(
        *by, p, F.least(F.col("_min"), F.lit(1.0)).alias(out)
    )
    certain = F.coalesce(F.col(p) == 1, F.lit(False))
    joined = df.where(~certain).join(adjusted.where(F.col(p) != 1), [*by, p], "left")
    order = [F.col(f"`{c}`") for c in joined.columns if c != out]
    ones = df.where(certain).select(*order, F.lit(1.0).alias(out))
    return joined.select(*order, out).unionByName(ones)


def log2_scientific(text: str | Column) -> Column:
    """log2 of a number written as text, also below the double range (``1.6e-400``); comma decimals allowed."""
    return let(
        F.split(F.lower(F.replace(F.trim(col(text)), F.lit(","), F.lit("."))), "e"),
        lambda parts: F.log2(F.element_at(parts, 1).cast("double"))
        + F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(0.0))
        * F.log2(F.lit(10.0)),
    )


def bonferroni_keep(
    df: DataFrame, by: list[str], log2_p: str, rank: str, max_motifs: int, alpha: float = 0.01
) -> DataFrame:
    """Keep rows whose log2 p is below log2(alpha / n) among the first ``max_motifs`` of the group."""
    sizes = materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))  # a row a group, of known size to the join
    joined = df.join(sizes, by)
    cutoff = F.log2(F.lit(alpha) / F.col("_n"))
    return joined.where((F.col(log2_p) < cutoff) & (F.col(rank) <= max_motifs)).drop("_n")


def rank_sum_test(
    df: DataFrame, by: list[str], group: str, value: str, pairs: list[tuple[str, str]]
) -> DataFrame:
    """Two-sided Wilcoxon rank-sum test for each listed pair of groups.

    ``w`` is the statistic of the first group of the pair; the p-value follows R's
    defaults. All pairs are tested in one job.
    """
    table = F.array(
        *[F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a, b in pairs]
    )
    mine = F.filter(table, lambda t: (t["g1"] == F.col(group)) | (t["g2"] == F.col(group)))
    keys = [*by, "g1", "g2"]
    rows = df.where(F.col(value).isNotNull()).select(*by, group, value, F.inline(mine))
    first = F.col(group) == F.col("g1")
    counts = rows.groupBy(*keys, value).agg(
        F.sum(first.cast("bigint")).alias("n1"), F.sum((~first).cast("bigint")).alias("n2")
    ).withColumn("n", F.col("n1") + F.col("n2"))
    ranked = running_sums(counts, keys, [value], ["n"])
    n = F.col("n").cast("double")
    avg_rank = F.col("n_before") + (n + 1) / 2.0
    agg = ranked.groupBy(*keys).agg(
        F.sum("n1").alias("n1"),
        F.sum("n2").alias("n2"),
        F.sum(F.col("n1") * avg_rank).alias("_r1"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n1 = F.col("n1").cast("double")
    return agg.withColumn("w", F.col("_r1") - n1 * (n1 + 1) / 2.0).select(
        *keys, "n1", "n2", "w", "ties",
        rank_sum_p(
            "w", F.col("n1").cast("double"), F.col("n2").cast("double"), "ties"
        ).alias("p"),
    )


def pearson_test(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, r and the two-sided t-test p per group."""
    agg = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    )
    dof = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(dof / (1 - F.col("r") * F.col("r")))
    return agg.select(
        *by, "n", "r", student_two_sided(F.coalesce(t, F.lit(float("nan"))), dof).alias("p")
    )


def plotting_position(i: Column, n: Column) -> Column:
    """(i - a) / (n + 1 - 2a), a = 3/8 up to ten points, else 1/2."""
    a = F.when(n <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    return (i - a) / (n + 1 - 2 * a)


def qq_points(df: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """One row per input p: its order ``i``, observed and expected -log10 p.

    Equal p-values are one row until the end; a value repeated very often is spread
    over chunks before it is expanded.
    """
    ranked = running_sums(value_counts(df, by, p, p), by, [p], ["n"])
    chunked = ranked.select(
        *by, p, "n_before", "n", "n_total",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / QQ_CHUNK).cast("int"))).alias("_chunk"),
    ).repartition(*[F.col(c) for c in (*by, p, "_chunk")])
    first = F.col("_chunk").cast("bigint") * QQ_CHUNK + 1
    last = F.least(first + (QQ_CHUNK - 1), F.col("n"))
    rows = chunked.select(
        *by, p, "n_total", "n_before", F.explode(F.sequence(first, last)).alias("_k")
    ).withColumn("i", F.col("n_before") + F.col("_k"))
    return rows.select(
        *by, "i", p,
        (-F.log10(p)).alias("observed"),
        (-F.log10(plotting_position(F.col("i"), F.col("n_total")))).alias("expected"),
    )


def iqr_filter(df: DataFrame, by: list[str], value: str, width: float = 1.5) -> DataFrame:
    """Rows within ``width`` interquartile ranges of the quartiles of their group."""
    q = exact_quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75}).drop("n")
    joined = df.join(materialize(q), by)
    reach = F.lit(width) * (F.col("_q3") - F.col("_q1"))
    return joined.where(
        F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)
    ).drop("_q1", "_q3")


def best_epoch(df: DataFrame, run: str = "run", patience: int | None = None) -> DataFrame:
    """Epoch of the first strictly highest AUC per run, looking no further than the stop rule.

    Training stops at the first epoch more than ``patience`` after the best so far. A
    run has a few hundred epochs, so the window per run is small.
    """
    order = W.partitionBy(run).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    seen = df.withColumn(
        "_best", F.max(F.struct(F.col("auc"), (-F.col("epoch")).alias("e"))).over(order)
    )
    if patience is not None:
        late = F.when(F.col("epoch") + F.col("_best.e") > patience, F.col("epoch"))
        stop = F.min(late).over(W.partitionBy(run))
        seen = seen.withColumn("_stop", stop).where(
            F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop"))
        )
    top = seen.groupBy(run).agg(
        F.max(F.struct(F.col("auc"), (-F.col("epoch")).alias("e"))).alias("b"),
        F.max("epoch").alias("last_epoch"),
    )
    return top.select(
        run, F.col("b.auc").alias("best_auc"), (-F.col("b.e")).alias("best_epoch"), "last_epoch"
    )
