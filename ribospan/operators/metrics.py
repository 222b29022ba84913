"""Classification and regression metrics for many datasets in one job.

Scores are first reduced to one row per (group, score) with positive and negative
counts; everything else, curves included, is derived from that table and its
running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospan.operators.ordered import average_ranks, running_sums


def threshold_table(
    df: DataFrame, by: list[str], label: str = "label", prob: str = "prob"
) -> DataFrame:
    """Per distinct score: ``pos``, ``neg`` and the counts at strictly higher scores."""
    counts = (
        df.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(prob).alias("score"))
        .agg(
            F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
            F.sum((F.col(label) != 1).cast("bigint")).alias("neg"),
        )
        .withColumn("_down", -F.col("score"))
    )
    return running_sums(counts, by, ["_down"], ["pos", "neg"]).drop("_down")


def _curve(thresholds: DataFrame, by: list[str]) -> DataFrame:
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    seen_before = F.col("pos_before") + F.col("neg_before")
    return thresholds.select(
        *by, "score", "pos", "neg", "pos_before", "neg_before", "pos_total", "neg_total",
        tp.alias("tp"), fp.alias("fp"),
        F.try_divide(tp.cast("double"), F.col("pos_total")).alias("tpr"),
        F.try_divide(fp.cast("double"), F.col("neg_total")).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
        F.when(seen_before > 0, F.col("pos_before") / seen_before)
        .otherwise(F.lit(1.0))
        .alias("precision_before"),
    )


def roc_points(df: DataFrame, by: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """One ROC point per distinct score, without the (0, 0) start."""
    return _curve(threshold_table(df, by, label, prob), by).select(*by, "score", "fpr", "tpr")


def pr_points(df: DataFrame, by: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """One precision-recall point per distinct score, without the (recall 0, precision 1) end."""
    curve = _curve(threshold_table(df, by, label, prob), by)
    return curve.select(*by, "score", F.col("tpr").alias("recall"), "precision")


def _area_columns() -> dict[str, Column]:
    pos, neg = F.col("pos"), F.col("neg")
    gain = F.try_divide(pos.cast("double"), F.col("pos_total"))
    pairs = F.col("pos_total").cast("double") * F.col("neg_total")
    return {
        "roc_auc": F.sum(F.try_divide(neg.cast("double") * (F.col("pos_before") + pos / 2.0), pairs)),
        "pr_auc": F.sum(gain * (F.col("precision") + F.col("precision_before")) / 2.0),
        "average_precision": F.sum(gain * F.col("precision")),
    }


def average_precision(
    df: DataFrame, by: list[str], label: str = "label", prob: str = "prob"
) -> DataFrame:
    """Step-wise average precision; not the same number as the trapezoid ``pr_auc``."""
    curve = _curve(threshold_table(df, by, label, prob), by)
    return curve.groupBy(*by).agg(_area_columns()["average_precision"].alias("average_precision"))


def _matthews(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(F.lit(0.0))


def binary_metrics(
    df: DataFrame, by: list[str], label: str = "label", prob: str = "prob"
) -> DataFrame:
    """Accuracy, F1 and MCC at the half-even rounded score, confusion counts above 0.5,
    rank ROC-AUC and trapezoid PR-AUC, per group."""
    curve = _curve(threshold_table(df, by, label, prob), by)
    rounded, above = F.bround("score", 0), F.col("score") > 0.5
    count = lambda cond, side: F.sum(F.when(cond, F.col(side)).otherwise(F.lit(0)))
    areas = _area_columns()
    agg = curve.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        (count(rounded == 1, "pos") + count(rounded == 0, "neg")).alias("_right"),
        count(rounded == 1, "pos").alias("_tp"),
        count(rounded == 1, "neg").alias("_fp"),
        count(rounded != 1, "pos").alias("_fn"),
        count(rounded != 1, "neg").alias("_tn"),
        count(above, "pos").alias("tp"),
        count(~above, "neg").alias("tn"),
        count(above, "neg").alias("fp"),
        count(~above, "pos").alias("fn"),
        areas["roc_auc"].alias("auc"),
        areas["pr_auc"].alias("prc"),
    )
    denominator = 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")
    return agg.select(
        *by,
        "n",
        (F.col("_right") / F.col("n")).alias("acc"),
        "auc",
        "prc",
        F.when(denominator > 0, 2 * F.col("_tp") / denominator).otherwise(F.lit(0.0)).alias("f1"),
        _matthews(F.col("_tp"), F.col("_tn"), F.col("_fp"), F.col("_fn")).alias("mcc"),
        "tp", "tn", "fp", "fn",
    )


RATES = ["acc", "auc", "prc", "f1", "mcc"]
COUNTS = ["tp", "tn", "fp", "fn"]


def batch_averaged_metrics(
    df: DataFrame, by: list[str], batch: str, label: str = "label", prob: str = "prob"
) -> DataFrame:
    """Metrics per batch, then the mean of rates and the sum of counts (not the pooled value)."""
    per_batch = binary_metrics(df, [*by, batch], label, prob)
    return per_batch.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in RATES], *[F.sum(c).alias(c) for c in COUNTS]
    )


def multilabel_metrics(
    df: DataFrame, by: list[str], label_col: str, label: str = "label", prob: str = "prob"
) -> DataFrame:
    """Mean and population deviation over label columns; counts are those of the first column."""
    per_label = binary_metrics(df, [*by, label_col], label, prob)
    return per_label.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in RATES],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in RATES],
        *[F.min_by(c, label_col).alias(c) for c in COUNTS],
    )


def categorical_metrics(
    df: DataFrame, by: list[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Argmax accuracy and one-vs-rest AUC per class from label and prediction arrays."""
    arg_max = lambda c: F.array_position(F.col(c), F.array_max(c))
    accuracy = df.groupBy(*by).agg(
        F.avg((arg_max(label) == arg_max(pred)).cast("double")).alias("acc")
    )
    cells = df.select(
        *by, F.posexplode(F.arrays_zip(F.col(label).alias("y"), F.col(pred).alias("p")))
    ).select(*by, F.col("pos").alias("class"), F.col("col.y").alias("y"), F.col("col.p").alias("p"))
    per_class = binary_metrics(cells, [*by, "class"], "y", "p").select(
        *by, "class", "auc", "prc"
    )
    return per_class.join(accuracy, by) if by else per_class.withColumn("acc", accuracy.scalar())


def precision_recall(
    df: DataFrame, by: list[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Binary precision/recall of class 1 and their macro means over both classes."""
    hit = lambda y, p: F.sum(((F.col(label) == y) & (F.col(pred) == p)).cast("bigint"))
    agg = df.groupBy(*by).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")
    )
    ratio = lambda a, b: F.when(
        F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))
    ).otherwise(F.lit(0.0))
    p1, r1, p0, r0 = ratio("tp", "fp"), ratio("tp", "fn"), ratio("tn", "fn"), ratio("tn", "fp")
    return agg.select(
        *by,
        p1.alias("precision"), r1.alias("recall"),
        ((p1 + p0) / 2).alias("precision_macro"), ((r1 + r0) / 2).alias("recall_macro"),
    )


def regression_metrics(df: DataFrame, by: list[str], label: str, pred: str) -> DataFrame:
    """Pearson r, slope of the line through the origin and its 1 - SSE / SST."""
    y, x = F.col(label).cast("double"), F.col(pred).cast("double")
    agg = df.where(y.isNotNull() & x.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(y, x).alias("pearson"),
        F.sum(x * y).alias("_xy"),
        F.sum(x * x).alias("_xx"),
        F.sum(y * y).alias("_yy"),
        F.var_pop(y).alias("_var"),
    )
    slope = F.try_divide(F.col("_xy"), F.col("_xx"))
    sse = F.col("_yy") - slope * F.col("_xy")
    return agg.select(
        *by, "n", "pearson", slope.alias("slope"),
        (1 - F.try_divide(sse, F.col("_var") * F.col("n"))).alias("r_squared"),
    )


def pearson_spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson, Spearman (average ranks) and their mean."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    pairs = rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_m"))
    rank = lambda c, out: average_ranks(rows, by, c).select(
        *by, c, (F.col("avg_rank") - (F.col("n_total") + 1) / 2.0).alias(out)
    )
    ranked = pairs.join(rank(x, "_rx"), [*by, x]).join(rank(y, "_ry"), [*by, y])
    m, rx, ry = F.col("_m"), F.col("_rx"), F.col("_ry")
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    # Ranks are centred by construction, so plain weighted products are enough;
    # repeated pairs make the value correlation a weighted one too.
    spearman = F.sum(m * rx * ry) / F.sqrt(F.sum(m * rx * rx) * F.sum(m * ry * ry))
    rank_part = ranked.groupBy(*by).agg(spearman.alias("spearman"))
    value_part = rows.groupBy(*by).agg(F.corr(vx, vy).alias("pearson"))
    both = (
        value_part.join(rank_part, by)
        if by
        else value_part.withColumn("spearman", rank_part.scalar())
    )
    return both.select(
        *by, "pearson", "spearman", ((F.col("pearson") + F.col("spearman")) / 2).alias("corr")
    )
