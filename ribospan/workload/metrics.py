"""Metric, statistic, split and interval queries."""

from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.operators import intervals as I
from ribospan.operators import metrics as M
from ribospan.operators import splits as SP
from ribospan.operators import stats as ST
from ribospan.workload.inputs_sql import INTERVALS, PREDICTIONS, PVALUES, SCORES, WINDOWS
from ribospan.workload.registry import query, with_ctes

BY = ["dataset_id"]


def rounded(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def curve_sql(by: str, source: str = "predictions") -> str:
    """Threshold table and cumulative curve per group, plus per-group sums."""
    return f"""
th AS (SELECT {by}, prob AS score, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {by}, prob),
cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p,
    sum(neg) OVER (PARTITION BY {by}) AS n
  FROM th WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
curve AS (
  SELECT *, tp / nullif(p, 0) AS tpr, fp / nullif(n, 0) AS fpr, tp / (tp + fp) AS precision,
    CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1.0::DOUBLE END AS precision_before
  FROM cum),
conf AS (
  SELECT {by}, count(*) AS total, avg(CASE WHEN (prob > 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS acc,
    sum(CASE WHEN prob > 0.5 AND label = 1 THEN 1 ELSE 0 END) AS ctp,
    sum(CASE WHEN prob <= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS ctn,
    sum(CASE WHEN prob > 0.5 AND label = 0 THEN 1 ELSE 0 END) AS cfp,
    sum(CASE WHEN prob <= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS cfn
  FROM {source} GROUP BY {by}),
areas AS (
  SELECT {by}, sum(neg * (tp - pos + pos / 2.0::DOUBLE) / nullif(p * n, 0)) AS auc,
    sum(pos / nullif(p, 0) * (precision + precision_before) / 2) AS prc, sum(pos / nullif(p, 0) * precision) AS ap
  FROM curve GROUP BY {by}),
metrics AS (
  SELECT *, 2 * ctp / (2 * ctp + cfp + cfn) AS f1,
    (ctp * ctn::DOUBLE - cfp * cfn::DOUBLE) / (sqrt(ctp + cfp) * sqrt(ctp + cfn) * sqrt(ctn + cfp) * sqrt(ctn + cfn)) AS mcc
  FROM conf JOIN areas USING ({by}))
"""


@query(with_ctes(PREDICTIONS, curve_sql("dataset_id"), body="""
SELECT dataset_id, CAST(total AS BIGINT) AS n, round(acc, 6) AS acc, round(auc, 6) AS auc, round(prc, 6) AS prc,
  round(f1, 6) AS f1, round(mcc, 6) AS mcc, CAST(ctp AS BIGINT) AS tp, CAST(ctn AS BIGINT) AS tn,
  CAST(cfp AS BIGINT) AS fp, CAST(cfn AS BIGINT) AS fn
FROM metrics
"""))
def binary_metrics(spark, sf_dir):
    return rounded(M.binary_metrics(X.prediction_rows(spark, sf_dir), BY))


@query(with_ctes("""
predictions AS (SELECT 'quality' AS dataset_id, quality AS label, CAST(n_chars AS DOUBLE) AS prob
                FROM labels JOIN documents USING (doc_id))""", curve_sql("dataset_id"), body="""
SELECT dataset_id, round(auc, 6) AS auc, round(prc, 6) AS prc FROM areas
"""))
def label_length_auc(spark, sf_dir):
    labels, docs = X.table(spark, sf_dir, "labels"), X.table(spark, sf_dir, "documents")
    rows = labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        F.lit("quality").alias("dataset_id"), F.col("quality").alias("label"),
        F.col("n_chars").cast("double").alias("prob"),
    )
    return rounded(M.binary_metrics(rows, BY).select("dataset_id", "auc", "prc"))


@query(with_ctes(PREDICTIONS, curve_sql("dataset_id"), body="SELECT dataset_id, round(ap, 6) AS average_precision FROM areas"))
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(X.prediction_rows(spark, sf_dir), BY))


@query(with_ctes(PREDICTIONS, curve_sql("dataset_id"), body="""
SELECT dataset_id, round(score, 9) AS score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM curve
"""))
def roc_points(spark, sf_dir):
    return rounded(M.roc_points(X.prediction_rows(spark, sf_dir), BY), 9)


@query(with_ctes(PREDICTIONS, curve_sql("dataset_id"), body="""
SELECT dataset_id, round(score, 9) AS score, round(tpr, 9) AS recall, round(precision, 9) AS precision FROM curve
"""))
def pr_points(spark, sf_dir):
    return rounded(M.pr_points(X.prediction_rows(spark, sf_dir), BY), 9)


@query(with_ctes(PREDICTIONS, curve_sql("dataset_id, batch"), body="""
SELECT dataset_id, round(avg(acc), 6) AS acc, round(avg(auc), 6) AS auc, round(avg(prc), 6) AS prc,
  round(avg(f1), 6) AS f1, round(avg(mcc), 6) AS mcc, CAST(sum(ctp) AS BIGINT) AS tp, CAST(sum(ctn) AS BIGINT) AS tn,
  CAST(sum(cfp) AS BIGINT) AS fp, CAST(sum(cfn) AS BIGINT) AS fn
FROM metrics GROUP BY dataset_id
"""))
def batch_averaged_metrics(spark, sf_dir):
    return rounded(M.batch_averaged_metrics(X.prediction_rows(spark, sf_dir), BY, "batch"))


@query(with_ctes(PREDICTIONS, curve_sql("dataset_id, batch"), body="""
SELECT dataset_id, """ + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in M.RATES
) + """,
  CAST(arg_min(ctp, batch) AS BIGINT) AS tp, CAST(arg_min(ctn, batch) AS BIGINT) AS tn,
  CAST(arg_min(cfp, batch) AS BIGINT) AS fp, CAST(arg_min(cfn, batch) AS BIGINT) AS fn
FROM metrics GROUP BY dataset_id
"""))
def multilabel_metrics(spark, sf_dir):
    return rounded(M.multilabel_metrics(X.prediction_rows(spark, sf_dir), BY, "batch"))


# Class of an embedding: its label; score of a class: the sum of every tenth component from it on.
@query(with_ctes("""
cells AS (SELECT vec_id, c AS class, CASE WHEN label = c THEN 1 ELSE 0 END AS label,
                 list_sum([x::DOUBLE for x, i in embedding if (i - 1) % 10 = c]) AS prob
          FROM embeddings, (SELECT unnest(range(0, 10)) AS c)),
predictions AS (SELECT CAST(class AS INTEGER) AS class, label, prob FROM cells),
acc_ AS (SELECT avg(CASE WHEN hit = 1 THEN 1.0::DOUBLE ELSE 0 END) AS acc
         FROM (SELECT vec_id, arg_max(label, prob) AS hit FROM cells GROUP BY vec_id))
""", curve_sql("class"), body="""
SELECT class, round(auc, 6) AS auc, round(prc, 6) AS prc, round(acc_.acc, 6) AS acc FROM areas, acc_
"""))
def categorical_metrics(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (F.col("label") == c).cast("int")).alias("label"),
        F.transform(
            F.sequence(F.lit(0), F.lit(9)),
            lambda c: F.aggregate(
                F.filter("embedding", lambda _x, i: i % 10 == c), F.lit(0.0), lambda a, x: a + x.cast("double")
            ),
        ).alias("pred"),
    )
    return rounded(M.categorical_metrics(e, []))


@query(with_ctes(PREDICTIONS, curve_sql("dataset_id"), body="""
SELECT dataset_id, round(ctp / (ctp + cfp), 6) AS precision, round(ctp / (ctp + cfn), 6) AS recall,
  round((ctp / (ctp + cfp) + ctn / (ctn + cfn)) / 2, 6) AS precision_macro,
  round((ctp / (ctp + cfn) + ctn / (ctn + cfp)) / 2, 6) AS recall_macro
FROM conf
"""))
def precision_recall(spark, sf_dir):
    p = X.prediction_rows(spark, sf_dir).withColumn("pred", (F.col("prob") > 0.5).cast("int"))
    return rounded(M.precision_recall(p, BY))


@query(with_ctes(PREDICTIONS, body="""
SELECT dataset_id, count(*) AS n, round(corr(value, quantity), 6) AS pearson,
  round(sum(value * quantity) / sum(quantity * quantity), 4) AS slope,
  round(1 - (sum(value * value) - sum(value * quantity) * sum(value * quantity) / sum(quantity * quantity))
            / (var_pop(value) * count(*)), 6) AS r_squared
FROM predictions GROUP BY dataset_id
"""))
def regression_metrics(spark, sf_dir):
    out = M.regression_metrics(X.prediction_rows(spark, sf_dir), BY, "value", "quantity")
    return rounded(out).withColumn("slope", F.round("slope", 4))


@query(with_ctes(PREDICTIONS, """
ranked AS (SELECT dataset_id, value, quantity,
    rank() OVER (PARTITION BY dataset_id ORDER BY value) + (count(*) OVER (PARTITION BY dataset_id, value) - 1) / 2.0::DOUBLE AS rv,
    rank() OVER (PARTITION BY dataset_id ORDER BY quantity) + (count(*) OVER (PARTITION BY dataset_id, quantity) - 1) / 2.0::DOUBLE AS rq
  FROM predictions)""", body="""
SELECT dataset_id, round(corr(value, quantity), 6) AS pearson, round(corr(rv, rq), 6) AS spearman,
  round((corr(value, quantity) + corr(rv, rq)) / 2, 6) AS corr
FROM ranked GROUP BY dataset_id
"""))
def pearson_spearman(spark, sf_dir):
    return rounded(M.pearson_spearman(X.prediction_rows(spark, sf_dir), BY, "value", "quantity"))


@query("""
WITH runs AS (SELECT l_suppkey AS run, CAST(l_linenumber * 100 + l_quantity AS INTEGER) AS epoch, max(l_discount) AS auc
              FROM lineitem GROUP BY ALL),
best AS (SELECT *, max(auc) OVER w AS m FROM runs WINDOW w AS (PARTITION BY run ORDER BY epoch)),
first_ AS (SELECT *, (SELECT min(epoch) FROM runs r WHERE r.run = best.run AND r.auc = best.m) AS be FROM best),
stop AS (SELECT *, min(CASE WHEN epoch - be > 150 THEN epoch END) OVER (PARTITION BY run) AS s FROM first_),
kept AS (SELECT * FROM stop WHERE s IS NULL OR epoch <= s)
SELECT run, round(max(auc), 6) AS best_auc, CAST(arg_max(epoch, struct_pack(a := auc, e := -epoch)) AS INTEGER) AS best_epoch,
  CAST(max(epoch) AS INTEGER) AS last_epoch
FROM kept GROUP BY run
""")
def best_epoch(spark, sf_dir):
    runs = X.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("run"), (F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("int").alias("epoch")
    ).agg(F.max("l_discount").alias("auc"))
    return rounded(ST.best_epoch(runs, "run", patience=150))


# ------------------------------------------------------------- statistics

ENRICHMENT = """
counts AS (
  SELECT l_suppkey AS motif, CAST(count(*) AS BIGINT) AS n_with,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_pos_with FROM lineitem GROUP BY 1),
size_ AS (SELECT count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM lineitem)
"""


@query(with_ctes(ENRICHMENT, body="""
, terms AS (
  SELECT motif, n_with, n_pos_with, exp(
      lgamma(positives + 1) - lgamma(k + 1) - lgamma(positives - k + 1)
      + lgamma(total - positives + 1) - lgamma(n_with - k + 1) - lgamma(total - positives - n_with + k + 1)
      - lgamma(total + 1) + lgamma(n_with + 1) + lgamma(total - n_with + 1)) AS t
  FROM (SELECT *, unnest(range(n_pos_with, least(positives, n_with) + 1)) AS k FROM counts, size_))
SELECT motif, n_with, n_pos_with, round(sum(t), 6) AS p FROM terms GROUP BY ALL
"""))
def hypergeom_enrichment(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem")
    positive = (F.col("l_returnflag") == "R").cast("bigint")
    counts = li.groupBy(F.col("l_suppkey").alias("motif")).agg(
        F.count(F.lit(1)).alias("n_with"), F.sum(positive).alias("n_pos_with")
    )
    size = li.agg(F.struct(F.count(F.lit(1)).alias("total"), F.sum(positive).alias("positives")).alias("s"))
    sized = counts.withColumn("_s", size.scalar()).select("*", "_s.total", "_s.positives")
    return ST.hypergeom_enrichment(sized).select("motif", "n_with", "n_pos_with", F.round("p", 6).alias("p"))


P_ROWS = "prow AS (SELECT rsid % 7 AS grp, line_no, p_value AS p FROM pvalues)"


def _p_rows(spark, sf_dir):
    return X.pvalue_rows(spark, sf_dir).select(
        (F.col("rsid") % 7).alias("grp"), "line_no", F.col("p_value").alias("p")
    )


def _small_p(p):
    """Some p-values small enough for a corrected threshold."""
    return p * p * p * p + 1e-12


@query(with_ctes(PVALUES, P_ROWS, body="""
, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p) AS i, count(*) OVER (PARTITION BY grp) AS m FROM prow),
a AS (SELECT *, min(p * m / i) OVER (PARTITION BY grp ORDER BY p DESC, i DESC ROWS UNBOUNDED PRECEDING) AS adj FROM r)
SELECT grp, line_no, round(least(1.0::DOUBLE, min(adj) OVER (PARTITION BY grp, p)), 9) AS p_adj FROM a
"""))
def bh_adjust(spark, sf_dir):
    out = ST.bh_adjust(_p_rows(spark, sf_dir), ["grp"])
    return out.select("grp", "line_no", F.round("p_adj", 9).alias("p_adj"))


@query(with_ctes(PVALUES, P_ROWS, body="""
, t AS (SELECT *, log2(p * p * p * p + 1e-12::DOUBLE) AS l2, count(*) OVER (PARTITION BY grp) AS n,
               row_number() OVER (PARTITION BY grp ORDER BY p, line_no) AS rank FROM prow)
SELECT grp, line_no, round(l2, 6) AS log2_p FROM t WHERE l2 < log2(0.01::DOUBLE / n) AND rank <= 90
"""))
def bonferroni_keep(spark, sf_dir):
    rows = _p_rows(spark, sf_dir).withColumn("text", _small_p(F.col("p")).cast("string"))
    ranked = SP.running_sums(
        rows.select("grp", "line_no", "p", "text").withColumn("_one", F.lit(1)), ["grp"], ["p", "line_no"], ["_one"]
    ).withColumn("rank", F.col("_one_before") + 1)
    scored = ranked.withColumn("log2_p", ST.log2_scientific("text"))
    kept = ST.bonferroni_keep(scored, ["grp"], "log2_p", "rank", 90)
    return kept.select("grp", "line_no", F.round("log2_p", 6).alias("log2_p"))


RANK_PAIRS = [("N", "R"), ("A", "R"), ("A", "N")]


@query(with_ctes(PREDICTIONS, """
pairs(g1, g2) AS (VALUES ('N', 'R'), ('A', 'R'), ('A', 'N')),
r AS (
  SELECT g1, g2, dataset_id, quantity,
    rank() OVER (PARTITION BY g1, g2 ORDER BY quantity) + (count(*) OVER (PARTITION BY g1, g2, quantity) - 1) / 2.0::DOUBLE AS rk
  FROM predictions JOIN pairs ON dataset_id IN (g1, g2)),
t AS (SELECT g1, g2, sum(c * c * c - c) AS ties FROM (
  SELECT g1, g2, quantity, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY ALL) GROUP BY ALL),
s AS (
  SELECT g1, g2, count(*) FILTER (dataset_id = g1) AS n1, count(*) FILTER (dataset_id = g2) AS n2,
    sum(rk) FILTER (dataset_id = g1) AS r1 FROM r GROUP BY ALL),
w AS (SELECT g1, g2, n1, n2, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS w, ties FROM s JOIN t USING (g1, g2)),
z AS (SELECT *, abs((abs(w - n1 * n2 / 2.0::DOUBLE) - 0.5::DOUBLE)
        / sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE))))) AS z FROM w)""", body="""
SELECT g1, g2, n1, n2, round(w, 1) AS w, round(1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (
    SELECT sum(exp((2 * k + 1) * ln(z) - (k * ln(2) + lgamma(k + 1.5::DOUBLE) - lgamma(1.5::DOUBLE))))
    FROM range(0, 200) r(k)), 6) AS p
FROM z
"""))
def rank_sum_test(spark, sf_dir):
    out = ST.rank_sum_test(X.prediction_rows(spark, sf_dir), [], "dataset_id", "quantity", RANK_PAIRS)
    return out.select("g1", "g2", "n1", "n2", F.round("w", 1).alias("w"), F.round("p", 6).alias("p"))


@query(with_ctes(SCORES, """
c AS (SELECT cell, count(*) AS n, corr(ref_score, alt_score) AS r FROM scores GROUP BY cell),
t AS (SELECT *, CAST(n - 2 AS DOUBLE) AS v, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
s AS (SELECT cell, n, r, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * (t / 4000 / 3) * (
    SELECT sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
               * exp(-(v + 1) / 2 * ln(1 + (t * i / 4000) * (t * i / 4000) / v)))
    FROM range(0, 4001) q(i)) AS p FROM t)""", body="""
SELECT cell, n, round(r, 6) AS r, round(p, 6) AS p FROM s
"""))
def pearson_group(spark, sf_dir):
    return rounded(ST.pearson_test(X.score_rows(spark, sf_dir), ["cell"], "ref_score", "alt_score"))


@query(with_ctes(PVALUES, """
r AS (SELECT p_value + 1e-6::DOUBLE AS p, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS n FROM pvalues)""", body="""
SELECT i, round(-log10(p), 6) AS observed, round(-log10((i - a) / (n + 1 - 2 * a)), 6) AS expected
FROM (SELECT *, CASE WHEN n <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END AS a FROM r)
"""))
def qq_points(spark, sf_dir):
    rows = X.pvalue_rows(spark, sf_dir).select((F.col("p_value") + 1e-6).alias("p"))
    return rounded(ST.qq_points(rows, []).select("i", "observed", "expected"))


@query(with_ctes(SCORES, """
q AS (SELECT cell, quantile_cont(ref_score, 0.25) AS q1, quantile_cont(ref_score, 0.75) AS q3 FROM scores GROUP BY cell)""", body="""
SELECT line_no, cell, round(ref_score, 6) AS ref_score FROM scores JOIN q USING (cell)
WHERE ref_score BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)
"""))
def iqr_filter(spark, sf_dir):
    s = X.score_rows(spark, sf_dir).select("line_no", "cell", "ref_score")
    return rounded(ST.iqr_filter(s, ["cell"], "ref_score"))


# ------------------------------------------------------------------ splits

SPLIT_SIZES = "sizes AS (SELECT dataset_id, label, count(*) AS n FROM windows GROUP BY ALL)"


@query(with_ctes(WINDOWS, SPLIT_SIZES, body="""
SELECT dataset_id, label, split, n FROM (
  SELECT dataset_id, label, 'test' AS split, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS n FROM sizes UNION ALL
  SELECT dataset_id, label, 'valid', CAST(floor(n * 0.15::DOUBLE) AS BIGINT) FROM sizes UNION ALL
  SELECT dataset_id, label, 'train', n - 2 * CAST(floor(n * 0.15::DOUBLE) AS BIGINT) FROM sizes)
WHERE n > 0
"""))
def stratified_split3_sizes(spark, sf_dir):
    w = X.windows(spark, sf_dir).select("dataset_id", "label", "rec_id")
    return SP.stratified_split3(w, ["dataset_id", "label"]).groupBy("dataset_id", "label", "split").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(with_ctes(WINDOWS, SPLIT_SIZES, body="""
SELECT dataset_id, label, split, n FROM (
  SELECT dataset_id, label, 'test' AS split, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n FROM sizes UNION ALL
  SELECT dataset_id, label, 'train', n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) FROM sizes)
WHERE n > 0
"""))
def stratified_split2_sizes(spark, sf_dir):
    w = X.windows(spark, sf_dir).select("dataset_id", "label", "rec_id")
    return SP.stratified_split2(w, ["dataset_id", "label"]).groupBy("dataset_id", "label", "split").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(with_ctes(WINDOWS, "sizes AS (SELECT cell, label, count(*) AS n FROM windows GROUP BY ALL)",
                 "small AS (SELECT *, min(n) OVER (PARTITION BY cell) AS s FROM sizes)", body="""
SELECT cell, label, block, CAST(n AS BIGINT) AS n FROM (
  SELECT cell, label, 'head' AS block, floor(s * 50 / 100) AS n FROM small UNION ALL
  SELECT cell, label, 'tail', floor(s * 20 / 100) FROM small UNION ALL
  SELECT cell, label, 'middle', floor(s * 30 / 100) FROM small)
WHERE n > 0
"""))
def percent_partition_sizes(spark, sf_dir):
    w = X.windows(spark, sf_dir).select("cell", "label", "rec_id")
    blocks = SP.percent_partitions(w, ["cell"], "label", head_pct=50, tail_pct=20, mid_pct=30)
    return blocks.groupBy("cell", "label", "block").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- intervals

CELL_LINES = [str(i) for i in range(1, 8)]
OVERLAP = """
pairs AS (SELECT a.c AS c1, b.c AS c2 FROM (SELECT unnest(range(1, 8)) AS c) a, (SELECT unnest(range(1, 8)) AS c) b WHERE a.c < b.c),
ia AS (SELECT row_number() OVER () AS id, * FROM intervals),
hits AS (
  SELECT a.cell AS ca, b.cell AS cb, a.id FROM ia a JOIN ia b
  ON a.rbp = b.rbp AND a.chrom = b.chrom AND a.s < b.e AND b.s < a.e WHERE a.cell < b.cell)
"""


@query(with_ctes(INTERVALS, OVERLAP, body="""
SELECT c1 || '&' || c2 AS interaction, count(id) AS n_shared
FROM pairs LEFT JOIN hits ON ca = CAST(c1 AS VARCHAR) AND cb = CAST(c2 AS VARCHAR) GROUP BY ALL
"""))
def interval_overlap_raw(spark, sf_dir):
    return I.interval_overlap_count(X.interval_rows(spark, sf_dir), CELL_LINES, "raw")


@query(with_ctes(INTERVALS, OVERLAP, body="""
SELECT c1 || '&' || c2 AS interaction, count(DISTINCT id) AS n_shared
FROM pairs LEFT JOIN hits ON ca = CAST(c1 AS VARCHAR) AND cb = CAST(c2 AS VARCHAR) GROUP BY ALL
"""))
def interval_overlap_unique(spark, sf_dir):
    return I.interval_overlap_count(X.interval_rows(spark, sf_dir), CELL_LINES, "unique")
