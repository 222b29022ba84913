"""The text formats: lines made from the driver tables, through the writers' formats and the readers' parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.sources import readers as R
from ribospan.sources import writers as WR
from ribospan.workload.inputs_sql import CATALOG, INTERVALS, SCORES, VARIANTS, WINDOWS
from ribospan.workload.registry import query, with_ctes


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _triplets(spark, sf_dir):
    w = X.windows(spark, sf_dir)
    track = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: (i % 10).cast("string")), ",")
    value = F.concat_ws("\n", F.concat(F.lit("rec"), _s("rec_id")), F.translate("seq", "T", "U"), track)
    name = F.concat("dataset_id", F.when(F.col("label") == 1, "_pos.fa").otherwise("_neg.fa"))
    return w.select(name.alias("file_name"), value.alias("value"))


TRIPLET_SQL = """
SELECT dataset_id, 'rec' || rec_id AS rec_id, replace(seq, 'T', 'U') AS seq, label,
       (length(seq) // 10 * 45 + (length(seq) % 10) * (length(seq) % 10 + 1) // 2)::DOUBLE AS track_total
FROM windows
"""


@query(with_ctes(WINDOWS, body=TRIPLET_SQL))
def source_triplet_fasta(spark, sf_dir):
    total = F.aggregate("track", F.lit(0.0), lambda a, x: a + x).alias("track_total")
    return R.parse_triplet_fasta(_triplets(spark, sf_dir)).select("dataset_id", "rec_id", "seq", "label", total)


@query(with_ctes(WINDOWS, body="""
SELECT dataset_id, count(*) FILTER (rec_id % 3 = 0) AS n_bad, count(*) FILTER (rec_id % 3 <> 0) AS n_good
FROM windows GROUP BY dataset_id
"""))
def source_triplet_fasta_lenient(spark, sf_dir):
    rows = _triplets(spark, sf_dir)
    number = F.regexp_extract("value", r"^rec(\d+)", 1).cast("bigint")
    cut = F.when(number % 3 == 0, F.concat("value", F.lit(",1"))).otherwise(F.col("value"))
    read = R.parse_triplet_fasta(rows.withColumn("value", cut), strict=False)
    bad = F.col("bad_reason") == "length mismatch"
    return read.groupBy("dataset_id").agg(
        F.count(F.when(bad, 1)).alias("n_bad"), F.count(F.when(F.col("bad_reason").isNull(), 1)).alias("n_good")
    )


@query(with_ctes(WINDOWS, body="SELECT dataset_id, '>rec ' || rec_id AS header, seq FROM windows"))
def source_fasta(spark, sf_dir):
    wrapped = F.regexp_replace(F.lower("seq"), "(.{1,60})", "$1\n")
    rows = X.windows(spark, sf_dir).select(
        F.concat("dataset_id", F.lit(".fa")).alias("file_name"),
        F.concat(F.lit("rec "), _s("rec_id"), F.lit("\n"), wrapped).alias("value"),
    )
    return R.parse_fasta(rows)


@query(with_ctes(WINDOWS, body="""
SELECT substr(seq, 1, 50) AS seq, CASE WHEN rec_id % 4 = 1 THEN 0 ELSE label END AS label
FROM windows WHERE rec_id % 4 <> 2
"""))
def source_kmer_lenient(spark, sf_dir):
    label = F.when(F.col("rec_id") % 4 == 2, "label").otherwise(_s("label"))
    value = F.concat_ws("\t", F.lower("seq"), F.when(F.col("rec_id") % 4 != 1, label))
    rows = X.windows(spark, sf_dir).select(F.lit("k.tsv").alias("file_name"), value.alias("value"))
    return R.parse_lenient_kmers(rows, 50)


@query("""
SELECT label::VARCHAR AS dataset_id, 'v' || vec_id AS rec_id, t.name AS structure_type,
       list_sum([floor(x::DOUBLE * 1000.0::DOUBLE) * t.i for x in embedding]) AS total
FROM embeddings, (VALUES (1, 'paired'), (2, 'hairpin'), (3, 'inner'), (4, 'multi'), (5, 'external')) AS t(i, name)
""")
def source_structure_profiles(spark, sf_dir):
    row = lambda i: F.array_join(F.transform("scores", lambda x: (F.floor(x * 1000.0) * i).cast("string")), "\t")
    rows = X.profile_rows(spark, sf_dir).select(
        F.concat(_s("grp"), F.lit(".txt")).alias("file_name"),
        F.concat_ws("\n", F.concat(F.lit("v"), _s("rec_id")), *[row(i) for i in range(1, 6)]).alias("value"),
    )
    total = F.aggregate("profile", F.lit(0.0), lambda a, x: a + x).alias("total")
    return R.parse_structure_profiles(rows, 64).select("dataset_id", "rec_id", "structure_type", total)


@query(with_ctes(INTERVALS, body="""
SELECT rbp, cell, chrom, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM intervals GROUP BY ALL
"""))
def source_bed(spark, sf_dir):
    rows = X.interval_rows(spark, sf_dir).select(
        F.concat("rbp", F.lit("_"), "cell", F.lit(".bed")).alias("file_name"),
        F.concat_ws("\t", "chrom", _s("start"), _s("end"), F.lit("peak"), F.lit("0")).alias("value"),
    )
    return R.parse_bed(rows).groupBy("rbp", "cell", "chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends")
    )


@query(with_ctes(WINDOWS, VARIANTS, body="""
SELECT rbp, cell, CASE WHEN rec_id % 2 = 0 THEN 'before' ELSE 'after' END AS mode, 'rs' || rec_id AS rsid,
       (rec_id % 1000) / 1000.0::DOUBLE AS score, 'utr' AS region, rec_id * 1000 AS start_pos,
       rec_id * 1000 + length(seq) AS end_pos, substr(header, 2) AS header
FROM variants
"""))
def source_score_lines(spark, sf_dir):
    """The GWAS line format, written and parsed."""
    scored = X.variant_windows(spark, sf_dir).withColumn("score", (F.col("rec_id") % 1000) / F.lit(1000.0))
    mode = F.when(F.col("rec_id") % 2 == 0, "before").otherwise("after")
    rows = scored.select(
        F.concat("rbp", F.lit("_"), "cell", F.lit("_"), mode, F.lit("_mut.txt")).alias("file_name"),
        WR.gwas_line().alias("value"),
    )
    read = R.parse_score_lines(rows)
    return read.select("rbp", "cell", "mode", "rsid", "score", "region", "start_pos", "end_pos", "header")


@query(with_ctes(WINDOWS, VARIANTS, CATALOG, body="""
SELECT header || chr(9) || 'model_id=' || dataset_id || chr(9) || 'mode=after' || chr(9)
       || 'Prediction_score:' || printf('%.6f', (rec_id % 1000) / 1000.0::DOUBLE) AS line
FROM catalog
"""))
def sink_catalog_lines(spark, sf_dir):
    scored = X.catalog_windows(spark, sf_dir).withColumn("score", (F.col("rec_id") % 1000) / F.lit(1000.0))
    return scored.withColumnRenamed("dataset_id", "model_id").select(WR.catalog_line("after").alias("line"))


@query(with_ctes(SCORES, body="""
SELECT 'v' || variant AS variant, 'R' || rbp AS rbp, cell, line_no, floor(maf * 1000.0::DOUBLE) AS score FROM scores
"""))
def source_ribosnitch_scores(spark, sf_dir):
    rows = X.score_rows(spark, sf_dir).select(
        F.lit("x.txt").alias("file_name"),
        F.concat_ws(
            " ", F.concat(F.lit("v"), _s("variant")), F.lit("chr1:1"), F.lit("5"), F.lit("A"), F.lit("B"),
            F.concat(F.lit("R"), _s("rbp"), F.lit("_"), "cell"), _s(F.floor(F.col("maf") * 1000.0)), _s("line_no"),
        ).alias("value"),
    )
    return R.parse_ribosnitch_scores(rows).select("variant", "rbp", "cell", "line_no", "score")


@query(with_ctes(SCORES, body="""
SELECT 'R' || rbp || '_' || cell AS dataset_id, floor(maf * 1000.0::DOUBLE) AS auc, count(*) AS n
FROM scores WHERE line_no % 2 = 0 GROUP BY ALL
"""))
def source_eval_log(spark, sf_dir):
    """Every second line is a remark that is no result."""
    text = F.concat(F.lit("R"), _s("rbp"), F.lit("_"), "cell", F.lit(" AUC: "), _s(F.floor(F.col("maf") * 1000.0)))
    value = F.when(F.col("line_no") % 2 == 0, text).otherwise(F.lit("loading model auc"))
    rows = X.score_rows(spark, sf_dir).select(F.lit("e.log").alias("file_name"), value.alias("value"))
    return R.parse_eval_log(rows).groupBy("dataset_id", "auc").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(SCORES, body="""
SELECT 'run' || rbp AS run, 'D_' || cell AS dataset_id, line_no::INTEGER AS epoch,
       floor(maf * 1000.0::DOUBLE) AS auc, floor(maf * 100.0::DOUBLE) AS mcc
FROM scores
"""))
def source_training_log(spark, sf_dir):
    number = lambda n: _s(F.floor(F.col("maf") * n))
    value = F.concat(
        F.lit("D_"), "cell", F.lit(" Test Epoch: "), _s("line_no"), F.lit(" avg.loss: 0.5 Acc: 81.5%, AUC: "),
        number(1000.0), F.lit(" (0.9), PRC: 0.7, MCC: "), number(100.0),
    )
    rows = X.score_rows(spark, sf_dir).select(
        F.concat(F.lit("run"), _s("rbp"), F.lit(".log")).alias("file_name"), value.alias("value")
    )
    return R.parse_training_log(rows).select("run", "dataset_id", "epoch", "auc", "mcc")


@query("""
SELECT 'v' || vec_id AS dataset_id, ['AGG', 'GU', 'UUU'][t.i] AS motif,
       sum(floor(embedding[t.i * 20 - 20 + k]::DOUBLE * 100.0::DOUBLE)) AS total, count(*) AS n
FROM embeddings, (VALUES (1), (2), (3)) AS t(i), range(1, 21) AS r(k) GROUP BY ALL
""")
def source_position_rows(spark, sf_dir):
    row = lambda i: F.array_join(
        F.transform(F.slice("scores", i * 20 - 19, 20), lambda x: F.floor(x * 100.0).cast("string")), ","
    )
    rows = X.profile_rows(spark, sf_dir).select(
        F.concat(F.lit("v"), _s("rec_id"), F.lit("_relative_positions.txt")).alias("file_name"),
        F.concat_ws("\n", row(1), row(2), row(3)).alias("value"),
    )
    read = R.parse_position_rows(rows, ["AGG", "GU", "UUU"])
    return read.groupBy("dataset_id", "motif").agg(F.sum("distance").alias("total"), F.count(F.lit(1)).alias("n"))


@query(with_ctes(WINDOWS, """
bases AS (
  SELECT dataset_id, i - 1 AS pos, replace(substr(seq, i, 1), 'T', 'U') AS symbol
  FROM windows, range(1, 9) AS r(i) WHERE length(seq) >= 8)""", """
sizes AS (SELECT dataset_id, pos, count(*) AS n FROM bases GROUP BY ALL)""", body="""
SELECT s.dataset_id, s.dataset_id AS motif, s.pos::INTEGER AS pos, a.symbol,
       round(coalesce(count(b.symbol), 0) / any_value(s.n)::DOUBLE, 6) AS p
FROM sizes s CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('U')) AS a(symbol)
LEFT JOIN bases b ON b.dataset_id = s.dataset_id AND b.pos = s.pos AND b.symbol = a.symbol
GROUP BY s.dataset_id, s.pos, a.symbol
"""))
def source_meme_round_trip(spark, sf_dir):
    """Base shares of the first eight positions of each dataset, as MEME text and back."""
    w = X.windows(spark, sf_dir).where(F.length("seq") >= 8)
    cells = w.select("dataset_id", F.posexplode(F.split(F.translate(F.substring("seq", 1, 8), "T", "U"), "")).alias("pos", "symbol"))
    counts = cells.where("symbol <> ''").groupBy("dataset_id", "pos", "symbol").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("dataset_id", "pos").agg(F.sum("n").alias("total"))
    pwm = counts.join(sizes, ["dataset_id", "pos"]).select("dataset_id", "pos", "symbol", (F.col("n") / F.col("total")).alias("p"))
    texts = WR.meme_text(pwm, ["dataset_id"]).select(
        F.concat("dataset_id", F.lit(".meme")).alias("file_name"), F.explode(F.split("value", "MOTIF ")).alias("value")
    )
    return R.parse_meme(texts).withColumn("p", F.round("p", 6))
