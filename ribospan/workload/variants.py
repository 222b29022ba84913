"""Header parsing, substitution and model lookup queries."""

from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.functions import headers as H
from ribospan.functions import scores as SC
from ribospan.functions import sequence as S
from ribospan.operators import variants as V
from ribospan.plans import variant_scoring as P
from ribospan.session import materialize, new_path
from ribospan.streaming import scoring as STR
from ribospan.workload.inputs_sql import CATALOG, SCORES, VARIANTS, WINDOWS, grams
from ribospan.workload.registry import query, with_ctes

# Strict header parsed with regular expressions, alleles complemented on '-'.
PARSED = """
parsed AS (
  SELECT *, var_pos - seq_start AS idx0,
    CASE WHEN strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS r,
    CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS a
  FROM (
    SELECT rec_id, rbp, cell, dataset_id, header, seq,
      CAST(regexp_extract(header, ' chr[^:]+:(\\d+)-', 1) AS BIGINT) AS seq_start,
      regexp_extract(header, '\\(([+-])\\)', 1) AS strand,
      CAST(regexp_extract(header, ' (\\d+):[ACGT]>', 1) AS BIGINT) AS var_pos,
      regexp_extract(header, ':([ACGT])>', 1) AS ref,
      regexp_extract(header, '>([ACGT]) ', 1) AS alt
    FROM variants))
"""
APPLIED = """
applied AS (
  SELECT *,
    CASE WHEN idx0 < 0 OR idx0 >= length(seq) THEN 'out_of_bounds'
         WHEN substr(seq, CAST(idx0 AS INTEGER) + 1, 1) <> r THEN 'ref_mismatch' END AS reject_reason,
    substr(seq, 1, CAST(idx0 AS INTEGER)) || a || substr(seq, CAST(idx0 AS INTEGER) + 2) AS changed
  FROM parsed)
"""


@query(with_ctes(WINDOWS, VARIANTS, PARSED, body="""
SELECT rec_id, var_pos, ref, alt, strand, seq_start FROM parsed
"""))
def variant_parse(spark, sf_dir):
    v = X.variant_windows(spark, sf_dir)
    return v.select("rec_id", H.parse_header_strict("header").alias("p")).select("rec_id", "p.*")


@query(with_ctes(WINDOWS, VARIANTS, PARSED, body="""
SELECT strand, ref, alt, count(*) AS n, CAST(sum(var_pos - seq_start) AS BIGINT) AS idx_sum
FROM parsed GROUP BY ALL
"""))
def variant_parse_flexible(spark, sf_dir):
    v = X.variant_windows(spark, sf_dir)
    p = v.select(H.parse_header_flexible("header").alias("p")).select("p.*")
    return p.groupBy("strand", "ref", "alt").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("var_pos") - F.col("seq_start")).alias("idx_sum"),
    )


@query(with_ctes(WINDOWS, VARIANTS, CATALOG, body="""
SELECT rec_id, split_part(header, ':', 1) AS chrom,
  CAST(regexp_extract(header, ':(\\d+)-', 1) AS BIGINT) AS seq_start,
  CAST(regexp_extract(header, '-(\\d+)\\(', 1) AS BIGINT) AS seq_end,
  regexp_extract(header, '\\(([+-])\\)', 1) AS strand,
  CAST(regexp_extract(header, ' (\\d+):', 1) AS BIGINT) AS var_pos,
  regexp_extract(header, ':([ACGT])>', 1) AS ref, regexp_extract(header, '>([ACGT]) ', 1) AS alt,
  regexp_extract(header, ' (\\S+) in ', 1) AS protein, regexp_extract(header, ' in (\\S+)$', 1) AS cell_line
FROM catalog
"""))
def variant_parse_catalog(spark, sf_dir):
    c = X.catalog_windows(spark, sf_dir)
    return c.select("rec_id", H.parse_header_catalog("header").alias("p")).select("rec_id", "p.*")


@query(with_ctes(WINDOWS, VARIANTS, PARSED, APPLIED, body="""
SELECT rec_id, CAST(idx0 AS INTEGER) AS idx0, reject_reason,
       CASE WHEN reject_reason IS NULL THEN md5(changed) END AS scored_digest
FROM applied
"""))
def variant_apply(spark, sf_dir):
    a = V.apply_variant_gwas(X.variant_windows(spark, sf_dir), "after")
    return a.select("rec_id", "idx0", "reject_reason", S.text_digest("scored_seq").alias("scored_digest"))


@query(with_ctes(WINDOWS, VARIANTS, PARSED, APPLIED, body="""
SELECT dataset_id, reject_reason, count(*) AS n_rejected FROM applied
WHERE reject_reason IS NOT NULL GROUP BY ALL
"""))
def variant_rejects(spark, sf_dir):
    return P.rejects(V.apply_variant_gwas(X.variant_windows(spark, sf_dir), "before"), ["dataset_id"])


LOCATED = """
cat_parsed AS (
  SELECT *, CASE WHEN strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS r,
    CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS a,
    CAST(var_pos - seq_start AS INTEGER) AS i0
  FROM (
    SELECT rec_id, dataset_id, seq, header,
      CAST(regexp_extract(header, ':(\\d+)-', 1) AS BIGINT) AS seq_start,
      regexp_extract(header, '\\(([+-])\\)', 1) AS strand,
      CAST(regexp_extract(header, ' (\\d+):', 1) AS BIGINT) AS var_pos,
      regexp_extract(header, ':([ACGT])>', 1) AS ref, regexp_extract(header, '>([ACGT]) ', 1) AS alt
    FROM catalog)),
located AS (
  SELECT *, CASE
      WHEN i0 BETWEEN 0 AND length(seq) - 1 AND substr(seq, i0 + 1, 1) = r THEN 'ref'
      WHEN i0 BETWEEN 0 AND length(seq) - 1 AND substr(seq, i0 + 1, 1) = a THEN 'alt'
      WHEN i0 - 1 BETWEEN 0 AND length(seq) - 1 AND substr(seq, i0, 1) = r THEN 'ref'
      WHEN i0 - 1 BETWEEN 0 AND length(seq) - 1 AND substr(seq, i0, 1) = a THEN 'alt'
      ELSE 'none' END AS state,
    CASE
      WHEN i0 BETWEEN 0 AND length(seq) - 1 AND substr(seq, i0 + 1, 1) IN (r, a) THEN i0
      WHEN i0 - 1 BETWEEN 0 AND length(seq) - 1 AND substr(seq, i0, 1) IN (r, a) THEN i0 - 1 END AS idx
  FROM cat_parsed)
"""


@query(with_ctes(WINDOWS, VARIANTS, CATALOG, LOCATED, body="""
SELECT rec_id, idx AS idx0, state,
  md5(CASE WHEN state = 'ref' THEN substr(seq, 1, idx) || a || substr(seq, idx + 2) ELSE seq END) AS scored_digest
FROM located
"""))
def variant_locate(spark, sf_dir):
    a = V.apply_variant_catalog(X.catalog_windows(spark, sf_dir), "after")
    return a.select("rec_id", "found.idx0", "found.state", S.text_digest("scored_seq").alias("scored_digest"))


@query(with_ctes(WINDOWS, VARIANTS, CATALOG, LOCATED, body="""
SELECT dataset_id, count(*) AS n, CAST(sum(CASE WHEN state = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected
FROM located GROUP BY ALL
"""))
def variant_locate_strict(spark, sf_dir):
    a = V.apply_variant_catalog(X.catalog_windows(spark, sf_dir), "after", strict_ref_match=True)
    return a.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("reject_reason").alias("n_rejected")
    )


def _two_cells(df):
    """Records whose header ends in two cell names: their own and a second one."""
    other = F.when(F.col("cell") == "en", "fr").otherwise(F.lit("en"))
    return df.withColumn("header", F.concat_ws(" ", "header", "cell", other))


@query(with_ctes(WINDOWS, VARIANTS, PARSED, APPLIED, body="""
, models AS (SELECT DISTINCT dataset_id AS model_id, cell AS model_cell FROM windows),
r AS (SELECT *, CASE WHEN cell = 'en' THEN 'fr' ELSE 'en' END AS other FROM applied WHERE reject_reason IS NULL)
SELECT model_id, count(*) AS n_records, CAST(sum(length(changed)) AS BIGINT) AS n_bases
FROM r JOIN models ON model_cell IN (r.cell, r.other) GROUP BY ALL
"""))
def record_model_expand(spark, sf_dir):
    v = _two_cells(X.variant_windows(spark, sf_dir))
    models = X.windows(spark, sf_dir).select(F.col("dataset_id").alias("model_id")).distinct()
    applied = V.apply_variant_ribosnitch(v, "after").where(F.col("reject_reason").isNull())
    return V.record_model_expand(applied, models).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.length("scored_seq").cast("bigint")).alias("n_bases"),
    )


@query(with_ctes(WINDOWS, body="""
, models AS (SELECT DISTINCT dataset_id AS model_id FROM windows WHERE cell <> 'es')
SELECT dataset_id AS model_id, count(*) AS n_records, dataset_id IN (SELECT model_id FROM models) AS found
FROM windows GROUP BY ALL
"""))
def model_lookup(spark, sf_dir):
    w = X.windows(spark, sf_dir)
    records = w.select("rec_id", F.col("dataset_id").alias("model_id"))
    # Spanish has no models, so records are skipped on data of any size.
    models = w.where("cell <> 'es'").select(F.col("dataset_id").alias("model_id")).distinct()
    hit = V.model_lookup(records, models).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_records"))
    miss = V.skipped_models(records, models).withColumnRenamed("n_skipped", "n_records")
    return hit.withColumn("found", F.lit(True)).unionByName(miss.withColumn("found", F.lit(False)))


@query(with_ctes(WINDOWS, body="""
SELECT name, CASE
    WHEN suffix(name, 'K562') THEN replace(name, 'K562', 'HepG2')
    WHEN suffix(name, 'HEK293') THEN replace(name, 'HEK293', 'HepG2')
    WHEN suffix(name, 'HEK293T') THEN replace(name, 'HEK293T', 'HepG2')
    WHEN suffix(name, 'Hela') THEN replace(name, 'Hela', 'HepG2')
    WHEN suffix(name, 'H9') THEN replace(name, 'H9', 'HepG2')
    WHEN suffix(name, 'HepG2') THEN replace(name, 'HepG2', 'K562') END AS other, n
FROM (
  SELECT rbp || '_' || CASE cell WHEN 'en' THEN 'K562' WHEN 'fr' THEN 'HepG2' WHEN 'de' THEN 'HEK293T' ELSE 'IMR90' END AS name,
         count(*) AS n
  FROM windows GROUP BY ALL)
"""))
def transfer_names(spark, sf_dir):
    cell = (
        F.when(F.col("cell") == "en", "K562").when(F.col("cell") == "fr", "HepG2")
        .when(F.col("cell") == "de", "HEK293T").otherwise("IMR90")
    )
    names = X.windows(spark, sf_dir).select(F.concat_ws("_", "rbp", cell).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "other", SC.transfer_model_name("name")
    )


# One linear model per dataset whose weights follow from its base composition.
MODELS = """
models AS (
  SELECT dataset_id AS model_id, kmer, count(*) / sum(count(*)) OVER (PARTITION BY dataset_id) AS weight
  FROM g2 GROUP BY dataset_id, kmer)
"""


def _models(spark, sf_dir):
    from ribospan.operators.kmers import kmer_counts

    counts = kmer_counts(X.windows(spark, sf_dir), 2, ["dataset_id"])
    total = counts.groupBy("dataset_id").agg(F.sum("n").alias("t"))
    rows = counts.join(total, "dataset_id").select(
        "dataset_id", F.struct("kmer", (F.col("n") / F.col("t")).alias("w")).alias("e")
    )
    models = rows.groupBy(F.col("dataset_id").alias("model_id")).agg(
        F.map_from_entries(F.collect_list("e")).alias("weights")
    )
    # A model table is stored, so its size decides how it is joined.
    return materialize(models.withColumn("bias", F.lit(-0.5)))


@query(with_ctes(WINDOWS, grams(2, "g2"), MODELS, VARIANTS, PARSED, APPLIED,
                 "ok AS (SELECT * FROM applied WHERE reject_reason IS NULL)",
                 grams(2, "changed_grams", "ok", "changed", "rec_id, dataset_id, changed"), body="""
SELECT dataset_id, count(*) AS n, round(avg(score), 9) AS mean_score FROM (
  SELECT o.dataset_id, o.rec_id, -0.5::DOUBLE + coalesce(sum(weight), 0) AS score
  FROM ok o LEFT JOIN changed_grams g ON g.rec_id = o.rec_id
  LEFT JOIN models m ON m.model_id = o.dataset_id AND m.kmer = g.kmer
  GROUP BY ALL)
GROUP BY dataset_id
"""))
def variant_scoring(spark, sf_dir):
    scored = P.score_gwas(
        X.variant_windows(spark, sf_dir), _models(spark, sf_dir), "after", P.linear_scorer(2)
    )
    return scored.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score")
    )


@query(with_ctes(WINDOWS, grams(2, "g2"), MODELS, VARIANTS, PARSED, APPLIED, """
ok AS (SELECT *, CASE WHEN cell = 'en' THEN 'fr' ELSE 'en' END AS other FROM applied WHERE reject_reason IS NULL)""",
                 grams(2, "changed_grams", "ok", "changed", "rec_id, dataset_id, changed"), """
cells AS (SELECT DISTINCT dataset_id AS model_id, cell AS model_cell FROM windows)""", body="""
SELECT model_id, count(*) AS n, round(avg(score), 9) AS mean_score FROM (
  SELECT c.model_id, o.rec_id, -0.5::DOUBLE + coalesce(sum(weight), 0) AS score
  FROM ok o JOIN cells c ON c.model_cell IN (o.cell, o.other)
  LEFT JOIN changed_grams g ON g.rec_id = o.rec_id
  LEFT JOIN models m ON m.model_id = c.model_id AND m.kmer = g.kmer
  GROUP BY ALL)
GROUP BY model_id
"""))
def ribosnitch_scoring(spark, sf_dir):
    """Every model of either of a record's two cell lines."""
    scored = P.score_ribosnitch(
        _two_cells(X.variant_windows(spark, sf_dir)), _models(spark, sf_dir), "after", scorer=P.linear_scorer(2)
    )
    return scored.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score")
    )


@query(with_ctes(WINDOWS, grams(2, "g2"), MODELS, VARIANTS, PARSED, APPLIED,
                 "ok AS (SELECT * FROM applied WHERE reject_reason IS NULL)",
                 grams(2, "changed_grams", "ok", "changed", "rec_id, dataset_id, changed"), body="""
SELECT o.rec_id, round(-0.5::DOUBLE + coalesce(sum(weight), 0), 9) AS score, md5(any_value(o.header)) AS header_digest
FROM ok o LEFT JOIN changed_grams g ON g.rec_id = o.rec_id
LEFT JOIN models m ON m.model_id = o.dataset_id AND m.kmer = g.kmer
GROUP BY o.rec_id
"""))
def streamed_scoring(spark, sf_dir):
    """The scoring as a stream of files into a sink keyed by batch; equal to the batch form."""
    source, out, state = (new_path(spark, kind) for kind in ("stream", "scores", "progress"))
    records = X.variant_windows(spark, sf_dir).select("dataset_id", "header", "seq")
    # Files for all cores, in three batches.
    files = max(6, 3 * spark.sparkContext.defaultParallelism)
    records.repartition(files).write.option("maxRecordsPerFile", 500_000).parquet(source)
    written = spark.read.parquet(source).select(F.input_file_name().alias("f")).distinct().count()
    stream = STR.read_record_stream(spark, source, records.schema, files_per_batch=max(2, -(-written // 3)))
    STR.score_stream_once(stream, _models(spark, sf_dir), out, state, scorer=P.linear_scorer(2)).awaitTermination()
    rec_id = F.regexp_extract("header", r"variant_(\d+)", 1).cast("bigint").alias("rec_id")
    return STR.read_scores(spark, out).select(rec_id, F.round("score", 9).alias("score"), F.md5("header").alias("header_digest"))


@query(with_ctes(WINDOWS, VARIANTS, CATALOG, body="""
SELECT rec_id, rbp AS protein, cell AS cell_line FROM catalog
"""))
def variant_parse_without_in(spark, sf_dir):
    """Catalog headers that end in protein, one more word and cell, without the word "in"."""
    c = X.catalog_windows(spark, sf_dir)
    plain = F.regexp_replace("header", " in (\\S+)$", " near $1")
    found = H.parse_protein_cell(F.split(plain, " "))
    return c.select("rec_id", found["protein"].alias("protein"), found["cell_line"].alias("cell_line"))


@query(with_ctes(WINDOWS, grams(2, "g2"), MODELS, VARIANTS, CATALOG, LOCATED,
                 """s AS (SELECT rec_id, dataset_id, CASE WHEN state = 'ref'
                    THEN substr(seq, 1, idx) || a || substr(seq, idx + 2) ELSE seq END AS changed FROM located)""",
                 grams(2, "changed_grams", "s", "changed", "rec_id, dataset_id, changed"), body="""
SELECT dataset_id, count(*) AS n, round(avg(score), 9) AS mean_score FROM (
  SELECT o.dataset_id, o.rec_id, -0.5::DOUBLE + coalesce(sum(weight), 0) AS score
  FROM s o LEFT JOIN changed_grams g ON g.rec_id = o.rec_id
  LEFT JOIN models m ON m.model_id = o.dataset_id AND m.kmer = g.kmer
  GROUP BY ALL)
GROUP BY dataset_id
"""))
def catalog_scoring(spark, sf_dir):
    scored = P.score_catalog(
        X.catalog_windows(spark, sf_dir), _models(spark, sf_dir), "after", scorer=P.linear_scorer(2)
    )
    return scored.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score")
    )


def _run_scores(spark, sf_dir, models, mode):
    scored = P.score_gwas(X.variant_windows(spark, sf_dir), models, mode, P.linear_scorer(2))
    return scored.select("dataset_id", "rec_id", "score")


def _scored_sql(seq: str) -> list[str]:
    return [
        f"run_{seq}_grams AS (SELECT rec_id, dataset_id, substr({seq}, i, 2) AS kmer FROM "
        f"(SELECT rec_id, dataset_id, {seq}, unnest(range(1, length({seq}))) AS i FROM ok))",
        f"run_{seq} AS (SELECT o.rec_id, o.dataset_id, -0.5::DOUBLE + coalesce(sum(weight), 0) AS score FROM ok o "
        f"LEFT JOIN run_{seq}_grams g ON g.rec_id = o.rec_id LEFT JOIN models m "
        f"ON m.model_id = o.dataset_id AND m.kmer = g.kmer GROUP BY ALL)",
    ]


@query(with_ctes(WINDOWS, grams(2, "g2"), MODELS, VARIANTS, PARSED, APPLIED,
                 "ok AS (SELECT * FROM applied WHERE reject_reason IS NULL)",
                 *_scored_sql("seq"), *_scored_sql("changed"), body="""
SELECT dataset_id, count(*) AS n, round(avg(abs(b - a)), 9) AS abs_diff,
       round(avg((b - a) * (b - a)), 9) AS squared_diff,
       round(avg(CASE WHEN b <> 0 THEN abs(b - a) / b END), 9) AS relative_diff,
       round(avg(abs(1 / (1 + exp(-a)) - 1 / (1 + exp(-b)))), 9) AS shift
FROM (SELECT x.dataset_id, x.score AS b, y.score AS a FROM run_seq x JOIN run_changed y USING (rec_id))
GROUP BY dataset_id
"""))
def pair_before_after(spark, sf_dir):
    keys = ["dataset_id", "rec_id"]
    models = _models(spark, sf_dir)
    pairs = V.pair_before_after(
        _run_scores(spark, sf_dir, models, "before"), _run_scores(spark, sf_dir, models, "after"), keys
    )
    d = SC.pair_difference("ref_score", "alt_score")
    return pairs.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(c), 9).alias(k) for k, c in d.items()],
        F.round(F.avg(SC.probability_shift("alt_score", "ref_score")), 9).alias("shift"),
    )


@query(with_ctes(SCORES, body="""
SELECT line_no, variant, rbp, cell FROM scores a
WHERE EXISTS (SELECT 1 FROM scores b WHERE b.variant = a.variant AND b.rbp = a.rbp AND b.ref_score >= 0)
"""))
def semi_filter_after(spark, sf_dir):
    s = X.score_rows(spark, sf_dir)
    gated = s.where(SC.score_gate("ref_score", inclusive=True))
    return V.semi_filter_after(s, gated, ["variant", "rbp"]).select("line_no", "variant", "rbp", "cell")
