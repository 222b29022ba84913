"""K-mer, encoding and feature queries over whole texts."""

from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.functions import sequence as S
from ribospan.functions.special import track_sums
from ribospan.operators import features as FE
from ribospan.operators import kmers as K
from ribospan.workload.inputs_sql import CELLS, PROFILES, WINDOWS, grams
from ribospan.workload.registry import query, with_ctes

BY = ["dataset_id"]


def big(c):
    return c.cast("bigint")


@query(with_ctes(WINDOWS, grams(5), body="""
SELECT dataset_id, kmer, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, kmer) AS rank
  FROM (SELECT dataset_id, kmer, count(*) AS n FROM grams GROUP BY ALL))
WHERE rank <= 10
"""))
def kmer_topk(spark, sf_dir):
    return K.top_kmers(K.kmer_counts(X.windows(spark, sf_dir), 5, BY), BY, 10)


@query(with_ctes(WINDOWS, grams(3), body="""
, alphabet AS (SELECT unnest(['A','C','G','T']) AS c),
grid AS (
  SELECT dataset_id, a.c || b.c || d.c AS kmer
  FROM (SELECT DISTINCT dataset_id FROM windows) x, alphabet a, alphabet b, alphabet d),
counts AS (SELECT dataset_id, kmer, count(*) AS n FROM grams GROUP BY ALL),
records AS (SELECT dataset_id, count(*) AS r FROM windows WHERE label = 1 GROUP BY ALL)
SELECT g.dataset_id, g.kmer, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / r, 6) AS rate
FROM grid g JOIN records USING (dataset_id) LEFT JOIN counts c ON c.dataset_id = g.dataset_id AND c.kmer = g.kmer
WHERE g.dataset_id IN (SELECT dataset_id FROM counts)
"""))
def kmer_rate_grid(spark, sf_dir):
    w = X.windows(spark, sf_dir)
    grid = K.complete_grid(K.kmer_counts(w, 3, BY), 3, BY)
    rates = K.normalize_by_count(grid, K.records_per_dataset(w, BY), BY)
    return rates.withColumn("rate", F.round("rate", 6))


@query(with_ctes(WINDOWS, body="""
SELECT dataset_id,
  CAST(sum(length(seq) - length(replace(seq, 'A', ''))) AS BIGINT) AS n_a,
  CAST(sum(length(seq) - length(replace(seq, 'C', ''))) AS BIGINT) AS n_c,
  CAST(sum(length(seq) - length(replace(seq, 'G', ''))) AS BIGINT) AS n_g,
  CAST(sum(length(seq) - length(replace(seq, 'T', ''))) AS BIGINT) AS n_t
FROM windows GROUP BY dataset_id
"""))
def base_composition(spark, sf_dir):
    return K.base_composition(X.windows(spark, sf_dir), BY)


@query(with_ctes(WINDOWS, body="""
SELECT dataset_id, count(*) AS n_records FROM windows WHERE label = 1 GROUP BY dataset_id
"""))
def positives_per_dataset(spark, sf_dir):
    return K.records_per_dataset(X.windows(spark, sf_dir), BY)


@query(with_ctes(WINDOWS, grams(3), body="""
, counts AS (SELECT dataset_id, kmer, CAST(count(*) AS DOUBLE) AS n FROM grams GROUP BY ALL),
z AS (
  SELECT dataset_id, kmer,
    (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS z
  FROM counts WINDOW w AS (PARTITION BY kmer)),
q AS (SELECT quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM z)
SELECT dataset_id, kmer, round(greatest(least(z, hi), lo), 6) AS z FROM z, q
"""))
def kmer_scaled_winsorized(spark, sf_dir):
    counts = K.kmer_counts(X.windows(spark, sf_dir), 3, BY)
    z = K.scale_columns(counts, "kmer", "n")
    return K.winsorize(z.select("dataset_id", "kmer", "z"), "z").withColumn("z", F.round("z", 6))


@query(with_ctes(WINDOWS, body="""
SELECT dataset_id, count(*) AS n_records,
  CAST(sum(CASE WHEN length(seq) >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_rebuilt,
  CAST(sum(greatest(length(seq) - 3, 0)) AS BIGINT) AS n_kmers
FROM windows GROUP BY dataset_id
"""))
def kmer_roundtrip(spark, sf_dir):
    grams_ = X.windows(spark, sf_dir).withColumn("g", S.kmers("seq", 4))
    rebuilt = F.when(F.size("g") > 0, S.kmers_to_seq("g")) == F.col("seq")
    return grams_.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(big(F.coalesce(rebuilt, F.lit(False)).cast("int"))).alias("n_rebuilt"),
        F.sum(big(F.size("g"))).alias("n_kmers"),
    )


@query(with_ctes(WINDOWS, CELLS, body="""
SELECT CAST(pos - 1 + (120 - length(rna)) // 2 AS INTEGER) AS pos,
       replace(ch, 'U', 'T') AS channel, count(*) AS n
FROM cells GROUP BY ALL
"""))
def one_hot_profile(spark, sf_dir):
    cells = FE.one_hot_long(X.windows(spark, sf_dir), ["rec_id"], max_len=120)
    return cells.groupBy("pos", "channel").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(WINDOWS, CELLS, body="""
SELECT dataset_id, replace(ch, 'U', 'T') AS channel, round(sum(pos / 101.0::DOUBLE), 4) AS weight,
       count(*) AS n
FROM cells GROUP BY ALL
"""))
def weighted_one_hot_totals(spark, sf_dir):
    weights = F.lit([i / X.WINDOW_LETTERS for i in range(1, X.WINDOW_LETTERS + 1)])
    w = X.windows(spark, sf_dir).withColumn("weights", F.slice(weights, F.lit(1), F.length("seq")))
    tracks = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), track_sums(S.weighted_one_hot("seq", "weights", c)).alias("t"))
            for c in S.DNA
        ]
    )
    return (
        w.select(*BY, tracks.alias("tracks"))
        .select(*BY, F.inline("tracks"))
        .groupBy(*BY, "channel")
        .agg(F.round(F.sum("t.total"), 4).alias("weight"), F.sum("t.present").alias("n"))
        .where(F.col("n") > 0)
    )


@query(with_ctes(WINDOWS, CELLS, body="""
SELECT dataset_id, CAST(sum(ids) AS BIGINT) AS id_sum, CAST(sum(mask) AS BIGINT) AS mask_sum,
       CAST(sum(101) AS BIGINT) AS length_sum
FROM (
  SELECT dataset_id, rec_id, 2 + 3 + sum(CASE WHEN pos <= 99 THEN
      CASE ch WHEN 'A' THEN 6 WHEN 'C' THEN 7 WHEN 'G' THEN 8 WHEN 'U' THEN 9 END ELSE 0 END) AS ids,
    2 + sum(CASE WHEN pos <= 99 THEN 1 ELSE 0 END) AS mask
  FROM cells GROUP BY ALL)
GROUP BY dataset_id
"""))
def token_ids(spark, sf_dir):
    t = X.windows(spark, sf_dir).select(*BY, S.tokenize_ids(S.kmers("seq", 1), 101).alias("t"))
    add = lambda c: F.sum(big(F.aggregate(c, F.lit(0), lambda a, x: a + x)))
    return t.groupBy(*BY).agg(
        add(F.col("t.input_ids")).alias("id_sum"), add(F.col("t.attention_mask")).alias("mask_sum"),
        F.sum(big(F.size("t.input_ids"))).alias("length_sum"),
    )


@query(with_ctes(WINDOWS, CELLS, body="""
SELECT dataset_id, CAST(sum(CASE ch WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END) AS BIGINT) AS code_sum,
       count(*) AS n
FROM cells GROUP BY dataset_id
"""))
def int_codes(spark, sf_dir):
    codes = X.windows(spark, sf_dir).select(*BY, S.int_encode("seq").alias("c"))
    return codes.groupBy(*BY).agg(
        F.sum(big(F.aggregate("c", F.lit(0), lambda a, x: a + x))).alias("code_sum"),
        F.sum(big(F.size("c"))).alias("n"),
    )


@query(with_ctes(WINDOWS, grams(2), body="""
, per AS (SELECT dataset_id, rec_id, replace(kmer, 'T', 'U') AS kmer, count(*) AS c FROM grams GROUP BY ALL)
SELECT dataset_id, kmer, CAST(sum(c) AS BIGINT) AS n, round(sum(c * c / 100.0::DOUBLE), 4) AS total
FROM per GROUP BY ALL
"""))
def kmer_position_features(spark, sf_dir):
    f = X.windows(spark, sf_dir).select(
        *BY, F.inline(FE.kmer_position_features(S.normalize_rna("seq"), 2))
    )
    return f.groupBy(*BY, "kmer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(with_ctes(WINDOWS, CELLS, body="""
SELECT dataset_id, 0 AS channel, round(sum(CASE WHEN ch IN ('A','G') THEN 1.0::DOUBLE ELSE 0 END), 4) AS total FROM cells GROUP BY dataset_id
UNION ALL
SELECT dataset_id, 1, round(sum(CASE WHEN ch IN ('A','C') THEN 1.0::DOUBLE ELSE 0 END), 4) FROM cells GROUP BY dataset_id
UNION ALL
SELECT c.dataset_id, 2, round(t + pad, 4) FROM
  (SELECT dataset_id, sum(CASE WHEN ch IN ('A','U') THEN 1.0::DOUBLE ELSE 0 END) AS t FROM cells GROUP BY dataset_id) c
  JOIN (SELECT dataset_id, CAST(sum(101 - length(seq)) AS DOUBLE) AS pad FROM windows GROUP BY dataset_id) p USING (dataset_id)
"""))
def chemistry_totals(spark, sf_dir):
    rows = X.windows(spark, sf_dir).select(
        *BY, F.explode(FE.chemistry_features(S.normalize_rna("seq"))).alias("c")
    )
    return (
        rows.select(*BY, F.posexplode("c").alias("channel", "v"))
        .groupBy(*BY, "channel")
        .agg(F.round(F.sum("v"), 4).alias("total"))
    )


def _property_sql() -> str:
    rows = ", ".join(
        "(" + f"'{k}', " + ", ".join(repr(float(x)) + "::DOUBLE" for x in v) + ")"
        for k, v in FE.DINUCLEOTIDES.items()
    )
    names = ", ".join(FE.DINUCLEOTIDE_PROPERTIES)
    means = ", ".join(f"round(sum({p} / 101) / count(*), 9) AS {p}" for p in FE.DINUCLEOTIDE_PROPERTIES)
    return with_ctes(
        WINDOWS, grams(2), f"props(d, {names}) AS (VALUES {rows})",
        body=f"SELECT dataset_id, {means} FROM grams JOIN props ON d = replace(kmer, 'T', 'U') GROUP BY dataset_id",
    )


@query(_property_sql())
def dinucleotide_mean(spark, sf_dir):
    rna = X.windows(spark, sf_dir).withColumn("rna", S.normalize_rna("seq"))
    rows = rna.select(
        *BY, F.posexplode(FE.dinucleotide_features("rna")).alias("pos", "v"), F.length("seq").alias("n")
    ).where(F.col("pos") < F.col("n") - 1)
    return rows.groupBy(*BY).agg(
        *[
            F.round(F.avg(F.col("v")[j]), 9).alias(p)
            for j, p in enumerate(FE.DINUCLEOTIDE_PROPERTIES)
        ]
    )


def _tie_list() -> str:
    return ", ".join(f"({c}, {i})" for c, i in FE._ties_rounded_up(FE.WINDOW))


@query(with_ctes(WINDOWS, CELLS, f"ties(c, i) AS (VALUES {_tie_list()})", body="""
, counted AS (
  SELECT dataset_id, pos, count(*) OVER (PARTITION BY rec_id, ch ORDER BY pos) AS c FROM cells),
rounded AS (
  SELECT dataset_id, pos, (1000 * k.c) // pos
    + CASE WHEN (2000 * k.c) % (2 * pos) > pos THEN 1
           WHEN (2000 * k.c) % (2 * pos) = pos AND t.c IS NOT NULL THEN 1 ELSE 0 END AS v
  FROM counted k LEFT JOIN ties t ON t.c = k.c AND t.i = k.pos)
SELECT dataset_id, CAST(pos AS INTEGER) AS pos, count(*) AS n, CAST(sum(v) AS BIGINT) AS density_milli
FROM rounded GROUP BY ALL
"""))
def nucleotide_density(spark, sf_dir):
    rows = X.windows(spark, sf_dir).select(
        *BY, F.posexplode(FE.nucleotide_density(S.normalize_rna("seq"))).alias("p", "v")
    )
    return rows.groupBy(*BY, (F.col("p") + 1).alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(big(F.round(F.col("v") * 1000))).alias("density_milli")
    )


def _encoded_sql() -> str:
    """Totals per feature column, computed column family by column family."""
    props = ", ".join(
        "(" + f"'{k}', {j}, {float(x)!r}::DOUBLE" + ")"
        for k, v in FE.DINUCLEOTIDES.items()
        for j, x in enumerate(v)
    )
    vocab = []
    offset = 15
    for k in (1, 2, 3):
        vocab += [f"('{g}', {offset + j})" for j, g in enumerate(S.vocabulary_kmers(k))]
        offset += 4**k
    return with_ctes(
        WINDOWS, CELLS, f"ties(c, i) AS (VALUES {_tie_list()})", f"props(d, j, v) AS (VALUES {props})",
        f"vocab(g, f) AS (VALUES {', '.join(vocab)})",
        body="""
, chem AS (
  SELECT 0 AS feature, sum(CASE WHEN ch IN ('A','G') THEN 1 ELSE 0 END)::DOUBLE AS total FROM cells
  UNION ALL SELECT 1, sum(CASE WHEN ch IN ('A','C') THEN 1 ELSE 0 END)::DOUBLE FROM cells
  UNION ALL SELECT 2, (SELECT sum(CASE WHEN ch IN ('A','U') THEN 1 ELSE 0 END) FROM cells)::DOUBLE
                      + (SELECT sum(101 - length(seq)) FROM windows)::DOUBLE),
nd AS (
  SELECT 3 AS feature, sum(((1000 * k.c) // pos
    + CASE WHEN (2000 * k.c) % (2 * pos) > pos THEN 1
           WHEN (2000 * k.c) % (2 * pos) = pos AND t.c IS NOT NULL THEN 1 ELSE 0 END) / 1000.0::DOUBLE) AS total
  FROM (SELECT pos, count(*) OVER (PARTITION BY rec_id, ch ORDER BY pos) AS c FROM cells) k
  LEFT JOIN ties t ON t.c = k.c AND t.i = k.pos),
pairs AS (SELECT substr(rna, pos, 2) AS d, count(*) AS n FROM cells WHERE pos < length(rna) GROUP BY ALL),
dinuc AS (SELECT 4 + j AS feature, sum(n * v / 101) AS total FROM pairs JOIN props USING (d) GROUP BY j),
kcount AS (
  SELECT rec_id, substr(rna, pos, k) AS g, count(*) AS c
  FROM (SELECT *, unnest([1, 2, 3]) AS k FROM cells) WHERE pos + k - 1 <= length(rna) GROUP BY ALL),
kfeat AS (SELECT f AS feature, sum(c * c / 100.0::DOUBLE) AS total FROM kcount JOIN vocab USING (g) GROUP BY f)
SELECT CAST(feature AS INTEGER) AS feature, round(total, 3) AS total FROM (
  SELECT * FROM chem UNION ALL SELECT * FROM nd UNION ALL SELECT * FROM dinuc UNION ALL SELECT * FROM kfeat)
""")


@query(_encoded_sql())
def encode_features(spark, sf_dir):
    rows = FE.encode_features(X.windows(spark, sf_dir), ["rec_id"])
    return rows.groupBy("feature").agg(F.round(F.sum("value"), 3).alias("total"))


@query(with_ctes(PROFILES, body="""
, cells AS (SELECT rec_id, grp, unnest(scores) AS v, generate_subscripts(scores, 1) AS pos FROM profiles),
win AS (
  SELECT rec_id, grp, pos, sum(v) OVER w AS s, count(*) OVER w AS c
  FROM cells WINDOW w AS (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
cover AS (
  SELECT c.rec_id, c.grp, c.pos, avg(w.s) AS m
  FROM cells c JOIN win w ON w.rec_id = c.rec_id AND w.c = 3 AND w.pos BETWEEN c.pos - 2 AND c.pos
  GROUP BY ALL),
normed AS (
  SELECT *, m / (sqrt(sum(m * m) OVER (PARTITION BY rec_id)) + 1e-12::DOUBLE) AS s FROM cover)
SELECT grp, CAST(pos AS INTEGER) AS pos, round(avg(s), 6) AS score FROM normed GROUP BY ALL
"""))
def importance_profile(spark, sf_dir):
    rows = X.profile_rows(spark, sf_dir).select(
        "grp", F.posexplode(FE.smooth_scores("scores", 3)).alias("p", "s")
    )
    return rows.groupBy("grp", (F.col("p") + 1).alias("pos")).agg(F.round(F.avg("s"), 6).alias("score"))


@query(with_ctes(PROFILES, body="""
SELECT rec_id, round(list_sum(parsed), 6) AS total, CAST(len(parsed) AS INTEGER) AS n, digest FROM (
  SELECT rec_id, md5(array_to_string(list_transform(scores, lambda x: printf('%.3f', x)), ',')) AS digest,
    list_transform(string_split(array_to_string(list_transform(scores, lambda x: printf('%.3f', x)), ','), ','),
                   lambda x: CAST(x AS DOUBLE)) AS parsed
  FROM profiles)
"""))
def track_text_digest(spark, sf_dir):
    text = S.matrix_to_string("scores")
    rows = X.profile_rows(spark, sf_dir).select("rec_id", text.alias("t"))
    parsed = S.parse_track("t")
    return rows.select(
        "rec_id",
        F.round(F.aggregate(parsed, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.size(parsed).alias("n"),
        S.text_digest("t").alias("digest"),
    )


@query(with_ctes(PROFILES, body="""
, cells AS (SELECT rec_id, grp, unnest(scores) AS v, generate_subscripts(scores, 1) AS pos FROM profiles),
soft AS (SELECT grp, pos, exp(v) / sum(exp(v)) OVER (PARTITION BY rec_id) AS p FROM cells)
SELECT grp, CAST(pos - 1 AS INTEGER) AS pos, round(avg(p), 9) AS p FROM soft GROUP BY ALL
"""))
def profile_probability(spark, sf_dir):
    rows = X.profile_rows(spark, sf_dir).select(
        "grp", F.posexplode(S.softmax("scores")).alias("pos", "p")
    )
    return rows.groupBy("grp", "pos").agg(F.round(F.avg("p"), 9).alias("p"))


@query(with_ctes(WINDOWS, body="""
SELECT dataset_id, count(*) AS n_records,
  CAST(sum(length('AC' || seq || 'GT')) AS BIGINT) AS flanked,
  CAST(sum(greatest(length(seq) - 20, 0)) AS BIGINT) AS trimmed,
  CAST(sum(CASE WHEN translate(seq, 'ACGT', 'TGCA') = seq THEN 1 ELSE 0 END) AS BIGINT) AS self_complement,
  CAST(sum(CASE WHEN seq LIKE '%N%' THEN 0 ELSE 1 END) AS BIGINT) AS without_n,
  CAST(sum(CASE WHEN regexp_full_match(seq, '[ACGTUN]+') THEN 1 ELSE 0 END) AS BIGINT) AS valid
FROM windows GROUP BY dataset_id
"""))
def flank_and_validate(spark, sf_dir):
    w = X.windows(spark, sf_dir)
    flag = lambda c: F.sum(big(c.cast("int")))
    return w.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(big(F.length(S.add_flanks("seq", "AC", "GT")))).alias("flanked"),
        F.sum(big(F.length(S.trim_flanks("seq", 10, 10)))).alias("trimmed"),
        flag(F.translate("seq", "ACGT", "TGCA") == F.col("seq")).alias("self_complement"),
        flag(S.has_no_n("seq")).alias("without_n"),
        flag(S.is_valid_record("seq", F.length("seq"))).alias("valid"),
    )


def _alphabet_sql() -> str:
    combos = [b + s for b in S.RNA for s in S.STATES_7]
    rows = ", ".join(
        f"('{c}', '{S.LETTERS_28[i]}', '{S.LETTERS_16[i]}', '{S.LETTERS_8[i]}')" for i, c in enumerate(combos)
    )
    four = dict(zip(S.STATES_7, S.STATES_4))
    two = dict(zip(S.STATES_4_FROM, S.STATES_2))
    states = ", ".join(f"('{s}', '{four[s]}', '{two[four[s]]}')" for s in S.STATES_7)
    return with_ctes(
        WINDOWS, CELLS, f"l28(c, a, b, d) AS (VALUES {rows})", f"st(s, f, t) AS (VALUES {states})",
        body="""
, staged AS (SELECT ch, substr('EHLRBMT', CAST(pos % 7 AS INTEGER) + 1, 1) AS s FROM cells),
n AS (SELECT ch, s, count(*) AS n FROM staged GROUP BY ALL),
j AS (SELECT n.n, l28.*, st.*, n.ch FROM n JOIN l28 ON l28.c = n.ch || n.s JOIN st ON st.s = n.s)
SELECT alphabet, letter, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'seq_4' AS alphabet, ch AS letter, n FROM j UNION ALL
  SELECT 'seq_struct_8', d, n FROM j UNION ALL
  SELECT 'seq_struct_16', b, n FROM j UNION ALL
  SELECT 'seq_struct_28', a, n FROM j UNION ALL
  SELECT 'struct_2', t, n FROM j UNION ALL
  SELECT 'struct_4', f, n FROM j UNION ALL
  SELECT 'struct_7', s, n FROM j)
GROUP BY ALL
""")


@query(_alphabet_sql())
def alphabet_letters(spark, sf_dir):
    from ribospan.plans.motif_prior import ALPHABETS, alphabet_rows

    states = F.rpad(F.lit(""), F.length("seq"), F.lit("HLRBMTE"))
    w = X.windows(spark, sf_dir).select("rec_id", S.normalize_rna("seq").alias("seq"), states.alias("states"))
    rows = alphabet_rows(w, ["rec_id"], list(ALPHABETS))
    letters = rows.select("alphabet", F.explode(S.kmers("seq", 1)).alias("letter"))
    return letters.groupBy("alphabet", "letter").agg(F.count(F.lit(1)).alias("n"))
