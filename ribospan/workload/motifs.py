"""Motif, structure and composite queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.functions import sequence as S
from ribospan.operators import kmers as K
from ribospan.operators import motifs as M
from ribospan.operators import structure as ST
from ribospan.plans import motif_discovery as MD
from ribospan.plans import motif_prior as MP
from ribospan.plans import splice_profile as SP
from ribospan.plans import training as TR
from ribospan.session import materialize
from ribospan.workload.inputs_sql import PROFILES, WINDOWS, grams
from ribospan.workload.registry import query, with_ctes

BY = ["dataset_id"]

# The windows with one dataset per source and English as the positive class.
LANGUAGE = """
lang AS (SELECT rec_id, rbp AS dataset_id, CASE WHEN cell = 'en' THEN 1 ELSE 0 END AS label, seq FROM windows)
"""


def rounded(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# ------------------------------------------------------- regions and windows

ISLANDS = """
cells AS (SELECT rec_id, grp, unnest(scores) AS v, generate_subscripts(scores, 1) - 1 AS pos FROM profiles),
on_ AS (SELECT * FROM (SELECT *, avg(v) OVER w AS m, min(v) OVER w AS lo FROM cells WINDOW w AS (PARTITION BY rec_id))
        WHERE v > m AND v > lo),
isl AS (SELECT rec_id, min(pos) AS s, max(pos) + 1 AS e FROM (
  SELECT rec_id, pos, pos - row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS g FROM on_) GROUP BY rec_id, g),
regions AS (SELECT * FROM isl WHERE e - s >= 3)
"""


@query(with_ctes(PROFILES, ISLANDS, body="""
SELECT rec_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM regions
"""))
def high_score_regions(spark, sf_dir):
    return M.high_score_regions(X.profile_rows(spark, sf_dir), ["rec_id"], min_len=3)


@query(with_ctes(PROFILES, ISLANDS, body="""
SELECT rec_id, CAST(ns AS INTEGER) AS start, CAST(ns + 12 AS INTEGER) AS "end" FROM (
  SELECT rec_id, s - CAST(floor((12 - (e - s)) / 2.0::DOUBLE) AS INTEGER) AS ns FROM regions)
WHERE ns >= 0 AND ns + 12 <= 64
"""))
def centered_windows(spark, sf_dir):
    r = M.high_score_regions(X.profile_rows(spark, sf_dir), ["rec_id"], min_len=3)
    w = M.extract_windows(r.withColumn("seq", F.repeat(F.lit("A"), F.lit(64))), 12)
    return w.select("rec_id", "start", "end")


def language_windows(spark, sf_dir):
    """Windows with one dataset per source; English is the positive class."""
    w = X.windows(spark, sf_dir)
    return w.select(
        "rec_id", F.col("rbp").alias("dataset_id"), "cell", (F.col("cell") == "en").cast("int").alias("label"), "seq"
    )


def scored_windows(spark, sf_dir):
    """Windows with a per-base score track (A 0.1, C 0.4, G 0.2, T 0.3)."""
    w = language_windows(spark, sf_dir)
    weight = lambda c: F.when(c == "A", 0.1).when(c == "C", 0.4).when(c == "G", 0.2).otherwise(0.3)
    return w.select("dataset_id", "rec_id", "label", "seq", F.transform(S.kmers("seq", 1), weight).alias("scores"))


REGION_MOTIFS = """
bases AS (
  SELECT dataset_id, rec_id, seq, i - 1 AS pos, CASE substr(seq, i, 1) WHEN 'A' THEN 0.1::DOUBLE WHEN 'C' THEN 0.4::DOUBLE
         WHEN 'G' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS v
  FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM lang WHERE label = 1)),
hot AS (SELECT dataset_id, rec_id, seq, pos FROM (
  SELECT *, sum(round(v * 10)) OVER w AS t, count(*) OVER w AS n, min(v) OVER w AS lo FROM bases WINDOW w AS (PARTITION BY rec_id))
  WHERE round(v * 10) * n > t AND v > lo),
spans AS (SELECT dataset_id, rec_id, seq, min(pos) AS s, max(pos) + 1 AS e FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS g FROM hot) GROUP BY dataset_id, rec_id, seq, g),
instances AS (SELECT *, substr(seq, CAST(s AS INTEGER) + 1, CAST(e - s AS INTEGER)) AS motif FROM spans WHERE e - s >= 5),
motifs AS (SELECT dataset_id, motif, count(*) AS n_regions FROM instances GROUP BY ALL)
"""


def _condition(scores):
    """Above the mean, compared in whole tenths so the threshold has no rounding noise."""
    tenths = F.transform(scores, lambda x: F.round(x * 10))
    from ribospan.functions.core import let

    return let(
        tenths,
        lambda v: let(
            F.struct(F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("sum"), F.array_min(v).alias("low")),
            lambda t: F.transform(v, lambda x: (x * F.size(v) > t["sum"]) & (x > t["low"])),
        ),
    )


def _instances(spark, sf_dir):
    positives = scored_windows(spark, sf_dir).where(F.col("label") == 1)
    return M.region_instances(positives, ["dataset_id", "rec_id"], min_len=5, condition=_condition)


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, body="SELECT dataset_id, motif, n_regions FROM motifs"))
def region_motifs(spark, sf_dir):
    return MD.motif_table(_instances(spark, sf_dir)).select("dataset_id", "motif", "n_regions")


CONTAINMENT = """
lens AS (SELECT DISTINCT length(motif) AS l FROM motifs),
subs AS (
  SELECT DISTINCT dataset_id, rec_id, label, substr(seq, i, CAST(l AS INTEGER)) AS motif FROM (
    SELECT dataset_id, rec_id, label, seq, l, unnest(range(1, length(seq) - l + 2)) AS i FROM lang, lens)),
counts AS (
  SELECT m.dataset_id, m.motif, count(*) AS n_with, CAST(sum(label) AS BIGINT) AS n_pos_with
  FROM motifs m JOIN subs USING (dataset_id, motif) GROUP BY ALL)
"""


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, CONTAINMENT, body="SELECT * FROM counts"))
def motif_containment(spark, sf_dir):
    motifs = materialize(MD.motif_table(_instances(spark, sf_dir)))
    return M.motif_containment(language_windows(spark, sf_dir), motifs, BY)


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, """
lens AS (SELECT DISTINCT length(motif) AS l FROM motifs),
subs AS (
  SELECT dataset_id, rec_id, label, substr(seq, i, CAST(l AS INTEGER)) AS motif FROM (
    SELECT dataset_id, rec_id, label, seq, l, unnest(range(1, length(seq) - l + 2)) AS i FROM lang, lens))""", body="""
SELECT m.dataset_id, m.motif, count(*) AS n_with, CAST(sum(label) AS BIGINT) AS n_pos_with
FROM motifs m JOIN subs USING (dataset_id, motif) GROUP BY ALL
"""))
def motif_places(spark, sf_dir):
    """Every place of a motif counts, overlapping ones too."""
    motifs = materialize(MD.motif_table(_instances(spark, sf_dir)))
    return M.motif_containment(language_windows(spark, sf_dir), motifs, BY, allow_multi=True)


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, CONTAINMENT, """
size_ AS (SELECT dataset_id, count(*) AS total, CAST(sum(label) AS BIGINT) AS positives FROM lang GROUP BY 1),
terms AS (
  SELECT dataset_id, motif, exp(
      lgamma(positives + 1) - lgamma(k + 1) - lgamma(positives - k + 1)
      + lgamma(total - positives + 1) - lgamma(n_with - k + 1) - lgamma(total - positives - n_with + k + 1)
      - lgamma(total + 1) + lgamma(n_with + 1) + lgamma(total - n_with + 1)) AS t
  FROM (SELECT *, unnest(range(greatest(n_pos_with, n_with - (total - positives)), least(positives, n_with) + 1)) AS k
        FROM counts JOIN size_ USING (dataset_id))),
pv AS (SELECT dataset_id, motif, least(1.0::DOUBLE, sum(t)) AS p FROM terms GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY p) AS i, count(*) OVER (PARTITION BY dataset_id) AS m FROM pv),
a AS (SELECT *, min(p * m / i) OVER (PARTITION BY dataset_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS adj FROM r)""", body="""
SELECT dataset_id, motif, round(p, 6) AS p, round(least(1.0::DOUBLE, adj), 6) AS p_adj FROM a WHERE round(adj, 6) < 0.2
"""))
def enriched_motifs(spark, sf_dir):
    motifs = materialize(MD.motif_table(_instances(spark, sf_dir)))
    out = MD.enriched_motifs(language_windows(spark, sf_dir), motifs, p_cutoff=2.0)
    kept = rounded(out.select("dataset_id", "motif", "p", "p_adj"))
    return kept.where(F.col("p_adj") < 0.2)


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, """
places AS (SELECT dataset_id, motif, min({'r': rec_id, 's': s}) AS seen FROM instances GROUP BY ALL),
ranked AS (SELECT dataset_id, motif, row_number() OVER (PARTITION BY dataset_id ORDER BY length(motif), seen, motif) AS r FROM places),
walk AS (
  SELECT DISTINCT dataset_id, 0::BIGINT AS r, []::VARCHAR[] AS kept FROM ranked
  UNION ALL
  SELECT o.dataset_id, o.r, CASE WHEN len([k for k in w.kept if list_max([
      len([i for i in range(greatest(1, x + 1), least(length(o.motif), length(k) + x) + 1) if o.motif[i] = k[i - x]])
      for x in range(1 - length(k), length(o.motif))]) >= greatest(4, 0.5 * least(length(o.motif), length(k)))]) > 0
    THEN w.kept ELSE list_append(w.kept, o.motif) END
  FROM walk w JOIN ranked o ON o.dataset_id = w.dataset_id AND o.r = w.r + 1),
ends AS (SELECT dataset_id, unnest(arg_max(kept, r)) AS target FROM walk GROUP BY 1),
aligned AS (
  SELECT m.dataset_id, m.motif, e.target, list_max([{'n': len([i for i in range(greatest(1, x + 1), least(length(m.motif), length(e.target) + x) + 1)
      if m.motif[i] = e.target[i - x]]), 'x': -x} for x in range(1 - length(e.target), length(m.motif))]) AS al
  FROM ranked m JOIN ends e ON e.dataset_id = m.dataset_id JOIN ranked k ON k.dataset_id = e.dataset_id AND k.motif = e.target AND k.r < m.r
  WHERE NOT EXISTS (SELECT 1 FROM ends o WHERE o.dataset_id = m.dataset_id AND o.target = m.motif)),
fit AS (SELECT *, max(al.n) OVER (PARTITION BY dataset_id, motif) AS top FROM aligned WHERE al.n >= greatest(4, 0.5 * least(length(motif), length(target))))""", body="""
SELECT dataset_id, target AS motif, target, 0 AS shift FROM ends
UNION ALL SELECT dataset_id, motif, target, (-al.x)::INTEGER FROM fit WHERE al.n = top
""").replace("WITH", "WITH RECURSIVE", 1))
def merge_motifs(spark, sf_dir):
    """All region motifs of each dataset, merged greedily."""
    table = materialize(MD.motif_table(_instances(spark, sf_dir)))
    return M.merge_similar_motifs(table, BY, min_len=5)


@query()
def motif_discovery(spark, sf_dir):
    found = MD.discover_motifs(
        scored_windows(spark, sf_dir), min_len=5, width=24, p_cutoff=0.2, min_instances=3, condition=_condition
    )
    return found.select("dataset_id", "motif", "rec_id", "start", "end", "window")


# --------------------------------------------------------------------- PWM

PWM = """
anchors AS (SELECT substr(motif, 1, 5) AS motif, substr(seq, CAST(s AS INTEGER) + 1, 8) AS w FROM instances),
cell_counts AS (SELECT motif, i - 1 AS pos, replace(substr(w, i, 1), 'T', 'U') AS symbol, count(*) AS c
                FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM anchors) GROUP BY ALL),
totals AS (SELECT motif, count(*) AS n, max(length(w)) AS width FROM anchors GROUP BY motif),
pwm AS (
  SELECT t.motif, p.pos, s.symbol, coalesce(c, 0) / n AS p
  FROM totals t JOIN (SELECT unnest(range(0, 8)) AS pos) p ON p.pos < t.width, (SELECT unnest(['A','C','G','U']) AS symbol) s
  LEFT JOIN cell_counts c ON c.motif = t.motif AND c.pos = p.pos AND c.symbol = s.symbol)
"""


def _anchored(spark, sf_dir):
    """Eight bases from the start of each region (fewer at the end of its window), grouped by the region's first five.

    Five bases are the shortest region, so every region has its motif.
    """
    return _instances(spark, sf_dir).select(
        "dataset_id", F.substr("motif", F.lit(1), F.lit(5)).alias("motif"),
        F.substr("seq", F.col("start") + 1, F.lit(8)).alias("seq"),
    )


def _pwm(spark, sf_dir):
    return M.pwm_from_instances(_anchored(spark, sf_dir), ["motif"])


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, PWM, body="""
SELECT motif, CAST(pos AS INTEGER) AS pos, symbol, round(p, 9) AS p FROM pwm
"""))
def pwm(spark, sf_dir):
    return rounded(_pwm(spark, sf_dir), 9)


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, PWM, body="""
SELECT motif, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy FROM pwm GROUP BY motif
"""))
def pwm_entropy(spark, sf_dir):
    return rounded(M.pwm_entropy(_pwm(spark, sf_dir), ["motif"]))


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, PWM, """
e AS (SELECT motif, substr(motif, 1, 1) AS grp, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS entropy FROM pwm GROUP BY motif)""", body="""
SELECT grp, motif, round(entropy, 6) AS entropy FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY entropy, motif) AS r FROM e) WHERE r = 1
"""))
def most_stable_motif(spark, sf_dir):
    e = M.pwm_entropy(_pwm(spark, sf_dir), ["motif"])
    staged = e.withColumn("grp", F.substr("motif", F.lit(1), F.lit(1)))
    return rounded(M.most_stable(staged, ["grp"]))


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, PWM, body="""
SELECT motif, CAST(pos AS INTEGER) AS pos, symbol, round(abs(b / s * log2(s)), 6) AS height FROM (
  SELECT *, pow(p, 2) AS b, sum(pow(p, 2)) OVER (PARTITION BY motif, pos) AS s FROM pwm)
"""))
def structure_power(spark, sf_dir):
    return rounded(M.structure_power(_pwm(spark, sf_dir), ["motif"], 2.0))


def _group_pwms(spark, sf_dir, by):
    """The PWMs of all anchors of each group (``grp``: one of them all), long and as arrays of columns."""
    p = materialize(M.pwm_from_instances(_anchored(spark, sf_dir).withColumn("grp", F.lit("all")), [by, "motif"]))
    return p, materialize(M.pwm_rows(p, [by, "motif"]))


def _pwm_sql(by: str, grp: str = "substr(motif, 1, 2)") -> str:
    """The PWM of each (group, motif)."""
    return f"""
anchors AS (SELECT dataset_id, substr(motif, 1, 5) AS motif, {grp} AS grp, substr(seq, CAST(s AS INTEGER) + 1, 8) AS w FROM instances),
cell_counts AS (SELECT {by}, motif, i - 1 AS pos, replace(substr(w, i, 1), 'T', 'U') AS symbol, count(*) AS c
                FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM anchors) GROUP BY ALL),
totals AS (SELECT {by}, motif, count(*) AS n, max(length(w)) AS width FROM anchors GROUP BY ALL),
pwm AS (
  SELECT t.{by}, t.motif, p.pos, s.symbol, coalesce(c, 0) / n AS p
  FROM totals t JOIN (SELECT unnest(range(0, 8)) AS pos) p ON p.pos < t.width, (SELECT unnest(['A','C','G','U']) AS symbol) s
  LEFT JOIN cell_counts c ON c.{by} = t.{by} AND c.motif = t.motif AND c.pos = p.pos AND c.symbol = s.symbol)
"""


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, _pwm_sql("dataset_id"), """
cols AS (SELECT dataset_id, motif, pos, list(p ORDER BY symbol) AS c FROM pwm GROUP BY ALL),
mats AS (SELECT dataset_id, motif, list(c ORDER BY pos) AS m, count(*) AS width FROM cols GROUP BY ALL),
widths AS (SELECT DISTINCT dataset_id, width FROM mats),
offs AS (SELECT rec_id, lang.dataset_id, width, substr(replace(seq, 'T', 'U'), o, CAST(width AS INTEGER)) AS w
         FROM lang JOIN widths USING (dataset_id), range(1, 102) AS r(o) WHERE o + width - 1 <= length(seq)),
words AS (SELECT DISTINCT dataset_id, width, w FROM offs),
prod AS (
  SELECT d.dataset_id, d.w, m.motif, list_product([m.m[i][strpos('ACGU', d.w[i])] for i in range(1, m.width + 1)]) AS s
  FROM words d JOIN mats m ON m.dataset_id = d.dataset_id AND m.width = d.width),
hits AS (
  SELECT o.dataset_id, p.motif, o.rec_id, max(p.s, 2) AS best, count(*) AS n
  FROM offs o JOIN prod p ON p.dataset_id = o.dataset_id AND p.w = o.w GROUP BY ALL),
all_ AS (SELECT w.dataset_id, m.motif, CASE WHEN h.n >= 2 THEN h.best[1] + h.best[2] ELSE 0 END AS score
         FROM lang w JOIN mats m ON m.dataset_id = w.dataset_id
         LEFT JOIN hits h ON h.rec_id = w.rec_id AND h.motif = m.motif)""", body="""
SELECT dataset_id, motif, count(*) AS n, round(avg(score), 9) AS mean_score, round(max(score), 9) AS best_score
FROM all_ GROUP BY ALL
"""))
def pfm_scan(spark, sf_dir):
    _, pwms = _group_pwms(spark, sf_dir, "dataset_id")
    records = language_windows(spark, sf_dir).select(
        "dataset_id", "rec_id", S.normalize_rna("seq").alias("seq")
    )
    scores = M.pfm_scan(records, pwms, ["rec_id"], BY, top_n=2)
    return rounded(
        scores.groupBy("dataset_id", "motif").agg(
            F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score")
        ),
        9,
    )


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, _pwm_sql("grp", "'all'"), """
cols AS (SELECT grp, motif, pos, list(p ORDER BY symbol) AS c FROM pwm GROUP BY ALL),
pair AS (
  SELECT q.motif, t.motif AS target, q.pos - t.pos AS o, q.c AS a, t.c AS b
  FROM cols q JOIN cols t ON q.grp = t.grp AND q.motif <> t.motif),
cor AS (
  SELECT *, a[1]*b[1]+a[2]*b[2]+a[3]*b[3]+a[4]*b[4] - ma*mb*4 AS cross_,
    a[1]*a[1]+a[2]*a[2]+a[3]*a[3]+a[4]*a[4] - ma*ma*4 AS sa, b[1]*b[1]+b[2]*b[2]+b[3]*b[3]+b[4]*b[4] - mb*mb*4 AS sb
  FROM (SELECT *, list_sum(a)/4 AS ma, list_sum(b)/4 AS mb FROM pair)),
sim AS (
  SELECT motif, target, o, count(*) AS overlap,
    avg(CASE WHEN sa > 1e-12 AND sb > 1e-12 THEN cross_ / sqrt(sa * sb) ELSE 0 END) AS s
  FROM cor GROUP BY ALL HAVING count(*) >= 5),
bo AS (SELECT motif, target, max(round(s, 9)) AS s FROM sim GROUP BY ALL)""", body="""
SELECT motif, target, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY motif ORDER BY s DESC, target) AS k FROM bo) WHERE k = 1
"""))
def motif_similarity(spark, sf_dir):
    """The most similar other motif of each, of all motifs."""
    _, pwms = _group_pwms(spark, sf_dir, "grp")
    db = pwms.select("grp", F.col("motif").alias("target"), F.col("cols").alias("target_cols"))
    sims = M.motif_similarity(pwms, db, ["grp"], 5).where(F.col("motif") != F.col("target"))
    best = M.best_match(sims.withColumn("similarity", F.round("similarity", 9)), ["motif"])
    return rounded(best.select("motif", "target", "similarity"))


# --------------------------------------------------------------- structure


def folded(spark, sf_dir):
    """Dot-bracket strings with hairpins, bulges and two-branch loops, built from each window.

    A base pair opens at A and C; its closing arm is the mirror image with T dropped, so
    the two sides of a loop differ in length. Two such hairpins sit inside one outer pair.
    """
    w = X.windows(spark, sf_dir)
    half = F.floor(F.length("seq") / 2).cast("int")
    def hairpin(part):
        opened = F.translate(part, "ACGT", "((..")
        closed = F.reverse(F.translate(part, "ACGT", "))."))
        return F.concat(opened, F.lit("..."), closed)

    left = F.substr("seq", F.lit(1), half)
    right = F.substr("seq", half + 1)
    structure = F.concat(F.lit(".("), hairpin(left), F.lit("."), hairpin(right), F.lit(").."))
    return w.select("rec_id", "dataset_id", "seq", structure.alias("structure"))


FOLDED = """
folded AS (
  SELECT rec_id, dataset_id, seq, '.(' || translate(l, 'ACGT', '((..') || '...' || reverse(translate(l, 'ACGT', ')).'))
    || '.' || translate(r, 'ACGT', '((..') || '...' || reverse(translate(r, 'ACGT', ')).')) || ')..' AS structure
  FROM (SELECT *, substr(seq, 1, length(seq) // 2) AS l, substr(seq, length(seq) // 2 + 1) AS r FROM windows)),
ch AS (SELECT rec_id, i AS pos, substr(structure, i, 1) AS c FROM (SELECT *, unnest(range(1, length(structure) + 1)) AS i FROM folded)),
dp AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY pos) AS o FROM ch),
br AS (SELECT rec_id, pos, c, CASE WHEN c = ')' THEN o + 1 ELSE o END AS d FROM dp WHERE c <> '.'),
num AS (SELECT *, row_number() OVER (PARTITION BY rec_id, d, c ORDER BY pos) AS k,
               lag(c) OVER (PARTITION BY rec_id ORDER BY pos) AS pc, lead(c) OVER (PARTITION BY rec_id ORDER BY pos) AS nc FROM br),
pr AS (SELECT a.rec_id, a.pos, a.c, b.pos AS mate, CASE a.c WHEN '(' THEN b.nc ELSE b.pc END AS beyond
       FROM num a JOIN num b ON a.rec_id = b.rec_id AND a.d = b.d AND a.k = b.k AND a.c <> b.c),
near AS (
  SELECT dp.rec_id, dp.pos, dp.c, dp.o,
    max(CASE WHEN c <> '.' THEN pos END) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kp,
    min(CASE WHEN c <> '.' THEN pos END) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS mp
  FROM dp),
st AS (
  SELECT n.rec_id, n.pos, CASE
      WHEN n.c = '(' THEN 'L' WHEN n.c = ')' THEN 'R' WHEN kp IS NULL OR mp IS NULL THEN 'E'
      WHEN k.c = '(' AND m.c = ')' THEN 'H'
      WHEN k.c = ')' AND m.c = '(' THEN CASE WHEN n.o > 0 THEN 'M' ELSE 'E' END
      WHEN m.mate + 1 = k.mate THEN 'B'
      WHEN m.c = '(' AND m.beyond = '(' THEN 'M' WHEN k.c = ')' AND k.beyond = ')' THEN 'M' ELSE 'T' END AS s
  FROM near n LEFT JOIN pr k ON k.rec_id = n.rec_id AND k.pos = kp LEFT JOIN pr m ON m.rec_id = n.rec_id AND m.pos = mp),
annotated AS (SELECT rec_id, string_agg(s, '' ORDER BY pos) AS states FROM st GROUP BY rec_id)
"""


@query(with_ctes(WINDOWS, FOLDED, body="SELECT rec_id, md5(states) AS digest, CAST(length(states) AS INTEGER) AS n FROM annotated"))
def annotate_structure(spark, sf_dir):
    a = ST.annotate_structure(folded(spark, sf_dir))
    return a.select("rec_id", F.md5("states").alias("digest"), F.length("states").alias("n"))


def _stated(spark, sf_dir):
    """Windows in RNA letters with the first states of their structure, one per base."""
    return ST.annotate_structure(folded(spark, sf_dir)).select(
        "dataset_id", "rec_id", S.normalize_rna("seq").alias("seq"),
        F.substr("states", F.lit(3), F.length("seq")).alias("states"),
    )


STATED = """
stated AS (SELECT f.dataset_id, f.rec_id, replace(f.seq, 'T', 'U') AS seq, substr(states, 3, length(f.seq)) AS states
           FROM folded f JOIN annotated USING (rec_id)),
placed AS (SELECT rec_id, replace(kmer, 'T', 'U') AS motif, min(pos)::INTEGER AS position FROM grams GROUP BY ALL),
located AS (SELECT s.dataset_id, s.rec_id, p.motif, p.position, substr(s.states, p.position, 6) AS states FROM placed p JOIN stated s USING (rec_id))
"""


def _struct_hits(spark, sf_dir):
    """The states under the first place of every 6-mer of a dataset in its windows, with the windows that have them there and the sum of the places."""
    motifs = K.kmer_counts(X.windows(spark, sf_dir), 6, BY).select("dataset_id", F.col("kmer").alias("motif"))
    return M.structure_at_motif(motifs, _stated(spark, sf_dir), BY, totals=True)


@query(with_ctes(WINDOWS, grams(6), FOLDED, STATED, body="""
SELECT dataset_id, motif, count(*) AS n, sum(position)::BIGINT AS positions, count(DISTINCT states) AS n_states,
       min(states) AS first_states, max(states) AS last_states
FROM located GROUP BY ALL
"""))
def structure_at_motif(spark, sf_dir):
    return _struct_hits(spark, sf_dir).groupBy("dataset_id", "motif").agg(
        F.sum("n").alias("n"), F.sum("positions").alias("positions"), F.count("states").alias("n_states"),
        F.min("states").alias("first_states"), F.max("states").alias("last_states"),
    )


@query(with_ctes(WINDOWS, grams(6), FOLDED, STATED, """
units AS (SELECT motif, states, count(*) AS k FROM located GROUP BY ALL),
tot AS (SELECT motif, sum(k) AS n FROM units GROUP BY motif),
cc AS (
  SELECT motif, part, i - 1 AS pos, substr(t, i, 1) AS symbol, sum(k) AS c
  FROM (SELECT motif, 'seq' AS part, motif AS t, k, unnest(range(1, 7)) AS i FROM units
        UNION ALL SELECT motif, 'struct', states, k, unnest(range(1, 7)) FROM units) WHERE substr(t, i, 1) <> '' GROUP BY ALL),
grid AS (
  SELECT motif, n, pos, part, symbol FROM tot, (SELECT unnest(range(0, 6)) AS pos),
    (SELECT 'seq' AS part, unnest(['A','C','G','U']) AS symbol UNION ALL SELECT 'struct', unnest(['L','R','E','H','B','M','T'])))""", body="""
SELECT g.motif, CAST(g.pos AS INTEGER) AS pos, g.symbol, round(coalesce(c, 0) / n::DOUBLE, 9) AS p, g.part
FROM grid g LEFT JOIN cc USING (motif, part, pos, symbol)
"""))
def seq_struct_pwm(spark, sf_dir):
    # Two PWMs come from the hits, which are found once: equal ones are a row with their number.
    hits = materialize(_struct_hits(spark, sf_dir).groupBy("motif", "states").agg(F.sum("n").alias("n")))
    seqs = hits.select("motif", F.col("motif").alias("seq"), "n")
    return rounded(M.seq_struct_pwm(seqs, hits, ["motif"], weight="n"), 9)


@query(with_ctes(PROFILES, body="""
, cells AS (SELECT grp, unnest(scores) AS v, generate_subscripts(scores, 1) - 1 - 32 AS pos FROM profiles)
SELECT grp, CAST(pos AS INTEGER) AS pos, round(avg(v), 9) AS mean_value FROM cells GROUP BY ALL
"""))
def mean_profile(spark, sf_dir):
    return rounded(ST.mean_profile(X.profile_rows(spark, sf_dir), ["grp"], "scores", centre=32), 9)


@query(with_ctes(PROFILES, body="""
, cells AS (SELECT rec_id, unnest(scores) AS v, generate_subscripts(scores, 1) - 1 AS pos FROM profiles)
SELECT rec_id, CAST(pos AS INTEGER) AS pos, round((v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-12), 6) AS z
FROM cells WINDOW w AS (PARTITION BY rec_id)
"""))
def zscore_profile(spark, sf_dir):
    z = X.profile_rows(spark, sf_dir).select("rec_id", ST.zscore_row("scores").alias("z"))
    return rounded(z.select("rec_id", F.posexplode("z").alias("pos", "z")))


@query(with_ctes(PROFILES, body="""
, cells AS (SELECT rec_id, unnest(scores) AS v, generate_subscripts(scores, 1) - 1 AS pos FROM profiles),
t AS (SELECT pos, 1 - 0.1 * v - 0.2 * v - 0.3 * v - 0.05 * v AS paired, 0.2 * v AS hairpin, 0.3 * v AS "inner",
             0.05 * v AS multi, 0.1 * v AS external FROM cells),
l AS (UNPIVOT t ON paired, hairpin, "inner", multi, external INTO NAME structure_type VALUE v)
SELECT structure_type, CAST(pos AS INTEGER) AS pos, round(avg(v), 9) AS mean_value FROM l GROUP BY ALL
"""))
def paired_probability(spark, sf_dir):
    base = X.profile_rows(spark, sf_dir)
    part = lambda f: base.select("rec_id", F.transform("scores", lambda x: x * f).alias("profile"))
    rows = ST.paired_probability(part(0.1), part(0.2), part(0.3), part(0.05))
    return rounded(ST.mean_profile(rows, ["structure_type"]), 9)


# --------------------------------------------------------------- composites


@query()
def train_and_validate(spark, sf_dir):
    w = language_windows(spark, sf_dir).select("dataset_id", "rec_id", "label", "seq")
    _, metrics = TR.train_and_validate(w, k=2)
    return metrics


TRAIN_STEPS = 2
_STEP = """
off_{i} AS (
  SELECT x.dataset_id, x.kmer, x.x, x.rec_id, s.share * (1 / (1 + exp(-s.z)) - s.label) AS off, s.share
  FROM xs x JOIN (
    SELECT x.dataset_id, x.rec_id, any_value(x.label) AS label, CASE WHEN any_value(x.label) = 1 THEN 2.0 ELSE 1.0 END AS share,
           any_value(m.b) + sum(x.x * m.w) AS z
    FROM xs x JOIN m_{h} m ON m.dataset_id = x.dataset_id AND m.kmer = x.kmer GROUP BY x.dataset_id, x.rec_id) s
  ON s.dataset_id = x.dataset_id AND s.rec_id = x.rec_id),
m_{i} AS (
  SELECT m.dataset_id, m.kmer, m.w - (sum(o.off * o.x) / sum(o.share) + 1e-4 * m.w) AS w, m.b - sum(o.off) / sum(o.share) AS b
  FROM m_{h} m JOIN off_{i} o ON o.dataset_id = m.dataset_id AND o.kmer = m.kmer GROUP BY m.dataset_id, m.kmer, m.w, m.b)"""


@query(with_ctes(WINDOWS, """
kmers_ AS (SELECT a || b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('U')) AS p(a), (VALUES ('A'), ('C'), ('G'), ('U')) AS q(b))""", """
found AS (
  SELECT rec_id, replace(substr(seq, i, 2), 'T', 'U') AS kmer, count(*) AS c
  FROM windows, range(1, 101) AS r(i) WHERE i < length(seq) GROUP BY ALL)""", """
counts AS (
  SELECT w.dataset_id, w.rec_id, w.label, k.kmer, coalesce(f.c, 0)::DOUBLE AS c
  FROM (SELECT cell AS dataset_id, rec_id, label FROM windows) w CROSS JOIN kmers_ k
  LEFT JOIN found f ON f.rec_id = w.rec_id AND f.kmer = k.kmer)""", """
scales AS (SELECT dataset_id, kmer, avg(c) AS mean, CASE WHEN stddev_pop(c) > 1e-9 THEN stddev_pop(c) ELSE 1.0 END AS sd
           FROM counts GROUP BY ALL)""", """
xs AS (SELECT c.dataset_id, c.rec_id, c.label, c.kmer, (c.c - s.mean) / s.sd AS x FROM counts c JOIN scales s USING (dataset_id, kmer))""", """
m_0 AS (SELECT dataset_id, kmer, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM scales)""",
*[_STEP.format(i=i, h=i - 1) for i in range(1, TRAIN_STEPS + 1)], body=f"""
SELECT m.dataset_id AS model_id, m.kmer, round(m.w / s.sd, 6) AS weight,
       round(m.b - sum(m.w / s.sd * s.mean) OVER (PARTITION BY m.dataset_id), 6) AS bias
FROM m_{TRAIN_STEPS} m JOIN scales s USING (dataset_id, kmer)
"""))
def training_steps(spark, sf_dir):
    """A stated number of steps of the fit, from zero, for every dataset at once."""
    w = X.windows(spark, sf_dir).select(F.col("cell").alias("dataset_id"), "label", "seq")
    models = TR.fit_kmer_models(w, k=2, max_iter=TRAIN_STEPS, method="gradient")
    return models.select("model_id", F.explode("weights").alias("kmer", "weight"), "bias").select(
        "model_id", "kmer", F.round("weight", 6).alias("weight"), F.round("bias", 6).alias("bias")
    )


@query(with_ctes(WINDOWS, body="""
SELECT dataset_id AS model_id, count(*) AS n_records, count(DISTINCT label) AS n_classes, true AS converged FROM windows GROUP BY dataset_id
"""))
def fit_convergence(spark, sf_dir):
    """The fit of every dataset ends at a slope below 1e-6."""
    w = materialize(X.windows(spark, sf_dir).select("dataset_id", "label", "seq"))
    models = TR.fit_kmer_models(w, k=2, tolerance=1e-7)
    sizes = w.groupBy(F.col("dataset_id").alias("model_id")).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("label").alias("n_classes"))
    return models.join(sizes, "model_id").select("model_id", "n_records", "n_classes", (F.col("gradient_norm") < 1e-6).alias("converged"))


@query(with_ctes(WINDOWS, """
pairs AS (SELECT a || b AS kmer, (strpos('ACGU', a) - 2) * 0.25 + (strpos('ACGU', b) - 3) * 0.125 AS weight
          FROM (VALUES ('A'), ('C'), ('G'), ('U')) AS p(a), (VALUES ('A'), ('C'), ('G'), ('U')) AS q(b)),
found AS (SELECT rec_id, replace(substr(seq, i, 2), 'T', 'U') AS kmer FROM windows, range(1, 101) AS r(i) WHERE i < length(seq)),
totals AS (SELECT rec_id, sum(weight) AS total FROM found JOIN pairs USING (kmer) GROUP BY rec_id)""", body="""
SELECT rec_id, round(0.5 + coalesce(total, 0), 6)::DOUBLE AS logit, round(1 / (1 + exp(-(0.5 + coalesce(total, 0))::DOUBLE)), 6) AS prob
FROM windows LEFT JOIN totals USING (rec_id)
"""))
def predictions_of_given_models(spark, sf_dir):
    """Logits and probabilities under stated weights: a model for each dataset."""
    w = X.windows(spark, sf_dir).select("dataset_id", "rec_id", "seq")
    place = {c: i + 1 for i, c in enumerate("ACGU")}
    weights = [F.lit(x) for g in S.vocabulary_kmers(2) for x in (g, (place[g[0]] - 2) * 0.25 + (place[g[1]] - 3) * 0.125)]
    models = materialize(w.select("dataset_id").distinct()).select(
        F.col("dataset_id").alias("model_id"), F.lit(0.5).alias("bias"), F.create_map(*weights).alias("weights")
    )
    return TR.predict(w, models).select("rec_id", F.round("logit", 6).alias("logit"), F.round("prob", 6).alias("prob"))


@query()
def transfer_evaluation(spark, sf_dir):
    w = X.windows(spark, sf_dir)
    cell = F.when(F.col("cell") == "en", "K562").when(F.col("cell") == "fr", "HepG2").otherwise(F.col("cell"))
    named = w.select(F.concat_ws("_", "rbp", cell).alias("dataset_id"), "rec_id", "label", "seq")
    train = materialize(TR.split_records(named).where(F.col("split") == "train"))
    models = materialize(TR.fit_kmer_models(train))
    return TR.transfer(named, models)


def _alphabet_tables() -> list[str]:
    combos = [b + s for b in S.RNA for s in S.STATES_7]
    rows = ", ".join(f"('{c}', '{S.LETTERS_28[i]}', '{S.LETTERS_16[i]}', '{S.LETTERS_8[i]}')" for i, c in enumerate(combos))
    four, two = dict(zip(S.STATES_7, S.STATES_4)), dict(zip(S.STATES_4_FROM, S.STATES_2))
    states = ", ".join(f"('{s}', '{four[s]}', '{two[four[s]]}')" for s in S.STATES_7)
    return [f"l28(c, a, b, d) AS (VALUES {rows})", f"st(s, f, t) AS (VALUES {states})"]


@query(with_ctes(WINDOWS, LANGUAGE, *_alphabet_tables(), """
staged AS (SELECT dataset_id, rec_id, label, i AS pos, replace(substr(seq, i, 1), 'T', 'U') AS ch, substr('EHLRBMT', (i % 7 + 1)::INTEGER, 1) AS s
           FROM lang, range(1, 102) AS r(i) WHERE i <= length(seq)),
spelled AS (
  SELECT dataset_id, rec_id, any_value(label) AS label, string_agg(ch, '' ORDER BY pos) AS seq_4, string_agg(d, '' ORDER BY pos) AS seq_struct_8,
         string_agg(b, '' ORDER BY pos) AS seq_struct_16, string_agg(a, '' ORDER BY pos) AS seq_struct_28,
         string_agg(t, '' ORDER BY pos) AS struct_2, string_agg(f, '' ORDER BY pos) AS struct_4, string_agg(st.s, '' ORDER BY pos) AS struct_7
  FROM staged JOIN l28 ON l28.c = ch || staged.s JOIN st ON st.s = staged.s GROUP BY dataset_id, rec_id),
long_ AS (UNPIVOT spelled ON seq_4, seq_struct_8, seq_struct_16, seq_struct_28, struct_2, struct_4, struct_7 INTO NAME alphabet VALUE seq),
words AS (SELECT DISTINCT dataset_id, alphabet, rec_id, label, substr(seq, i::INTEGER, 5) AS motif FROM long_, range(1, 98) AS r(i) WHERE i + 4 <= length(seq)),
counts AS (SELECT dataset_id, alphabet, motif, count(*) AS n_with, sum(label)::BIGINT AS n_pos_with FROM words GROUP BY ALL),
size_ AS (SELECT dataset_id, count(*) AS total, sum(label)::BIGINT AS positives FROM lang GROUP BY 1),
known AS (SELECT *, count(*) OVER (PARTITION BY dataset_id, alphabet) AS words FROM counts JOIN size_ USING (dataset_id)),
terms AS (
  SELECT *, exp(
      lgamma(positives + 1) - lgamma(k + 1) - lgamma(positives - k + 1)
      + lgamma(total - positives + 1) - lgamma(n_with - k + 1) - lgamma(total - positives - n_with + k + 1)
      - lgamma(total + 1) + lgamma(n_with + 1) + lgamma(total - n_with + 1)) AS t
  FROM (SELECT *, unnest(range(greatest(n_pos_with, n_with - (total - positives)), least(positives, n_with) + 1)) AS k FROM known)),
tails AS (SELECT dataset_id, alphabet, motif, n_with, n_pos_with, words, sum(t) AS p FROM terms GROUP BY ALL)""", body="""
SELECT dataset_id, alphabet, motif, n_with, n_pos_with, round(log10(p), 4) AS log10_p FROM tails WHERE p < 0.01 / words
"""))
def motif_prior_words(spark, sf_dir):
    """The enriched words of every dataset in each of the seven alphabets."""
    states = F.rpad(F.lit(""), F.length("seq"), F.lit("HLRBMTE"))
    records = language_windows(spark, sf_dir).select("dataset_id", "rec_id", "label", S.normalize_rna("seq").alias("seq"), states.alias("states"))
    rows = MP.alphabet_rows(records, ["dataset_id", "rec_id", "label"], list(MP.ALPHABETS))
    words = MP.enriched_words(rows, ["dataset_id", "alphabet"], 5, None)
    return words.select("dataset_id", "alphabet", "motif", "n_with", "n_pos_with", F.round(F.log10("p"), 4).alias("log10_p"))


@query()
def motif_prior_features(spark, sf_dir):
    """The prior's features over all seven alphabets, as sparse vectors of the records of each dataset."""
    labels = language_windows(spark, sf_dir).select("rec_id", "label", "dataset_id")
    records = _stated(spark, sf_dir).drop("dataset_id").join(labels, "rec_id")
    features = materialize(MP.prior_features(records, list(MP.ALPHABETS), width=5, max_motifs=5, flank=1))
    vectors, places = MP.feature_vectors(features)
    entries = vectors.select("dataset_id", "class", F.explode(F.arrays_zip("places", "scores")).alias("e"))
    entries = entries.select("dataset_id", F.col("class").alias("label"), F.col("e.places").alias("place"), F.col("e.scores").alias("score"))
    return entries.join(places, ["dataset_id", "place"]).groupBy("dataset_id", "feature", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total_score")
    )


@query("""
WITH rows_ AS (
  SELECT l_returnflag AS dataset_id, ['AGGU', 'UGUGU', 'AGG'][CAST(l_linenumber % 3 AS INTEGER) + 1] AS motif,
    l_quantity - 25 AS distance, CASE WHEN l_linestatus = 'O' THEN '3ss' ELSE '5ss' END AS site FROM lineitem),
chosen AS (SELECT dataset_id, CASE dataset_id WHEN 'A' THEN 'UGUGU' WHEN 'N' THEN 'AGG' ELSE 'AGGU' END AS motif FROM rows_ GROUP BY ALL),
k AS (SELECT r.* FROM rows_ r JOIN chosen USING (dataset_id, motif) WHERE distance BETWEEN -20 AND 20
      AND dataset_id IN (SELECT dataset_id FROM rows_ WHERE site = '3ss') AND dataset_id IN (SELECT dataset_id FROM rows_ WHERE site = '5ss')),
b AS (SELECT dataset_id, motif, site, CAST(floor((distance + 20) / 2.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM k GROUP BY ALL)
SELECT dataset_id, motif, site, round(-20 + bin * 2.0::DOUBLE, 6) AS bin_start, n,
  round(n / (sum(n) OVER (PARTITION BY dataset_id, motif, site) * 2.0::DOUBLE), 9) AS density FROM b
""")
def splice_profile(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(m) for m in SP.MOTIFS])
    rows = li.select(
        F.col("l_returnflag").alias("dataset_id"),
        F.element_at(names, F.col("l_linenumber") % 3 + 1).alias("motif"),
        (F.col("l_quantity") - 25).alias("distance"), "l_linestatus",
    )
    # Two entries per dataset; the first supported one counts.
    listed = rows.select("dataset_id").distinct().select(
        "dataset_id",
        F.posexplode(
            F.when(F.col("dataset_id") == "A", F.array(F.lit("XX"), F.lit("UGUGU"), F.lit("AGG")))
            .when(F.col("dataset_id") == "N", F.array(F.lit("AGG"), F.lit("AGGU")))
            .otherwise(F.array(F.lit("AGGU")))
        ).alias("ord", "motif"),
    )
    site = lambda s: rows.where(F.col("l_linestatus") == s).drop("l_linestatus")
    out = SP.splice_profile(site("O"), site("F"), listed, "ord", -20.0, 20.0, 2.0)
    return rounded(out, 9)
