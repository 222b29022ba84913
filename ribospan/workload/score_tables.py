"""Score-table queries: lookups, counts, summaries, top-k, reshaping."""

from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.functions import scores as SC
from ribospan.operators import plugins as PL
from ribospan.operators import score_tables as T
from ribospan.plans.annotation import annotate_impacts
from ribospan.plans.ribosnitch import ribosnitch_dynamics
from ribospan.workload.inputs_sql import PVALUES, SCORES
from ribospan.workload.registry import query, with_ctes

CELLS = ["click", "view", "purchase", "signup", "error"]


@query(with_ctes(SCORES, PVALUES, """
last AS (SELECT rsid, arg_max(p_value, line_no) AS p_value FROM pvalues GROUP BY rsid)""", body="""
SELECT line_no, rsid, round(p_value, 9) AS p_value FROM scores LEFT JOIN last USING (rsid)
"""))
def attach_pvalue_last(spark, sf_dir):
    joined = T.attach_pvalue(X.score_rows(spark, sf_dir), X.pvalue_rows(spark, sf_dir), "line_no")
    return joined.select("line_no", "rsid", F.round("p_value", 9).alias("p_value"))


def _symbols(spark, sf_dir):
    # Even numbers only, so that odd genes have no symbol; three customers share each one.
    gene = (F.floor(F.col("c_custkey") / 3) * 2).alias("gene")
    return X.table(spark, sf_dir, "customer").select(
        gene, F.col("c_name").alias("gene_name"), F.col("c_custkey").alias("line_no")
    )


SYMBOLS = """
symbols AS (SELECT c_custkey // 3 * 2 AS gene, arg_max(c_name, c_custkey) AS gene_name FROM customer GROUP BY 1)
"""


@query(with_ctes(SCORES, SYMBOLS, body="""
SELECT line_no, coalesce(gene_name, '') AS gene_name
FROM scores LEFT JOIN symbols ON gene = rsid
"""))
def attach_gene_symbol(spark, sf_dir):
    s = X.score_rows(spark, sf_dir).withColumn("gene", F.col("rsid"))
    return T.attach_gene_symbol(s, _symbols(spark, sf_dir), "line_no").select("line_no", "gene_name")


TISSUES = {"click": "1-URGENT", "view": "2-HIGH", "purchase": "3-MEDIUM", "signup": "3-MEDIUM"}
EQTL = """
eqtl AS (SELECT o_orderpriority AS tissue, o_custkey AS rsid, (o_totalprice % 1000.0::DOUBLE) / 1e7::DOUBLE AS pval
         FROM orders),
joined AS (
  SELECT s.*, e.pval FROM (
    SELECT *, CASE cell WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' WHEN 'purchase' THEN '3-MEDIUM'
                        WHEN 'signup' THEN '3-MEDIUM' END AS tissue FROM scores) s
  LEFT JOIN eqtl e ON e.tissue = s.tissue AND e.rsid = s.rsid WHERE s.tissue IS NOT NULL)
"""


def _eqtl(spark, sf_dir):
    e = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("tissue"), F.col("o_custkey").alias("rsid"),
        ((F.col("o_totalprice") % 1000.0) / F.lit(1e7)).alias("pval_nominal"),
    )
    return T.attach_eqtl(X.score_rows(spark, sf_dir), e, TISSUES)


@query(with_ctes(SCORES, EQTL, body="""
SELECT line_no, tissue, round(-log10(coalesce(pval, 1)), 6) AS log10_p,
       coalesce(pval < 1e-5, false) AS is_significant_eqtl
FROM joined
"""))
def eqtl_left(spark, sf_dir):
    return _eqtl(spark, sf_dir).select(
        "line_no", "tissue", F.round("log10_p", 6).alias("log10_p"), "is_significant_eqtl"
    )


@query(with_ctes("""
gwas AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS chr, o_custkey AS pos, o_custkey % 97 AS rsid,
                (o_totalprice % 1000.0::DOUBLE + 1) / 1001.0::DOUBLE AS p_value, o_orderkey AS line_no FROM orders),
ld AS (SELECT 'rs' || c_custkey AS rs_number, CAST(c_custkey % 5 AS VARCHAR) AS chr, c_custkey AS pos,
              (c_custkey % 101) / 100.0::DOUBLE AS r2, c_custkey AS line_no FROM customer),
proxies AS (SELECT chr, pos, rs_number, CASE WHEN rs_number = 'rs7' THEN 1.0::DOUBLE ELSE r2 END AS r2 FROM ld),
merged AS (SELECT g.*, rs_number, r2 FROM gwas g JOIN proxies USING (chr, pos)
           WHERE chr = (SELECT chr FROM ld WHERE rs_number = 'rs7')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rsid ORDER BY line_no, rs_number) AS rn FROM merged)""", body="""
SELECT rsid, chr, pos, rs_number, round(r2, 6) AS r2, round(-log10(p_value), 6) AS log_p,
  CASE WHEN r2 <= 0 THEN NULL WHEN r2 <= 0.2 THEN '0.2' WHEN r2 <= 0.4 THEN '0.4' WHEN r2 <= 0.6 THEN '0.6'
       WHEN r2 <= 0.8 THEN '0.8' ELSE '1' END AS ld_bin
FROM ranked WHERE rn = 1
"""))
def ld_bins(spark, sf_dir):
    o, c = X.table(spark, sf_dir, "orders"), X.table(spark, sf_dir, "customer")
    gwas = o.select(
        (F.col("o_custkey") % 5).cast("string").alias("chr"), F.col("o_custkey").alias("pos"),
        (F.col("o_custkey") % 97).alias("rsid"),
        ((F.col("o_totalprice") % 1000.0 + 1) / 1001.0).alias("p_value"), F.col("o_orderkey").alias("line_no"),
    )
    ld = c.select(
        F.concat(F.lit("rs"), F.col("c_custkey").cast("string")).alias("rs_number"),
        (F.col("c_custkey") % 5).cast("string").alias("chr"), F.col("c_custkey").alias("pos"),
        ((F.col("c_custkey") % 101) / 100.0).alias("r2"), F.col("c_custkey").alias("line_no"),
    )
    out = T.attach_ld(gwas, ld, "rs7")
    return out.select(
        "rsid", "chr", "pos", "rs_number", F.round("r2", 6).alias("r2"), F.round("log_p", 6).alias("log_p"), "ld_bin"
    )


@query(with_ctes(SCORES, body="""
, categories AS (SELECT DISTINCT p_type AS category, p_partkey % 20 AS rbp FROM part)
SELECT category, cell, count(*) AS n, round(avg(alt_score), 6) AS mean_score
FROM scores JOIN categories USING (rbp) GROUP BY ALL
"""))
def category_membership(spark, sf_dir):
    cats = X.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), (F.col("p_partkey") % 20).alias("rbp")
    )
    joined = T.category_membership(X.score_rows(spark, sf_dir), cats, "rbp")
    return joined.groupBy("category", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("alt_score"), 6).alias("mean_score")
    )


@query(with_ctes(SCORES, body="""
SELECT rsid, line_no, rbp, cell, round(alt_score, 6) AS alt_score FROM (
  SELECT *, row_number() OVER (PARTITION BY rsid ORDER BY line_no) AS rn FROM scores) WHERE rn = 1
"""))
def first_row_per_rsid(spark, sf_dir):
    s = X.score_rows(spark, sf_dir).select("rsid", "line_no", "rbp", "cell", "alt_score")
    return T.first_row(s, ["rsid"], ["line_no"]).withColumn("alt_score", F.round("alt_score", 6))


# The two cells named in a line, as the ribosnitch lines carry them.
TWO_CELLS = """
two AS (SELECT *, CASE WHEN line_no % 2 = 0 THEN 'click' ELSE 'view' END AS cell1,
                  CASE WHEN line_no % 3 = 0 THEN 'purchase' ELSE 'signup' END AS cell2, ref_score AS score FROM scores)
"""
DYNAMIC_FIRST = """
SELECT rbp, CAST(sum(CASE WHEN in1 <> in2 THEN 1 ELSE 0 END) AS BIGINT) AS dynamic,
       CAST(sum(CASE WHEN in1 AND in2 THEN 1 ELSE 0 END) AS BIGINT) AS common
FROM (SELECT rbp, list_contains(cells, c1) AS in1, list_contains(cells, c2) AS in2 FROM (
  SELECT variant, rbp, list(DISTINCT cell) AS cells, arg_min(cell1, line_no) AS c1, arg_min(cell2, line_no) AS c2
  FROM gated GROUP BY ALL))
GROUP BY rbp
"""


def _two_cells(spark, sf_dir):
    line = F.col("line_no")
    return (
        X.score_rows(spark, sf_dir)
        .withColumn("cell1", F.when(line % 2 == 0, "click").otherwise("view"))
        .withColumn("cell2", F.when(line % 3 == 0, "purchase").otherwise("signup"))
        .withColumn("score", F.col("ref_score"))
    )


@query(with_ctes(SCORES, TWO_CELLS, "gated AS (SELECT * FROM two WHERE score > 0 OR score <= 0)", body=f"""
SELECT *, round(ln(1 + dynamic + 0.5 * (dynamic * common + 1)), 9) AS odds_ratio FROM ({DYNAMIC_FIRST})
"""))
def dynamic_common(spark, sf_dir):
    out = T.dynamic_common_first(_two_cells(spark, sf_dir), "line_no")
    return out.withColumn("odds_ratio", F.round("odds_ratio", 9))


@query(with_ctes(SCORES, TWO_CELLS, "gated AS (SELECT * FROM two WHERE score >= 0)", """
order_(cell, o) AS (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('signup', 4), ('error', 5)),
pairs AS (SELECT a.cell AS c1, b.cell AS c2 FROM order_ a JOIN order_ b ON a.o < b.o),
sets AS (SELECT variant, rbp, list(DISTINCT cell) AS cells FROM gated GROUP BY ALL),
fixed AS (
  SELECT c1 || '_' || c2 AS cell_line_pair, rbp,
    CAST(sum(CASE WHEN list_contains(cells, c1) <> list_contains(cells, c2) THEN 1 ELSE 0 END) AS BIGINT) AS dynamic,
    CAST(sum(CASE WHEN list_contains(cells, c1) AND list_contains(cells, c2) THEN 1 ELSE 0 END) AS BIGINT) AS common
  FROM sets, pairs WHERE list_contains(cells, c1) OR list_contains(cells, c2) GROUP BY ALL),
everything AS (
  SELECT 'All pairwise cells' AS cell_line_pair, * FROM (""" + DYNAMIC_FIRST + """)
  UNION ALL SELECT * FROM fixed)""", body="""
SELECT *, round(ln(1 + dynamic + 0.5 * (dynamic * common + 1)), 9) AS odds_ratio FROM everything
"""))
def ribosnitch_dynamics_odds(spark, sf_dir):
    out = ribosnitch_dynamics(_two_cells(spark, sf_dir), CELLS, inclusive=True)
    return out.withColumn("odds_ratio", F.round("odds_ratio", 9))


@query("""
WITH c AS (SELECT DISTINCT event_type AS cell FROM events)
SELECT a.cell AS cell1, b.cell AS cell2 FROM c a JOIN c b ON a.cell < b.cell
""")
def cell_pairs(spark, sf_dir):
    cells = X.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cell"), F.col("event_type").alias("ord")
    )
    return T.cell_pairs(cells.distinct())


# Disease tags come from part names: "[word|word]" inside a line.
TAGGED = """
tagged AS (
  SELECT l_orderkey AS variant, l_linenumber AS k, '[' || replace(p_name, ' ', '|') || ']' AS tag,
         l_quantity - 25 AS score, l_extendedprice AS ord
  FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def _tagged(spark, sf_dir):
    li, p = X.table(spark, sf_dir, "lineitem"), X.table(spark, sf_dir, "part")
    line = F.concat(F.lit("x ["), F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("] y"))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("variant"), F.col("l_linenumber").alias("k"),
        T.disease_tags(line).alias("tags"), (F.col("l_quantity") - 25).alias("score"),
        F.col("l_extendedprice").alias("ord"),
    )


@query(with_ctes(TAGGED, body="""
SELECT disease, count(DISTINCT variant) AS n_variants FROM (
  SELECT variant, unnest(string_split(trim(tag, '[]'), '|')) AS disease FROM tagged)
WHERE disease NOT IN ('ring', 'gear') GROUP BY disease
"""))
def disease_counts(spark, sf_dir):
    return T.disease_counts(_tagged(spark, sf_dir), ["ring", "gear"])


@query(with_ctes(TAGGED, """
dis(disease) AS (VALUES ('ring'), ('small'), ('a')),
rows_ AS (SELECT t.*, disease FROM tagged t JOIN dis ON EXISTS (
  SELECT 1 FROM (SELECT unnest(string_split(trim(t.tag, '[]'), '|')) AS w) WHERE contains(w, disease))),
before AS (SELECT k, disease, arg_min(score, struct_pack(a := ord, b := score)) AS b FROM rows_ WHERE score < 0 GROUP BY ALL),
impact AS (SELECT r.disease, r.score - b AS d FROM rows_ r JOIN before USING (k, disease))""", body="""
SELECT disease, round(avg(CASE WHEN d > 0 THEN d END), 6) AS positive_impact,
  round(avg(CASE WHEN d < 0 THEN d END), 6) AS negative_impact,
  CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative
FROM impact GROUP BY disease
"""))
def disease_impact(spark, sf_dir):
    rows = _tagged(spark, sf_dir).withColumn("ord", F.struct("ord", "score"))
    out = T.disease_impact(
        rows.where(F.col("score") < 0), rows, ["ring", "small", "a"], ["k"], "ord"
    )
    return out.withColumns(
        {c: F.round(c, 6) for c in ("positive_impact", "negative_impact")}
    )


@query(with_ctes("""
rows_ AS (SELECT p_partkey, lower(replace(replace(p_name, ' ', '|'), '_', ' ')) AS d FROM part WHERE trim(p_brand) <> ''),
words(tissue, keyword) AS (VALUES ('heart', 'Ring'), ('heart', 'Small'), ('brain', 'e'))""", body="""
SELECT tissue, keyword, count(*) AS n_variants FROM rows_, words
WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split(d, '|')) AS w) WHERE contains(w, lower(keyword)))
GROUP BY ALL
"""))
def tissue_keyword_counts(spark, sf_dir):
    rows = X.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("rbp_list"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("diseases")
    )
    return T.tissue_keyword_counts(rows, {"heart": ["Ring", "Small"], "brain": ["e"]})


@query("""
SELECT l_returnflag AS grp, count(DISTINCT (l_orderkey, split_part(p_type, '_', 1))) AS n_variant_rbp
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
""")
def variant_rbp_counts(spark, sf_dir):
    li, p = X.table(spark, sf_dir, "lineitem"), X.table(spark, sf_dir, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("variant"),
        F.concat_ws("_", "p_type", "p_brand").alias("rbp"),
    )
    return T.variant_rbp_counts(rows, ["grp"], "variant", "rbp")


def _counts(spark, sf_dir):
    return X.score_rows(spark, sf_dir).groupBy("cell", F.col("rbp").cast("string").alias("rbp")).agg(
        F.countDistinct("variant").alias("n")
    )


COUNTS = "counts AS (SELECT cell, CAST(rbp AS VARCHAR) AS rbp, count(DISTINCT variant) AS n FROM scores GROUP BY ALL)"


@query(with_ctes(SCORES, COUNTS, body="""
SELECT cell, name AS rbp, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT cell, n, CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY n DESC, rbp) <= 3 THEN rbp ELSE 'Other' END AS name
  FROM counts)
GROUP BY ALL
"""))
def topk_other(spark, sf_dir):
    return T.topk_other(_counts(spark, sf_dir), ["cell"], "rbp", "n", 3)


@query(with_ctes(SCORES, COUNTS, body="""
SELECT rbp, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (cell = '{c}'), 0) AS BIGINT) AS {c}" for c in CELLS) + """,
  CAST(sum(n) AS BIGINT) AS row_total FROM counts GROUP BY rbp
"""))
def pivot_counts(spark, sf_dir):
    return T.pivot_matrix(_counts(spark, sf_dir), "rbp", "cell", "n", CELLS)


LOCI = """
loci AS (SELECT 'chr' || (variant % 5) || ':' || variant || ':' || (variant + 101) AS locus, cell,
                abs(1 / (1 + exp(-alt_score)) - 1 / (1 + exp(-ref_score))) AS s FROM scores)
"""


def _loci(spark, sf_dir):
    s = X.score_rows(spark, sf_dir)
    return T.locus_cell_effect(
        s.select(
            F.concat(F.lit("chr"), (F.col("variant") % 5).cast("string")).alias("chr"),
            F.col("variant").alias("start_pos"), (F.col("variant") + 101).alias("end_pos"),
            "cell", "alt_score", "ref_score",
        )
    )


@query(with_ctes(SCORES, LOCI, body="SELECT locus, cell, round(avg(s), 9) AS abs_diff FROM loci GROUP BY ALL"))
def locus_cell_effect(spark, sf_dir):
    return _loci(spark, sf_dir).withColumn("abs_diff", F.round("abs_diff", 9))


@query(with_ctes(SCORES, LOCI, """
order_(cell, o) AS (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('signup', 4), ('error', 5)),
p AS (SELECT locus, string_agg(cell, '+' ORDER BY o) AS pattern, count(*) AS n
      FROM (SELECT DISTINCT locus, cell FROM loci) JOIN order_ USING (cell) GROUP BY locus)""", body="""
SELECT locus, pattern, CAST(n AS INTEGER) AS n_cells, CASE WHEN n = 1 THEN 'specific' ELSE 'sharing' END AS "group" FROM p
"""))
def presence_pattern(spark, sf_dir):
    return T.presence_pattern(_loci(spark, sf_dir), CELLS)


INVENTORY = """
inv AS (SELECT user_id || '-' || (event_id % 40) AS rbp, event_type AS cell, count(*) AS n FROM events GROUP BY ALL),
full_ AS (SELECT *, (SELECT count(DISTINCT cell) FROM inv i WHERE i.rbp = inv.rbp) AS n_cells FROM inv)
"""


def _inventory(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    part = (F.col("event_id") % 40).cast("string")
    counts = e.groupBy(
        F.concat_ws("-", F.col("user_id").cast("string"), part).alias("rbp"), F.col("event_type").alias("cell")
    ).agg(F.count(F.lit(1)).alias("n"))
    return T.motif_inventory(counts)


@query(with_ctes(INVENTORY, body="""
SELECT rbp, cell, n, round(ln(n + 1), 9) AS log_n, n_cells FROM full_ WHERE n_cells >= 2
"""))
def motif_inventory(spark, sf_dir):
    return T.shared_rbps(_inventory(spark, sf_dir), 2).withColumn("log_n", F.round("log_n", 9))


@query(with_ctes(INVENTORY, body="""
SELECT rbp, cell, n, CAST(max(CASE WHEN cell = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY rbp) AS INTEGER) AS in_split_cell
FROM full_ WHERE n_cells < 2
"""))
def private_inventory(spark, sf_dir):
    return T.private_rbps(_inventory(spark, sf_dir), "click", 2).select("rbp", "cell", "n", "in_split_cell")


@query(with_ctes(SCORES, COUNTS, body="""
SELECT rbp, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (cell = '{c}'), 0) AS BIGINT) AS {c}" for c in CELLS) + """
FROM counts GROUP BY rbp ORDER BY """ + ", ".join(f"{c} DESC" for c in CELLS) + """, rbp
"""))
def order_rows_by_cells(spark, sf_dir):
    return T.order_rows_by_cells(_counts(spark, sf_dir), CELLS)


@query(with_ctes(SCORES, body="""
SELECT cell, count(*) AS n_rows, round(avg(alt_score), 6) AS alt_score_mean, round(avg(ref_score), 6) AS ref_score_mean,
  round(avg(alt_score - ref_score), 6) AS delta_mean,
  round(avg(CASE WHEN (alt_score >= 0) <> (ref_score >= 0) THEN 1.0::DOUBLE ELSE 0 END), 6) AS sign_flip_rate,
  count(DISTINCT rsid) AS n_unique_rsid, round(median(alt_score - ref_score), 6) AS delta_median
FROM scores GROUP BY cell
"""))
def impact_summary(spark, sf_dir):
    out = T.score_summary(X.score_rows(spark, sf_dir), ["cell"])
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query(with_ctes(SCORES, "long AS (UNPIVOT (SELECT alt_score, ref_score, maf FROM scores) ON alt_score, ref_score, maf INTO NAME name VALUE value)", body="""
SELECT name, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75
FROM long GROUP BY name
"""))
def describe_scores(spark, sf_dir):
    out = T.describe_columns(X.score_rows(spark, sf_dir), ["alt_score", "ref_score", "maf"])
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query(with_ctes(SCORES, body="""
SELECT line_no, rsid, rbp, cell, round(abs(alt_score - ref_score), 9) AS abs_delta
FROM scores ORDER BY abs(alt_score - ref_score) DESC, line_no LIMIT 10
"""))
def impact_topk(spark, sf_dir):
    s = X.score_rows(spark, sf_dir).withColumn("delta_score", SC.delta("alt_score", "ref_score"))
    return T.top_by_abs_delta(s, 10, ties=["line_no"]).select(
        "line_no", "rsid", "rbp", "cell", F.round("abs_delta", 9).alias("abs_delta")
    )


@query(with_ctes(SCORES, body="""
SELECT bucket, cls, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median,
  round(quantile_cont(d, 0.75), 6) AS q3, count(*) AS n, round(avg(d), 6) AS mean
FROM (SELECT alt_score - ref_score AS d,
  CASE WHEN maf < 0.001 THEN '<0.001' WHEN maf > 0.05 THEN '>0.05' ELSE '0.001-0.05' END AS bucket,
  CASE WHEN contains(cell, 'i') THEN 'intronic' WHEN contains(cell, 'e') THEN 'exonic' END AS cls FROM scores)
WHERE cls IS NOT NULL GROUP BY ALL
"""))
def maf_region_box(spark, sf_dir):
    s = X.score_rows(spark, sf_dir).select(
        SC.maf_bucket("maf").alias("bucket"),
        SC.region_class("cell", {"i": "intronic", "e": "exonic"}).alias("cls"),
        SC.delta("alt_score", "ref_score").alias("d"),
    )
    out = T.group_box_stats(s.where(F.col("cls").isNotNull()), ["bucket", "cls"], "d")
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query("""
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)
""")
def exclude_top(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = T.exclude_top(o, "o_custkey", [F.col("o_totalprice"), F.col("o_orderkey")], 5)
    return out.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""
SELECT p_brand, count(*) AS n FROM part
WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10) GROUP BY 1
""")
def keep_top_categories(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").select("p_brand")
    return T.keep_top_categories(p, "p_brand", 10).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(SCORES, body="""
, d AS (SELECT cell, alt_score - ref_score AS v FROM scores),
b AS (SELECT cell, CAST(floor((v + 5) / 0.5::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM d
      WHERE v BETWEEN -5 AND 5 GROUP BY ALL)
SELECT cell, round(-5 + bin * 0.5::DOUBLE, 6) AS bin_start, n,
  round(n / (sum(n) OVER (PARTITION BY cell) * 0.5::DOUBLE), 9) AS density FROM b
"""))
def position_density(spark, sf_dir):
    s = X.score_rows(spark, sf_dir).select("cell", SC.delta("alt_score", "ref_score").alias("v"))
    out = T.position_density(s, ["cell"], "v", -5.0, 5.0, 0.5)
    return out.withColumns({c: F.round(c, 9) for c in ("bin_start", "density")})


@query(with_ctes(SCORES, body="""
, c AS (SELECT cell, CAST(floor(ref_score / 0.25::DOUBLE) AS BIGINT) AS ix, CAST(floor(alt_score / 0.25::DOUBLE) AS BIGINT) AS iy,
               count(*) AS n FROM scores GROUP BY ALL)
SELECT cell, ix, iy, n, round(n / max(n) OVER (PARTITION BY cell), 9) AS ndensity FROM c
"""))
def grid_density(spark, sf_dir):
    out = T.grid_density(X.score_rows(spark, sf_dir), ["cell"], "ref_score", "alt_score", 0.25, 0.25)
    return out.withColumn("ndensity", F.round("ndensity", 9))


@query(with_ctes(SCORES, body="""
SELECT rbp, name, round(avg(value), 6) AS mean, count(*) AS n FROM (
  SELECT rbp, 'ref_score' AS name, ref_score AS value FROM scores UNION ALL
  SELECT rbp, 'alt_score', alt_score FROM scores UNION ALL SELECT rbp, 'maf', maf FROM scores)
WHERE value IS NOT NULL GROUP BY ALL
"""))
def unpivot_long(spark, sf_dir):
    s = X.score_rows(spark, sf_dir).select("rbp", "ref_score", "alt_score", "maf")
    long = T.unpivot_long(s, ["rbp"], ["ref_score", "alt_score", "maf"])
    return long.groupBy("rbp", "name").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n")
    )


@query(with_ctes(SCORES, PVALUES, """
last AS (SELECT rsid, arg_max(p_value, line_no) AS p FROM pvalues GROUP BY rsid),
named AS (SELECT s.*, p, CASE WHEN line_no % 3 = 0 THEN 'ENSG' ELSE 'ENST' END || lpad(variant::VARCHAR, 8, '0') || '.' || (line_no % 4) AS id
          FROM scores s LEFT JOIN last USING (rsid))""", body="""
SELECT split_part(id, '.', 1) AS transcript,
       CASE WHEN p < 0.05 AND alt_score - ref_score > 1 THEN 'Up-regulated'
            WHEN p < 0.05 AND alt_score - ref_score < -1 THEN 'Down-regulated' ELSE 'Not significant' END AS volcano, count(*) AS n
FROM named WHERE id LIKE 'ENST%' GROUP BY ALL
"""))
def volcano_transcripts(spark, sf_dir):
    """Transcripts only, without the version of their identifier."""
    joined = T.attach_pvalue(X.score_rows(spark, sf_dir), X.pvalue_rows(spark, sf_dir), "line_no")
    kind = F.when(F.col("line_no") % 3 == 0, "ENSG").otherwise("ENST")
    number = F.lpad(F.col("variant").cast("string"), 8, "0")
    rows = joined.withColumn("id", F.concat(kind, number, F.lit("."), (F.col("line_no") % 4).cast("string")))
    table = T.volcano_table(rows.withColumn("b", F.col("alt_score") - F.col("ref_score")), "id", "p_value", "b")
    return table.groupBy("transcript", "volcano").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(SCORES, body="""
SELECT rbp, cell, median(ref_score) FILTER (maf > 0.02::DOUBLE) AS middle, count(*) FILTER (maf > 0.02::DOUBLE) AS n, max(ref_score) FILTER (maf > 0.02::DOUBLE) AS most
FROM scores GROUP BY ALL
"""))
def stat_fun_columns(spark, sf_dir):
    """A caller's aggregate columns over the values that the caller's filter lets through."""
    rows = X.score_rows(spark, sf_dir)
    stats = {"middle": F.median, "n": F.count, "most": F.max}
    return PL.summarise(rows, ["rbp", "cell"], "ref_score", stats, lambda v: F.col("maf") > 0.02)


@query(with_ctes(SCORES, body="""
SELECT cell, count(*) AS n, round(avg(ref_score), 9) AS mean, round(stddev_samp(ref_score), 9) AS deviation FROM scores GROUP BY cell
"""))
def stat_fun_arrow(spark, sf_dir):
    """A caller's functions over Arrow tables, with partial results of shares of a group."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def partial(table: pa.Table) -> dict:
        v = table.column("ref_score")
        return {"n": len(v), "total": pc.sum(v).as_py(), "squares": pc.sum(pc.multiply(v, v)).as_py()}

    def combine(table: pa.Table) -> dict:
        n, total, squares = (pc.sum(table.column(c)).as_py() for c in ("n", "total", "squares"))
        return {"n": n, "mean": total / n, "deviation": ((squares - total * total / n) / (n - 1)) ** 0.5}

    rows = X.score_rows(spark, sf_dir).select("cell", "line_no", "ref_score")
    out = PL.summarise_arrow(
        rows, ["cell"], partial, combine, "n bigint, total double, squares double", "n bigint, mean double, deviation double", share_rows=1500
    )
    return out.select("cell", "n", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


@query(with_ctes(SCORES, body="""
SELECT rbp, total, row_number() OVER (ORDER BY total DESC, rbp) AS place
FROM (SELECT rbp, sum(line_no)::BIGINT AS total FROM scores GROUP BY rbp)
"""))
def columns_by_total(spark, sf_dir):
    return T.columns_by_total(X.score_rows(spark, sf_dir), "rbp", "line_no").select("rbp", "total", "place")


@query(with_ctes(SCORES, PVALUES, SYMBOLS, """
last AS (SELECT rsid, arg_max(p_value, line_no) AS p_value FROM pvalues GROUP BY rsid)""", body="""
SELECT s.line_no, coalesce(gene_name, '') AS gene_name, round(alt_score - ref_score, 6) AS delta_score,
  round(abs(1 / (1 + exp(-alt_score)) - 1 / (1 + exp(-ref_score))), 9) AS abs_shift, round(p_value, 9) AS p_value
FROM scores s LEFT JOIN symbols ON gene = rsid LEFT JOIN last USING (rsid)
"""))
def annotate_impacts_table(spark, sf_dir):
    s = X.score_rows(spark, sf_dir)
    keys = ["rbp", "cell", "line_no", "rsid"]
    before = s.select(*keys, F.col("ref_score").alias("score"))
    after = s.select(*keys, F.col("rsid").alias("gene"), F.col("alt_score").alias("score"))
    out = annotate_impacts(
        before, after, keys, _symbols(spark, sf_dir), X.pvalue_rows(spark, sf_dir), "line_no", "line_no"
    )
    return out.select(
        "line_no", "gene_name", F.round("delta_score", 6).alias("delta_score"),
        F.round("abs_shift", 9).alias("abs_shift"), F.round("p_value", 9).alias("p_value"),
    )


@query(with_ctes(SCORES, PVALUES, """
last AS (SELECT rsid, arg_max(p_value, line_no) AS p FROM pvalues GROUP BY rsid),
j AS (SELECT s.*, p FROM scores s LEFT JOIN last USING (rsid))""", body="""
SELECT volcano, stars, clinical, disease, count(*) AS n FROM (
  SELECT CASE WHEN p < 0.05 AND alt_score - ref_score > 1 THEN 'Up-regulated'
              WHEN p < 0.05 AND alt_score - ref_score < -1 THEN 'Down-regulated' ELSE 'Not significant' END AS volcano,
    CASE WHEN p IS NULL THEN 'NA' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars,
    CASE WHEN contains(text_, 'Benign') OR contains(text_, 'benign') THEN 'Benign'
         WHEN contains(text_, 'Pathogenic') OR contains(text_, 'probably_damaging') THEN 'Pathogenic' END AS clinical,
    CASE WHEN cell = 'error' THEN NULL WHEN cell = 'click' THEN 'view' ELSE cell END AS disease
  FROM (SELECT *, CASE rbp % 4 WHEN 0 THEN 'Likely_benign,Pathogenic' WHEN 1 THEN 'Pathogenic'
                  WHEN 2 THEN 'probably_damaging' ELSE 'other' END AS text_ FROM j))
GROUP BY ALL
"""))
def class_rules(spark, sf_dir):
    j = T.attach_pvalue(X.score_rows(spark, sf_dir), X.pvalue_rows(spark, sf_dir), "line_no")
    text = (
        F.when(F.col("rbp") % 4 == 0, "Likely_benign,Pathogenic").when(F.col("rbp") % 4 == 1, "Pathogenic")
        .when(F.col("rbp") % 4 == 2, "probably_damaging").otherwise("other")
    )
    return (
        j.withColumn("b", SC.delta("alt_score", "ref_score"))
        .groupBy(
            SC.volcano_class("p_value", "b").alias("volcano"), SC.significance_stars("p_value").alias("stars"),
            SC.clinical_class(text).alias("clinical"),
            SC.normalize_disease("cell", ["error"], {"click": "view"}).alias("disease"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("""
SELECT c_mktsegment, count(v) AS n, round(sum(v), 2) AS total FROM (
  SELECT c_mktsegment, try_cast(CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS v FROM customer)
WHERE v IS NOT NULL GROUP BY ALL
""")
def coerce_numeric(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select(
        "c_mktsegment",
        F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("v"),
    )
    return T.coerce_and_drop(c, ["v"]).groupBy("c_mktsegment").agg(
        F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("total")
    )
