"""Score-table analytics: lookups, counts, summaries, pivots, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ribospan.functions import scores as SC
from ribospan.functions.constants import IMPACT_DISEASES, INVALID_DISEASES, TISSUE_KEYWORDS
from ribospan.functions.core import string_map
from ribospan.operators.ordered import exact_quantiles, running_sums

# ---------------------------------------------------------------- lookups


def attach_pvalue(scores: DataFrame, pvalues: DataFrame, order: str) -> DataFrame:
    """Left lookup by rsid; of duplicate rsids the last by ``order`` wins."""
    last = pvalues.groupBy("rsid").agg(F.max_by("p_value", order).alias("p_value"))
    return scores.join(last, "rsid", "left")


def attach_gene_symbol(scores: DataFrame, symbols: DataFrame, order: str | None = None) -> DataFrame:
    """Left lookup of ``gene_name``; missing is the empty string.

    Of a gene listed twice the last by ``order`` wins, without an order the greatest name.
    """
    last = symbols.groupBy("gene").agg(F.max_by("gene_name", order or "gene_name").alias("gene_name"))
    return scores.join(last, "gene", "left").withColumn(
        "gene_name", F.coalesce("gene_name", F.lit(""))
    )


# Tissue used for each cell line.
CELL_TO_TISSUE = {
    "HepG2": "Liver", "K562": "Whole_Blood", "HEK293": "Kidney_Cortex", "HEK293T": "Kidney_Cortex",
}


def attach_eqtl(
    scores: DataFrame, eqtl: DataFrame, cell_to_tissue: dict[str, str] | None = None,
    threshold: float = 1e-5,
) -> DataFrame:
    """Left join on (tissue of the cell, rsid) for all cells at once; duplicates fan out."""
    tissue = F.try_element_at(string_map(cell_to_tissue or CELL_TO_TISSUE), F.col("cell"))
    mapped = scores.withColumn("tissue", tissue).where(F.col("tissue").isNotNull())
    joined = mapped.join(eqtl.select("tissue", "rsid", "pval_nominal"), ["tissue", "rsid"], "left")
    return joined.withColumn(
        "log10_p", SC.neg_log10_p("pval_nominal", missing_as_one=True)
    ).withColumn(
        "is_significant_eqtl", F.coalesce(F.col("pval_nominal") < threshold, F.lit(False))
    )


def attach_ld(gwas: DataFrame, ld: DataFrame, lead_snp: str) -> DataFrame:
    """LD to the lead SNP by (chr, pos), its chromosome only, first row per rsid.

    ``gwas``: chr, pos, rsid, p_value, line_no. ``ld``: rs_number, chr, pos, r2, line_no. A
    lead SNP missing from ``ld`` is placed at the first proxy.
    """
    is_lead = F.col("rs_number") == lead_snp
    usable = ld.where(is_lead | (F.col("r2") >= 0)).select("rs_number", "chr", "pos", "r2", "line_no")
    place = usable.agg(
        F.max(is_lead.cast("int")).alias("present"),
        F.min_by(F.struct("chr", "pos"), "line_no").alias("first"),
        F.min_by("chr", F.when(is_lead, F.col("line_no"))).alias("lead_chr"),
    )
    placeholder = place.where("present = 0").select(
        F.lit(lead_snp).alias("rs_number"), "first.chr", "first.pos",
        F.lit(None).cast("double").alias("r2"), F.lit(None).cast("bigint").alias("line_no"),
    )
    proxies = usable.unionByName(placeholder).select(
        "chr", "pos", "rs_number", F.when(is_lead, F.lit(1.0)).otherwise(F.col("r2")).alias("r2")
    )
    lead_chr = place.select(F.coalesce("lead_chr", "first.chr")).scalar()
    merged = (
        gwas.where(F.col("chr") == lead_chr)
        .join(proxies, ["chr", "pos"], "left")
        .where(F.col("r2").isNotNull())
    )
    fields = ["chr", "pos", "p_value", "rs_number", "r2"]
    first = merged.groupBy("rsid").agg(
        F.min(F.struct(F.col("line_no"), F.col("rs_number").alias("_o"), F.struct(*fields).alias("v"))).alias("f")
    )
    return first.select(
        "rsid", *[F.col(f"f.v.{c}").alias(c) for c in fields],
        SC.neg_log10_p("f.v.p_value").alias("log_p"), SC.ld_bin("f.v.r2").alias("ld_bin"),
    )


def category_membership(scores: DataFrame, categories: DataFrame, on: str) -> DataFrame:
    """One row per (row, category it belongs to)."""
    return scores.join(categories.distinct(), on)


def first_row(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First row per key by explicit order, as a minimum (partial aggregation), not a window."""
    rest = [c for c in df.columns if c not in by and c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(*by).agg(F.min(packed).alias("_f")).select(
        *by, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]]
    )


# ----------------------------------------------------------------- counts


def presence(df: DataFrame) -> DataFrame:
    """Per (variant, rbp): the set of cells, at most one entry per cell line."""
    return df.groupBy("variant", "rbp").agg(F.collect_set("cell").alias("cells"))


def dynamic_common_first(df: DataFrame, order: str) -> DataFrame:
    """Dynamic and common counts per RBP with the cell pair of the first row of each (variant, rbp)."""
    per = df.groupBy("variant", "rbp").agg(
        F.collect_set("cell").alias("cells"),
        F.min_by(F.struct("cell1", "cell2"), order).alias("pair"),
    )
    return _dynamic_counts(per, F.col("pair.cell1"), F.col("pair.cell2"), ["rbp"])


def dynamic_common_pairs(df: DataFrame, cells: list[str]) -> DataFrame:
    """The same for every fixed pair of ``cells``; rows of other cells do not take part in a pair."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"))
            for i, a in enumerate(cells)
            for b in cells[i + 1 :]
        ]
    )
    touched = F.filter(
        pairs,
        lambda p: F.array_contains(F.col("cells"), p["c1"]) | F.array_contains(F.col("cells"), p["c2"]),
    )
    per = presence(df).select("variant", "rbp", "cells", F.inline(touched))
    out = _dynamic_counts(per, F.col("c1"), F.col("c2"), ["c1", "c2", "rbp"])
    return out.withColumn("cell_line_pair", F.concat_ws("_", "c1", "c2")).drop("c1", "c2")


def _dynamic_counts(per: DataFrame, c1: Column, c2: Column, by: list[str]) -> DataFrame:
    in1, in2 = F.array_contains("cells", c1), F.array_contains("cells", c2)
    agg = per.groupBy(*by).agg(
        F.sum((in1 != in2).cast("bigint")).alias("dynamic"),
        F.sum((in1 & in2).cast("bigint")).alias("common"),
    )
    return agg.withColumn("odds_ratio", SC.dynamic_score("dynamic", "common"))


def cell_pairs(cells: DataFrame) -> DataFrame:
    """All i < j pairs of a cell list (``cell``, ``ord``), built from one small array."""
    ordered = cells.agg(F.sort_array(F.collect_set(F.struct("ord", "cell"))).alias("c"))
    pairs = F.flatten(
        F.transform(
            "c",
            lambda a: F.transform(
                F.filter("c", lambda b: b["ord"] > a["ord"]),
                lambda b: F.struct(a["cell"].alias("cell1"), b["cell"].alias("cell2")),
            ),
        )
    )
    return ordered.select(F.inline(pairs))


def disease_tags(line: str | Column, spaces_to_underscore: bool = False) -> Column:
    """Labels of the first ``[a|b]`` tag of a line; null when there is none."""
    text = F.col(line) if isinstance(line, str) else line
    tag = F.regexp_extract(text, r"\[(.*?)\]", 1)
    if spaces_to_underscore:
        tag = F.replace(tag, F.lit(" "), F.lit("_"))
    return F.when(text.rlike(r"\[.*?\]"), F.split(tag, r"\|"))


def disease_counts(df: DataFrame, invalid: list[str] | None = None, variant: str = "variant", tags: str = "tags") -> DataFrame:
    """Number of distinct variants carrying each valid label (by default all that name a disease)."""
    invalid = INVALID_DISEASES if invalid is None else invalid
    pairs = df.select(variant, F.explode(F.array_distinct(tags)).alias("disease")).where(
        ~F.col("disease").isin(invalid)
    )
    return pairs.groupBy("disease").agg(F.countDistinct(variant).alias("n_variants"))


def disease_impact(
    before: DataFrame, after: DataFrame, diseases: list[str] | None, key: list[str], order: str
) -> DataFrame:
    """Mean positive and mean negative (after - before) per disease.

    The before score of a (key, disease) is that of its first row and serves all after
    rows; a disease matches when any tag contains it. ``None`` takes the stated list.
    """
    table = F.array(*[F.lit(d) for d in (IMPACT_DISEASES if diseases is None else diseases)])
    matched = F.filter(
        table, lambda d: F.exists(F.col("tags"), lambda t: F.contains(t, d))
    )
    first = (
        before.select(*key, order, "score", F.explode(matched).alias("disease"))
        .groupBy(*key, "disease")
        .agg(F.min_by("score", order).alias("before_score"))
    )
    rows = after.select(*key, "score", F.explode(matched).alias("disease")).join(
        first, [*key, "disease"]
    )
    impact = F.col("score") - F.col("before_score")
    return rows.groupBy("disease").agg(
        F.avg(F.when(impact > 0, impact)).alias("positive_impact"),
        F.avg(F.when(impact < 0, impact)).alias("negative_impact"),
        F.sum((impact > 0).cast("bigint")).alias("n_positive"),
        F.sum((impact < 0).cast("bigint")).alias("n_negative"),
    )


def tissue_keyword_counts(
    df: DataFrame, keywords: dict[str, list[str]] | None = None, diseases: str = "diseases", rbp_list: str = "rbp_list"
) -> DataFrame:
    """Rows with an RBP whose disease names contain a keyword (by default the stated ones); one count per row and keyword."""
    keywords = TISSUE_KEYWORDS if keywords is None else keywords
    table = F.array(
        *[
            F.struct(F.lit(t).alias("tissue"), F.lit(k).alias("keyword"))
            for t, words in keywords.items()
            for k in words
        ]
    )
    names = F.transform(
        F.split(diseases, r"\|"), lambda d: F.lower(F.trim(F.replace(d, F.lit("_"), F.lit(" "))))
    )
    staged = df.where(F.trim(rbp_list) != "").where(F.col(diseases).isNotNull()).withColumn("_n", names)
    hits = F.filter(
        table, lambda w: F.exists(F.col("_n"), lambda d: F.contains(d, F.lower(w["keyword"])))
    )
    return staged.select(F.inline(hits)).groupBy("tissue", "keyword").agg(
        F.count(F.lit(1)).alias("n_variants")
    )


def variant_rbp_counts(df: DataFrame, by: list[str], variant: str, rbp: str) -> DataFrame:
    """Distinct (variant, RBP base name) pairs per group; the base name ends at the first underscore."""
    return df.groupBy(*by).agg(
        F.countDistinct(F.col(variant), F.substring_index(rbp, "_", 1)).alias("n_variant_rbp")
    )


# ------------------------------------------------------------------ top-k


def topk_other(
    counts: DataFrame, by: list[str], name: str, value: str, k: int = 3, other: str = "Other"
) -> DataFrame:
    """Keep the k largest names per group, sum the rest as ``other``; ties by name.

    Only the k winners are ranked (each task keeps its own k before the shuffle); the
    rest of a group never meets in one task.
    """
    order = W.partitionBy(*by).orderBy(F.desc(value), name)
    winners = (
        counts.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k)
        .select(*by, name, F.lit(True).alias("_top"))
    )
    labelled = counts.join(winners, [*by, name], "left").withColumn(
        name, F.when(F.col("_top"), F.col(name)).otherwise(F.lit(other))
    )
    return labelled.groupBy(*by, name).agg(F.sum(value).alias(value))


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), column)
        .limit(n)
    )


def keep_top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.join(top_categories(df, column, n).select(column), column, "left_semi")


def exclude_top(df: DataFrame, key: str, order: list[Column], n: int = 5) -> DataFrame:
    """Drop the rows whose key is among the first n by ``order``."""
    return df.join(df.orderBy(*order).limit(n).select(key), key, "left_anti")


def top_by_abs_delta(df: DataFrame, k: int, value: str = "delta_score", ties: list[str] = ()) -> DataFrame:
    return df.withColumn("abs_delta", F.abs(value)).orderBy(F.desc("abs_delta"), *ties).limit(k)


# -------------------------------------------------------------- summaries


def score_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, distinct rsids, means, median difference and sign-flip rate."""
    d = SC.delta("alt_score", "ref_score")
    plain = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("alt_score").alias("alt_score_mean"),
        F.avg("ref_score").alias("ref_score_mean"),
        F.avg(d).alias("delta_mean"),
        F.avg(((F.col("alt_score") >= 0) != (F.col("ref_score") >= 0)).cast("double")).alias("sign_flip_rate"),
    )
    # Kept apart from the sums: a distinct aggregate beside them would carry every
    # row through its deduplication.
    distinct = df.groupBy(*by).agg(F.countDistinct("rsid").alias("n_unique_rsid"))
    median = exact_quantiles(df, by, d, {"delta_median": 0.5}).drop("n")
    if by:
        return plain.join(distinct, by).join(median, by)
    return plain.withColumn("n_unique_rsid", distinct.scalar()).withColumn(
        "delta_median", median.scalar()
    )


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sd, min, quartiles, max per column, as one long job."""
    long = unpivot_long(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns)
    stats = long.groupBy("name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return stats.join(quartiles.drop("n"), "name")


def group_box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, median and mean per group."""
    q = exact_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return q.join(mean, by)


def locus_cell_effect(df: DataFrame) -> DataFrame:
    """Mean probability shift per (locus, cell)."""
    return (
        df.select(
            SC.locus("chr", "start_pos", "end_pos").alias("locus"), "cell",
            SC.probability_shift("alt_score", "ref_score").alias("s"),
        )
        .groupBy("locus", "cell")
        .agg(F.avg("s").alias("abs_diff"))
    )


def presence_pattern(effects: DataFrame, cell_order: list[str]) -> DataFrame:
    """Cells per locus as ``A+B`` in the given order, their number, and specific/sharing."""
    order = F.array(*[F.lit(c) for c in cell_order])
    sets = effects.groupBy("locus").agg(F.collect_set("cell").alias("_c"))
    listed = sets.select(
        "locus", F.filter(order, lambda c: F.array_contains(F.col("_c"), c)).alias("cells")
    )
    n = F.size("cells")
    return listed.select(
        "locus", F.array_join("cells", "+").alias("pattern"), n.alias("n_cells"),
        F.when(n == 1, "specific").otherwise("sharing").alias("group"),
    )


def motif_inventory(counts: DataFrame) -> DataFrame:
    """Motif count, ln(n + 1) and number of cells of each RBP's datasets (``rbp``, ``cell``, ``n``)."""
    cells = counts.groupBy("rbp").agg(F.countDistinct("cell").alias("n_cells"))
    return counts.join(cells, "rbp").select(
        "rbp", "cell", "n", F.log1p("n").alias("log_n"), "n_cells"
    )


def shared_rbps(inventory: DataFrame, min_cells: int = 2) -> DataFrame:
    return inventory.where(F.col("n_cells") >= min_cells)


def private_rbps(inventory: DataFrame, split_cell: str, below: int = 2) -> DataFrame:
    """RBPs in fewer than ``below`` cells, marked by presence in one cell line."""
    rows = inventory.where(F.col("n_cells") < below)
    has = rows.groupBy("rbp").agg(F.max((F.col("cell") == split_cell).cast("int")).alias("in_split_cell"))
    return rows.join(has, "rbp")


def order_rows_by_cells(df: DataFrame, cells: list[str], name: str = "rbp", value: str = "n") -> DataFrame:
    """One row per name with a column per cell, sorted by the cells in turn (largest first), then name."""
    wide = df.groupBy(name).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("cell") == c, F.col(value))), F.lit(0)).alias(c)
            for c in cells
        ]
    )
    return wide.orderBy(*[F.desc(c) for c in cells], name)


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Wide table over the given columns, 0 where absent, with ``row_total``."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)
    total = F.lit(0)
    for c in columns:
        total = total + F.col(f"`{c}`")
    return wide.withColumn("row_total", total)


def volcano_table(df: DataFrame, identifier: str, q: str, effect: str) -> DataFrame:
    """Transcripts with their identifier's version stripped (``transcript``) and their ``volcano`` class."""
    rows = df.where(SC.is_transcript(identifier))
    return rows.withColumn("transcript", SC.strip_version(identifier)).withColumn("volcano", SC.volcano_class(q, effect))


def columns_by_total(df: DataFrame, column: str, value: str) -> DataFrame:
    """The values of ``column`` with their totals and their ``place`` by descending total.

    Stays a table: a caller that wants a wide one names the columns it takes.
    """
    totals = df.groupBy(column).agg(F.sum(value).alias("total")).withColumn("_down", -F.col("total"))
    ranked = running_sums(totals.withColumn("_one", F.lit(1)), [], ["_down", column], ["_one"])
    return ranked.select(column, "total", (F.col("_one_before") + 1).alias("place"))


def unpivot_long(df: DataFrame, ids: list[str], columns: list[str], drop_null: bool = True) -> DataFrame:
    long = df.unpivot(ids, columns, "name", "value")
    return long.where(F.col("value").isNotNull()) if drop_null else long


def coerce_and_drop(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric text to doubles; rows with anything else in these columns are dropped."""
    return df.withColumns({c: SC.coerce_numeric(c) for c in columns}).na.drop(subset=columns)


def position_density(
    df: DataFrame, by: list[str], value: str, low: float, high: float, width: float = 1.0
) -> DataFrame:
    """Share of a group's values per fixed-width bin inside [low, high]."""
    v = F.col(value)
    bins = (
        df.where(v.between(low, high))
        .groupBy(*by, F.floor((v - low) / width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = bins.groupBy(*by).agg(F.sum("n").alias("_t"))
    joined = bins.join(total, by) if by else bins.withColumn("_t", total.scalar())
    return joined.select(
        *by, (F.lit(low) + F.col("bin") * width).alias("bin_start"), "n",
        (F.col("n") / (F.col("_t") * F.lit(width))).alias("density"),
    )


def grid_density(df: DataFrame, by: list[str], x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    """Counts of (x, y) per grid cell and the share of the fullest cell of the group."""
    cells = df.groupBy(
        *by, F.floor(F.col(x) / width_x).alias("ix"), F.floor(F.col(y) / width_y).alias("iy")
    ).agg(F.count(F.lit(1)).alias("n"))
    peak = cells.groupBy(*by).agg(F.max("n").alias("_m"))
    joined = cells.join(peak, by) if by else cells.withColumn("_m", peak.scalar())
    return joined.withColumn("ndensity", F.col("n") / F.col("_m")).drop("_m")
