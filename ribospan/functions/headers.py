"""Header parsing as Column expressions. A header that does not parse gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospan.functions.core import col, let

# Header patterns.
REGION_START = r":(\d+)-"
STRAND = r"\(([^)]*)\)"
SNV_FLEXIBLE = r"(?i)^\d+:[ACGT]>[ACGT]$"
SNV_CATALOG = r"^\d+:[ACGTN]>[ACGTN]$"
REGION_CATALOG = r"^(chr[^:]+):(\d+)-(\d+)\(([+-])\)"
SCORE_LINE = (
    r"variant_\d+ chr([^:]+):(\d+)-(\d+)\(([+-])\)\[([^\]]+)\]\{([^\}]*)\} "
    r"(\d+):([ACGT])>([ACGT]) (ENSG\d+)\[([-+eE0-9.]+)\]\{([^\}]+)\}"
)
SCORE_MARK = "Prediction_score:"


def tokens(header: str | Column) -> Column:
    """Whitespace tokens of a header, without its leading ``>``."""
    return F.split(F.trim(F.regexp_replace(col(header), "^>+", "")), r"\s+")


def _first(array: Column, test) -> Column:
    return F.try_element_at(F.filter(array, test), F.lit(1))


def _parts(region: Column, snv: Column) -> Column:
    """Struct of the five coordinates the substitution rules need."""
    allele = F.substring_index(snv, ":", -1)
    return F.struct(
        F.substring_index(snv, ":", 1).try_cast("bigint").alias("var_pos"),
        F.substring_index(allele, ">", 1).alias("ref"),
        F.substring_index(allele, ">", -1).alias("alt"),
        F.regexp_extract(region, STRAND, 1).alias("strand"),
        F.regexp_extract(region, REGION_START, 1).try_cast("bigint").alias("seq_start"),
    )


def _complete(parts: Column) -> Column:
    ok = parts["var_pos"].isNotNull() & parts["seq_start"].isNotNull() & (parts["strand"] != "")
    return F.when(ok, parts)


def parse_header_strict(header: str | Column) -> Column:
    """Second token is the region, second-to-last the SNV; fewer than three tokens is null."""
    return let(
        tokens(header),
        lambda t: F.when(
            F.size(t) >= 3,
            let(
                _parts(F.try_element_at(t, F.lit(2)), F.try_element_at(t, F.lit(-2))), _complete
            ),
        ),
    )


def parse_header_flexible(header: str | Column) -> Column:
    """First token with ``: - ( )`` is the region, first ``POS:REF>ALT`` token the SNV.

    The SNV pattern ignores case; alleles are returned as written.
    """
    def region(x: Column) -> Column:
        return (
            F.contains(x, F.lit(":")) & F.contains(x, F.lit("-"))
            & F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))
        )

    return let(
        tokens(header),
        lambda t: F.when(
            F.size(t) >= 3,
            let(
                F.struct(
                    _first(t, region).alias("r"),
                    _first(t, lambda x: x.rlike(SNV_FLEXIBLE)).alias("v"),
                ),
                lambda p: F.when(
                    p["r"].isNotNull() & p["v"].isNotNull(), let(_parts(p["r"], p["v"]), _complete)
                ),
            ),
        ),
    )


def parse_protein_cell(t: Column) -> Column:
    """Protein and cell around the last token ``in``, else from fixed places at the end."""
    n = F.size(t)
    back = F.array_position(F.reverse(t), "in").cast("int")
    at = F.when(back > 0, n - back + 1)
    cell = F.coalesce(
        F.when(at + 1 <= n, F.try_element_at(t, at + 1)), F.try_element_at(t, F.lit(-1))
    )
    protein = F.coalesce(
        F.when(at > 1, F.try_element_at(t, at - 1)),
        F.when(n >= 3, F.try_element_at(t, F.lit(-3))),
        F.when(n == 2, F.try_element_at(t, F.lit(-2))),
    )
    return F.struct(protein.alias("protein"), cell.alias("cell_line"))


def parse_header_catalog(header: str | Column) -> Column:
    """Catalog header: region, SNV over ACGTN, protein and cell line; null when no part matches."""
    def loose(x: Column) -> Column:
        return (
            x.startswith("chr") & F.contains(x, F.lit(":"))
            & F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))
        )

    def build(t: Column) -> Column:
        return let(
            F.struct(
                F.coalesce(
                    _first(t, loose), _first(t, lambda x: x.rlike(REGION_CATALOG))
                ).alias("r"),
                _first(t, lambda x: x.rlike(SNV_CATALOG)).alias("v"),
                parse_protein_cell(t).alias("pc"),
            ),
            lambda p: F.when(
                p["r"].rlike(REGION_CATALOG) & p["v"].isNotNull(),
                F.struct(
                    F.regexp_extract(p["r"], REGION_CATALOG, 1).alias("chrom"),
                    F.regexp_extract(p["r"], REGION_CATALOG, 2).cast("bigint").alias("seq_start"),
                    F.regexp_extract(p["r"], REGION_CATALOG, 3).cast("bigint").alias("seq_end"),
                    F.regexp_extract(p["r"], REGION_CATALOG, 4).alias("strand"),
                    F.substring_index(p["v"], ":", 1).cast("bigint").alias("var_pos"),
                    F.substring_index(F.substring_index(p["v"], ":", -1), ">", 1).alias("ref"),
                    F.substring_index(p["v"], ">", -1).alias("alt"),
                    p["pc"]["protein"].alias("protein"),
                    p["pc"]["cell_line"].alias("cell_line"),
                ),
            ),
        )

    return let(F.split(F.trim(F.regexp_replace(col(header), "^>+", "")), r"\s+"), build)


def cell_pair(header: str | Column) -> Column:
    """Last two tokens of a header as ``cell1`` and ``cell2``; null below two tokens."""
    return let(
        tokens(header),
        lambda t: F.when(
            F.size(t) >= 2,
            F.struct(
                F.try_element_at(t, F.lit(-2)).alias("cell1"),
                F.try_element_at(t, F.lit(-1)).alias("cell2"),
            ),
        ),
    )


def parse_score_line(line: str | Column, strict: bool = True) -> Column:
    """Scored variant header plus trailing score; strict fails on a line that does not match."""
    text = col(line)
    group = lambda i: F.regexp_extract(text, SCORE_LINE, i)
    parsed = F.struct(
        group(12).alias("rsid"),
        group(11).try_cast("double").alias("maf"),
        F.trim(F.substring_index(text, SCORE_MARK, -1)).try_cast("double").alias("score"),
        group(5).alias("region"),
        group(6).alias("clin_sig"),
        group(10).alias("gene"),
        F.concat(F.lit("chr"), group(1)).alias("chr"),
        group(2).try_cast("bigint").alias("start_pos"),
        group(3).try_cast("bigint").alias("end_pos"),
        group(4).alias("strand"),
        F.regexp_replace(F.substring_index(text, SCORE_MARK, 1), r"\s+$", "").alias("header"),
    )
    ok = text.rlike(SCORE_LINE) & F.contains(text, F.lit(SCORE_MARK))
    if strict:
        return F.when(ok, parsed).otherwise(
            F.raise_error(F.concat(F.lit("score line does not match: "), text))
        )
    return F.when(ok, parsed)


def split_dataset(name: str | Column) -> Column:
    """``<RBP>_<CELL>`` split at the first underscore."""
    return let(
        F.split(col(name), "_", 2),
        lambda p: F.struct(
            F.try_element_at(p, F.lit(1)).alias("rbp"), F.try_element_at(p, F.lit(2)).alias("cell")
        ),
    )
