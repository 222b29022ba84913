"""Scalar rules on score tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospan.functions.constants import INVALID_DISEASES
from ribospan.functions.core import col, sigmoid


def transfer_model_name(name: str | Column) -> Column:
    """Model of the other cell line; every occurrence of the suffix is replaced, null if none fits."""
    c = col(name)
    rule = F.when(F.lit(False), c)
    # Cell-line suffixes, tested in this order.
    for cell in ["K562", "HEK293", "HEK293T", "Hela", "H9"]:
        rule = rule.when(c.endswith(cell), F.replace(c, F.lit(cell), F.lit("HepG2")))
    return rule.when(c.endswith("HepG2"), F.replace(c, F.lit("HepG2"), F.lit("K562")))


def delta(alt: str | Column, ref: str | Column) -> Column:
    return col(alt) - col(ref)


def probability_shift(alt: str | Column, ref: str | Column) -> Column:
    return F.abs(sigmoid(alt) - sigmoid(ref))


def locus(chrom: str | Column, start: str | Column, end: str | Column) -> Column:
    return F.concat_ws(":", col(chrom), col(start), col(end))


def pair_difference(before: str | Column, after: str | Column) -> dict[str, Column]:
    """Absolute, squared and relative difference; the denominator keeps its sign, 1/0 is blank."""
    b, a = col(before), col(after)
    gap = F.abs(b - a)
    return {
        "abs_diff": gap,
        "squared_diff": (b - a) * (b - a),
        "relative_diff": F.when(b != 0, gap / b),
    }


def clinical_class(text: str | Column) -> Column:
    """Benign wins over Pathogenic; neither is null."""
    c = col(text)
    return F.when(
        F.contains(c, F.lit("Benign")) | F.contains(c, F.lit("benign")), "Benign"
    ).when(
        F.contains(c, F.lit("Pathogenic")) | F.contains(c, F.lit("probably_damaging")),
        "Pathogenic",
    )


def maf_bucket(maf: str | Column, low: float = 0.001, high: float = 0.05) -> Column:
    m = col(maf)
    return (
        F.when(m.isNull(), F.lit(None))
        .when(m < low, f"<{low}")
        .when(m > high, f">{high}")
        .otherwise(f"{low}-{high}")
    )


def region_class(region: str | Column, rules: dict[str, str]) -> Column:
    """Class of the first substring found; null when none is."""
    c = col(region)
    rule = F.when(F.lit(False), F.lit(""))
    for part, name in rules.items():
        rule = rule.when(F.contains(c, F.lit(part)), name)
    return rule


def ld_bin(r2: str | Column, breaks: tuple[float, ...] = (0, 0.2, 0.4, 0.6, 0.8, 1)) -> Column:
    """Right-closed bins labelled by their upper end; the lowest break itself is null."""
    c = col(r2)
    rule = F.when(c.isNull() | (c <= breaks[0]), F.lit(None).cast("string"))
    for upper in breaks[1:]:
        rule = rule.when(c <= upper, f"{upper:g}")
    return rule


def neg_log10_p(p: str | Column, missing_as_one: bool = False) -> Column:
    c = col(p)
    return -F.log10(F.coalesce(c, F.lit(1.0)) if missing_as_one else c)


def volcano_class(q: str | Column, b: str | Column) -> Column:
    """Significance and direction of an effect; anything not decided is not significant."""
    significant = col(q) < 0.05
    return (
        F.when(significant & (col(b) > 1), "Up-regulated")
        .when(significant & (col(b) < -1), "Down-regulated")
        .otherwise("Not significant")
    )


def strip_version(identifier: str | Column) -> Column:
    return F.substring_index(col(identifier), ".", 1)


def is_transcript(identifier: str | Column) -> Column:
    """Ensembl transcripts; other identifiers (genes, spike-ins) are not."""
    return col(identifier).rlike(r"^ENST\d")


def significance_stars(p: str | Column) -> Column:
    c = col(p)
    return (
        F.when(c.isNull() | F.isnan(c), "NA")
        .when(c < 0.001, "***")
        .when(c < 0.01, "**")
        .when(c < 0.05, "*")
        .otherwise("ns")
    )


def normalize_disease(
    name: str | Column, exclude: list[str] | None = None, merge: dict[str, str] | None = None
) -> Column:
    """Null for excluded labels (by default those that name no disease), the merged label where one is given."""
    c, exclude = col(name), INVALID_DISEASES if exclude is None else exclude
    rule = F.when(c.isin(exclude), F.lit(None).cast("string")) if exclude else F.when(F.lit(False), c)
    for old, new in (merge or {}).items():
        rule = rule.when(c == old, new)
    return rule.otherwise(c)


def readable_name(name: str | Column) -> Column:
    return F.trim(F.replace(col(name), F.lit("_"), F.lit(" ")))


def dynamic_score(dynamic: str | Column, common: str | Column, alpha: float = 0.5) -> Column:
    product = col(dynamic).cast("double") * col(common)
    return F.log1p(col(dynamic) + F.lit(alpha) * (product + 1))


def score_gate(score: str | Column, inclusive: bool = False) -> Column:
    return col(score) >= 0 if inclusive else col(score) > 0


def coerce_numeric(value: str | Column) -> Column:
    """Double, or null where the text is not a number."""
    return F.trim(col(value).cast("string")).try_cast("double")


def comma_decimal(value: str | Column) -> Column:
    return F.replace(F.trim(col(value)), F.lit(","), F.lit(".")).try_cast("double")
