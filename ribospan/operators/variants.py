"""Variant windows: substitution rules, model lookup, score pairing.

Rows that a rule rejects are kept with a ``reject_reason``; nothing is dropped
silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospan.functions import headers as H
from ribospan.functions import sequence as S
from ribospan.functions.core import char_at, with_once
from ribospan.session import materialize


def _stranded(allele: Column, strand: Column) -> Column:
    """Alleles are complemented on '-'; the window itself is never reversed."""
    return F.when(strand == "-", S.complement(allele)).otherwise(allele)


def _substitute_exact(df: DataFrame, after: bool) -> DataFrame:
    """Shared rule: the reference base must sit at the variant index."""
    p = F.col("parsed")
    staged = df.select(
        "*",
        _stranded(p["ref"], p["strand"]).alias("_ref"),
        _stranded(p["alt"], p["strand"]).alias("_alt"),
        (p["var_pos"] - p["seq_start"]).cast("int").alias("idx0"),
    )
    inside = (F.col("idx0") >= 0) & (F.col("idx0") < F.length("seq"))
    reason = (
        F.when(F.col("parsed").isNull(), "header")
        .when(~inside, "out_of_bounds")
        .when(char_at(F.col("seq"), F.col("idx0") + 1) != F.col("_ref"), "ref_mismatch")
    )
    changed = S.substitute_base("seq", "idx0", "_alt") if after else F.col("seq")
    return (
        staged.withColumn("reject_reason", reason)
        .withColumn("scored_seq", F.when(F.col("reject_reason").isNull(), changed))
        .drop("_ref", "_alt")
    )


def apply_variant_gwas(df: DataFrame, mode: str = "after") -> DataFrame:
    """Strict header, reference check in both modes, substitution only in ``after``."""
    return _substitute_exact(with_once(df, "parsed", H.parse_header_strict("header")), mode == "after")


def apply_variant_ribosnitch(df: DataFrame, mode: str = "after", forced: bool = False) -> DataFrame:
    """Flexible header; in ``before`` mode the window is used as it is, unchecked."""
    pair = with_once(df, "cells", H.cell_pair("header"))
    if mode == "after" or forced:
        out = _substitute_exact(
            with_once(pair, "parsed", H.parse_header_flexible("header")), after=True
        )
    else:
        out = pair.withColumn("reject_reason", F.lit(None).cast("string")).withColumn(
            "scored_seq", F.col("seq")
        )
    no_cells = F.col("cells").isNull()
    return out.withColumn(
        "reject_reason", F.when(no_cells, "cells").otherwise(F.col("reject_reason"))
    ).withColumn("scored_seq", F.when(~no_cells, F.col("scored_seq")))


def locate_variant(
    seq: Column, seq_start: Column, var_pos: Column, ref: Column, alt: Column,
    try_off_by_one: bool = True,
) -> Column:
    """Struct ``(idx0, state)``: first candidate index holding ref or alt, else ``(null, 'none')``."""
    first = (var_pos - seq_start).cast("int")
    candidates = [first, first - 1] if try_off_by_one else [first]
    result = F.when(F.lit(False), F.struct(first.alias("idx0"), F.lit("ref").alias("state")))
    for idx in candidates:
        inside = (idx >= 0) & (idx < F.length(seq))
        base = char_at(seq, idx + 1)
        for allele, state in ((ref, "ref"), (alt, "alt")):
            result = result.when(
                inside & (base == allele), F.struct(idx.alias("idx0"), F.lit(state).alias("state"))
            )
    return result.otherwise(
        F.struct(F.lit(None).cast("int").alias("idx0"), F.lit("none").alias("state"))
    )


def apply_variant_catalog(
    df: DataFrame, mode: str = "after", strict_ref_match: bool = False, try_off_by_one: bool = True
) -> DataFrame:
    """Catalog header; only a window that shows the reference base is substituted."""
    parsed = with_once(df, "parsed", H.parse_header_catalog("header"))
    p = F.col("parsed")
    alt = _stranded(p["alt"], p["strand"])
    located = with_once(
        parsed,
        "found",
        F.when(
            p.isNotNull(),
            locate_variant(
                F.col("seq"), p["seq_start"], p["var_pos"],
                _stranded(p["ref"], p["strand"]), alt, try_off_by_one,
            ),
        ),
    )
    reason = F.when(p.isNull(), "header")
    if strict_ref_match:
        reason = reason.when(F.col("found.state") == "none", "ref_mismatch")
    changed = (
        F.when(
            F.col("found.state") == "ref", S.substitute_base("seq", F.col("found.idx0"), alt)
        ).otherwise(F.col("seq"))
        if mode == "after"
        else F.col("seq")
    )
    return located.withColumn("reject_reason", reason).withColumn(
        "scored_seq", F.when(F.col("reject_reason").isNull(), changed)
    )


def record_model_expand(records: DataFrame, models: DataFrame) -> DataFrame:
    """Each record once per model whose cell is one of the record's two cells.

    A record with no such model drops out. ``models`` has ``model_id``; its cell is
    everything after any underscore, as names are matched by suffix.
    """
    cells = records.withColumn("_cell", F.explode(F.array_distinct(F.array("cells.cell1", "cells.cell2"))))
    parts = F.split("model_id", "_")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"),
    )
    # A row a model and suffix, stored: the join knows its size, so a few popular cells need not gather anywhere.
    by_cell = materialize(models.where(F.contains("model_id", F.lit("_"))).withColumn("_cell", F.explode(suffixes)))
    joined = cells.join(by_cell, "_cell")
    # A name can end in both cells; it is taken once, through the first.
    through_first = F.col("_cell") == F.col("cells.cell1")
    ends_in_first = F.col("model_id").endswith(F.concat(F.lit("_"), F.col("cells.cell1")))
    return joined.where(through_first | ~ends_in_first).drop("_cell")


def model_lookup(records: DataFrame, models: DataFrame) -> DataFrame:
    """Records joined to their model; a missing model skips the record."""
    return records.join(models, "model_id")


def skipped_models(records: DataFrame, models: DataFrame) -> DataFrame:
    """How many records ask for each model that does not exist."""
    return (
        records.join(models, "model_id", "left_anti")
        .groupBy("model_id")
        .agg(F.count(F.lit(1)).alias("n_skipped"))
    )


def pair_before_after(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Before and after scores matched on keys, never on line numbers."""
    return after.withColumnRenamed("score", "alt_score").join(
        before.select(*keys, F.col("score").alias("ref_score")), keys
    )


def semi_filter_after(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """After rows whose key also occurs in the (gated) before rows."""
    return after.join(before.select(*keys), keys, "left_semi")
