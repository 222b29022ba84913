"""Secondary-structure annotation and per-position profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospan.functions.core import col, let
from ribospan.functions.special import dot_bracket_states


def annotate_structure(df: DataFrame, structure: str = "structure") -> DataFrame:
    """Add ``states``, the seven-state string (L R H B T M E) of a balanced dot-bracket string.

    * no bracket on one side, or unpaired outside all pairs: E
    * ``( . )``: H;  ``) . (`` inside a pair: M
    * ``( . (`` and ``) . )``: B when the partners are adjacent; otherwise an inner loop,
      which is M when the branch it leads to is followed (or preceded) by another
      branch, else T.

    A record needs nothing but its own string, so no row leaves its partition: one row per
    character and windows over records would shuffle some fifty bytes for every letter.
    """
    return df.withColumn("states", dot_bracket_states(structure))


def paired_probability(
    external: DataFrame, hairpin: DataFrame, inner: DataFrame, multi: DataFrame,
    key: str = "rec_id", profile: str = "profile",
) -> DataFrame:
    """Join the four loop profiles of a record and add the paired one, 1 - E - H - I - M.

    Long output ``(key, structure_type, profile)`` in the order paired, hairpin, inner,
    multi, external.
    """
    joined = external.select(key, F.col(profile).alias("e"))
    for df, name in ((hairpin, "h"), (inner, "i"), (multi, "m")):
        joined = joined.join(df.select(key, F.col(profile).alias(name)), key)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    ones = F.transform("e", lambda x: F.lit(1.0) - x)
    paired = minus(minus(minus(ones, F.col("h")), F.col("i")), F.col("m"))
    rows = [("paired", paired)] + [
        (n, F.col(c)) for n, c in (("hairpin", "h"), ("inner", "i"), ("multi", "m"), ("external", "e"))
    ]
    return joined.select(
        key,
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("structure_type"), c.alias("profile")) for n, c in rows])
        ),
    )


def mean_profile(df: DataFrame, by: list[str], profile: str = "profile", centre: int | None = None) -> DataFrame:
    """Mean per position, ignoring NaN; ``centre`` relabels positions relative to it."""
    cells = df.select(*by, F.posexplode(profile).alias("pos", "v"))
    if centre is not None:
        cells = cells.withColumn("pos", F.col("pos") - centre)
    value = F.col("v").cast("double")
    return cells.groupBy(*by, "pos").agg(
        F.avg(F.when(~F.isnan(value), value)).alias("mean_value")
    )


def zscore_row(values: str | Column) -> Column:
    """Centre and scale an array by its own mean and population deviation (at least 1e-12)."""
    def scale(v: Column) -> Column:
        n = F.size(v)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n

        def around(mu: Column) -> Column:
            sd = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)) / n)
            return let(
                F.greatest(sd, F.lit(1e-12)), lambda d: F.transform(v, lambda x: (x - mu) / d)
            )

        return let(mean, around)

    return let(col(values), scale)
