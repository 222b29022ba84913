"""Order-dependent sums over groups of any size.

A window ``partitionBy(group)`` puts a whole group into one task. Ranks,
cumulative counts, exact quantiles and ROC points are needed for groups that may
hold a third of the data, so every running total here is two-level:

1. a few hundred *cut points* are taken from the data (the keys whose hash is below
   a threshold that follows the number of rows, so about as many rows as cuts leave
   the scan in all, and the choice depends on the data only and is the same wherever
   the plan is evaluated again);
2. each row gets the slice between two cuts, and the plain window runs inside
   ``(group, slice)``;
3. per-slice totals, at most one row per group plus one per cut, are accumulated
   in slice order and joined back.

Inputs are pre-aggregated to one row per (group, order key), so a value that
repeats a billion times is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _fanout(df: DataFrame) -> int:
    """Cuts per tier; tier squared slices, about four per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, min(128, math.ceil(math.sqrt(4 * partitions))))


def with_slice(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "_slice"
) -> DataFrame:
    """Add an order-preserving slice number; rows must be unique on (group, order)."""
    tier = _fanout(df)
    n_cuts = tier * tier - 1
    keys = [*group, *order]
    # Hashing every column keeps them all in these branches, so the shuffle below
    # is the same plan as in the main branch and is reused, not run again.
    every = F.xxhash64(*df.columns).isNotNull()
    size = df.agg(F.count(F.when(every, 1)).alias("n")).select(F.greatest("n", F.lit(1)))
    below = F.lit(float(n_cuts) * 2**31) / size.scalar()
    cuts = df.where(every & (F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) < below)).agg(
        F.sort_array(F.collect_list(F.struct(*keys))).alias("cuts")
    )
    staged = df.withColumn("_cuts", cuts.scalar()).withColumn("_key", F.struct(*keys)).withColumn(name, F.lit(0))
    # The number of cuts up to the key, by halves; chance may leave more cuts than asked for, and any
    # beyond the last step only make the last slice longer.
    for bit in reversed(range(n_cuts.bit_length() + 1)):
        ahead = F.get("_cuts", F.col(name) + ((1 << bit) - 1)) <= F.col("_key")
        staged = staged.withColumn(name, F.col(name) + F.when(ahead, 1 << bit).otherwise(0))
    return staged.drop("_cuts", "_key")


def running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Add ``<c>_before`` (sum over earlier keys of the group) and ``<c>_total`` for each column.

    ``df`` has one row per (group, order). Order is ascending; negate a numeric
    column for a descending one.
    """
    sliced = with_slice(df, group, order)
    by_slice = sliced.groupBy(*group, "_slice").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    over_group = W.partitionBy(*(group or [F.lit(0)]))
    earlier = over_group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = by_slice.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(over_group).alias(f"{c}_total") for c in sums],
    )
    inside = (
        W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    local = sliced.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in sums]
    )
    out = _join_on_group(local, totals, [*group, "_slice"])
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
    )


def suffix_min(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add the minimum of ``value`` over this and all later keys of the group."""
    sliced = with_slice(df, group, order)
    # Read backwards, so that both frames only ever grow.
    later = (
        W.partitionBy(*(group or [F.lit(0)]))
        .orderBy(F.desc("_slice"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    rest = (
        sliced.groupBy(*group, "_slice")
        .agg(F.min(value).alias("_m"))
        .select(*group, "_slice", F.min("_m").over(later).alias("_rest"))
    )
    inside = (
        W.partitionBy(*group, "_slice")
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(W.unboundedPreceding, 0)
    )
    local = sliced.select("*", F.min(value).over(inside).alias("_local"))
    joined = _join_on_group(local, rest, [*group, "_slice"])
    return joined.select(*df.columns, F.least("_local", "_rest").alias(out))


def _join_on_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that also matches null group keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(
    df: DataFrame, group: Sequence[str], value: str | Column, name: str = "value"
) -> DataFrame:
    """One row per (group, value) with its count ``n``; nulls in ``value`` are dropped."""
    col = F.col(value) if isinstance(value, str) else value
    return (
        df.select(*group, col.alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(*group, name)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def average_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per (group, value): count ``n``, average rank ``avg_rank`` and group size ``n_total``."""
    counts = value_counts(df, group, value, value)
    ranked = running_sums(counts, group, [value], ["n"])
    return ranked.select(
        *group,
        value,
        "n",
        (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"),
        "n_total",
    )


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str | Column, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated (R type 7) quantiles per group, one column per entry of ``probs``.

    Equal to the built-in exact ``percentile`` without holding a group's values in
    one aggregation buffer.
    """
    counts = value_counts(df, group, value)
    ranked = running_sums(counts, group, ["value"], ["n"])
    last = F.col("n_before") + F.col("n") - 1
    picks = []
    for name, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("n_before") <= pos) & (pos <= last)
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"_{name}_{side}"))
    agg = ranked.groupBy(*group).agg(F.max("n_total").alias("_n"), *picks)
    outs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return agg.select(*group, *outs, F.col("_n").alias("n"))
