"""Exact-size, seeded, row-order-independent splits.

A record's place is its rank by seeded hash within its class. One class may hold most of a
dataset, so ranks are two-level running counts, and a split needs only the ranks where a part ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ribospan.operators.ordered import _join_on_group, running_sums
from ribospan.session import materialize

#: Hashes are counted in so many ranges, as a power of two.
RANGE_BITS = 12


def shuffled_rank(df: DataFrame, by: list[str], rec_id: str, seed: int) -> DataFrame:
    """Add ``rank0`` and ``group_size``; ``rec_id`` must be unique within a group."""
    keyed = df.withColumn("_h", F.xxhash64(F.lit(seed), rec_id))
    slim = keyed.select(*by, "_h", rec_id).withColumn("_one", F.lit(1))
    ranked = running_sums(slim, by, ["_h", rec_id], ["_one"])
    ranks = ranked.select(
        *by, rec_id, F.col("_one_before").alias("rank0"), F.col("_one_total").alias("group_size")
    )
    extra = [c for c in df.columns if c not in (*by, rec_id)]
    return ranks if not extra else df.join(ranks, [*by, rec_id])


def _by_place(df: DataFrame, by: list[str], rec_id: str, seed: int, shares: dict[str, float], rest: str) -> DataFrame:
    """Add ``split``: ranks as in :func:`shuffled_rank`, the first floor(n * share) of a group get the first name and so on.

    Nothing is sorted: ids are counted by group and range of hashes, and only in the ranges that a part
    ends in are they ranked. A row then needs no more than its group's ends, a few ids.
    """
    if not by:
        return _by_place(df.withColumn("_all", F.lit(0)), ["_all"], rec_id, seed, shares, rest).drop("_all")
    hashed = df.select(*by, rec_id).withColumn("_h", F.xxhash64(F.lit(seed), rec_id)).withColumn("_range", F.shiftright("_h", 64 - RANGE_BITS))
    numbered = lambda rows: rows.groupBy(*by, rec_id, "_h", "_range").agg(F.count(F.lit(1)).alias("_m"))
    sizes = materialize(numbered(hashed).groupBy(*by, "_range").agg(F.sum("_m").alias("_n"), F.max("_m").alias("_most")))

    # The range that each part ends in, and how many rows of the part lie in it.
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select(*by, "_range", "_n", before.alias("_before"), F.sum("_n").over(group).alias("_size"))
    ends, end = [], F.lit(0)
    for share in shares.values():
        end = end + F.floor(F.col("_size") * F.lit(share))
        ends.append(end - F.col("_before"))
    inside = [F.when((e >= 0) & (e < F.col("_n")), F.struct(F.lit(i).alias("i"), e.alias("left"))) for i, e in enumerate(ends)]
    found = F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull()))
    wanted = materialize(placed.select(*by, "_range", found.alias("_end")))

    # The id that each part ends at, and how many of its rows are still in the part.
    near = numbered(_join_on_group(hashed, wanted.select(*by, "_range").distinct(), [*by, "_range"]))
    order = W.partitionBy(*by, "_range").orderBy("_h", rec_id).rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("_before", F.coalesce(F.sum("_m").over(order), F.lit(0)))
    left = F.col("_end.left") - F.col("_before")
    last = _join_on_group(near, wanted, [*by, "_range"]).where((left >= 0) & (left < F.col("_m")))
    at = F.struct(F.col("_h").alias("h"), F.col(rec_id).alias("id"), left.alias("copy"))
    ends_at = [F.max(F.when(F.col("_end.i") == i, at)).alias(f"_end_{i}") for i in range(len(shares))]
    ends_at = materialize(last.groupBy(*by).agg(*ends_at))

    rows = df
    if len(df.columns) == len(by) + 1:
        rows = numbered(hashed).drop("_h", "_range")
        rows = rows.select(*by, rec_id, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).alias("_copy"))
    else:
        for c in (*by, rec_id):
            rows = rows.where(F.col(c).isNotNull())
        if sizes.where("_most > 1").head(1):
            # An id that comes m times has m ranks, and each of its rows takes all of them.
            repeated = materialize(numbered(hashed).where("_m > 1").select(*by, rec_id, "_m"))
            rows = rows.join(repeated, [*by, rec_id], "left")
            copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_m", F.lit(1)) - 1)
            rows = materialize(rows.withColumn("_copy", F.explode(copies)).drop("_m"))
        else:
            rows = rows.withColumn("_copy", F.lit(0).cast("bigint"))
        rows = rows.select(*by, rec_id, *[c for c in df.columns if c not in (*by, rec_id)], "_copy")
    key = F.struct(F.xxhash64(F.lit(seed), rec_id).alias("h"), F.col(rec_id).alias("id"), F.col("_copy").alias("copy"))
    part = F.lit(rest)
    for i, name in reversed(list(enumerate(shares))):
        # A part without an end holds all that is left.
        part = F.when(F.col(f"_end_{i}").isNull() | (key < F.col(f"_end_{i}")), name).otherwise(part)
    joined = _join_on_group(rows, ends_at, by, "left").withColumn("split", part)
    return joined.drop("_copy", *[f"_end_{i}" for i in range(len(shares))])


def stratified_split3(
    df: DataFrame, by: list[str], rec_id: str = "rec_id", seed: int = 42,
    test_frac: float = 0.15, valid_frac: float = 0.15,
) -> DataFrame:
    """Per class: floor(n * test), floor(n * valid), rest train."""
    return _by_place(df, by, rec_id, seed, {"test": test_frac, "valid": valid_frac}, "train")


def stratified_split2(
    df: DataFrame, by: list[str], rec_id: str = "rec_id", seed: int = 42, test_frac: float = 0.2
) -> DataFrame:
    return _by_place(df, by, rec_id, seed, {"test": test_frac}, "train")


def percent_partitions(
    df: DataFrame, by: list[str], cls: str, rec_id: str = "rec_id", seed: int = 42,
    head_pct: int = 100, tail_pct: int = 0, mid_pct: int = 0,
) -> DataFrame:
    """Shuffle each class; the head, the tail and the block before the tail get their names.

    Block sizes are percentages of the smaller class of the same group. A record may
    belong to several blocks when percentages overlap, so the result is one row per
    (record, block).
    """
    ranked = shuffled_rank(df, [*by, cls], rec_id, seed)
    sizes = df.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(
        F.min("_n").alias("_small")
    )
    sizes = materialize(sizes)  # a row a group, of known size to the join
    joined = ranked.join(sizes, by) if by else ranked.withColumn(
        "_small", sizes.select("_small").scalar()
    )
    size = lambda pct: F.floor(F.col("_small") * pct / 100)
    from_end = F.col("group_size") - F.col("rank0")
    tail, mid = size(tail_pct), size(mid_pct)
    blocks = F.filter(
        F.array(
            F.when(F.col("rank0") < size(head_pct), F.lit("head")),
            F.when(from_end <= tail, F.lit("tail")),
            F.when((from_end > tail) & (from_end <= tail + mid), F.lit("middle")),
        ),
        lambda b: b.isNotNull(),
    )
    return joined.withColumn("block", F.explode(blocks)).drop("rank0", "group_size", "_small")
