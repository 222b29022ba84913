"""Aggregates that a caller brings: column expressions, or functions over Arrow tables with partial results."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the value column to an aggregate, as ``lambda v: F.median(v)``.
StatFun = Callable[[Column], Column]


def summarise(
    df: DataFrame, by: list[str], value: str, stats: dict[str, StatFun], value_filter: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``by`` and one column for each of ``stats``, over the values that pass ``value_filter``.

    The filter gets the value column and may name others of ``df``. Groups of which no value passes are kept, with the aggregate of nothing.
    """
    v = F.col(value)
    chosen = F.when(value_filter(v), v) if value_filter else v
    staged = df.select(*by, chosen.alias("_value"))
    return staged.groupBy(*by).agg(*[fn(F.col("_value")).alias(name) for name, fn in stats.items()])


def summarise_arrow(
    df: DataFrame, by: list[str], partial: Callable[[pa.Table], dict], combine: Callable[[pa.Table], dict],
    partial_schema: str, schema: str, share_rows: int = 200_000,
) -> DataFrame:
    """A caller's functions over Arrow tables, a group of any size.

    ``partial`` takes about ``share_rows`` rows of a group at most and returns one row (a dict of the columns of
    ``partial_schema``); ``combine`` takes the group's partial rows and returns one row of ``schema``.
    The rows of a group are shared out by a hash of all their columns.
    """
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / share_rows).alias("_shares"))
    everything = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    shared = df.withColumn("_h", everything).join(sizes, by).withColumn("_share", F.pmod("_h", F.col("_shares"))).drop("_h", "_shares")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)

    def one_row(fn, keys):
        def run(table: pa.Table) -> pa.Table:
            row = fn(table)
            return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in by), *(pa.array([row[c]]) for c in keys)], names=[*by, *keys])

        return run

    names = lambda text: [c.split()[0] for c in text.split(",")]
    parts = shared.groupBy(*by, "_share").applyInArrow(one_row(partial, names(partial_schema)), f"{kinds}, {partial_schema}")
    return parts.groupBy(*by).applyInArrow(one_row(combine, names(schema)), f"{kinds}, {schema}")
