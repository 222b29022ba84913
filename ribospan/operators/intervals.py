"""Shared binding sites between cell lines.

Overlaps are counted, so no pair is ever produced. Starts and ends are points on one axis per (rbp, chrom),
dealt out in ranges and sorted, an end before a start at the same position. A task walks along its range once:

* overlapping pairs: every end adds the starts before it, every start takes off the ends before it;
* whether an interval meets a cell: the largest end among that cell's starts before its own end lies after its start.

What the ranges before add to a range follows from one row of totals per (rbp, chrom) and range. The work is
linear in the intervals however many of them sit on one spot, and a task holds one batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ribospan.functions.scans import group_numbers
from ribospan.session import materialize

_SITE = ["rbp", "chrom"]


def _checked(df: DataFrame, cells: list[str]) -> DataFrame:
    end = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(
        F.raise_error(F.lit("interval end must be after its start"))
    )
    return df.where(F.col("cell").isin(cells)).select(*_SITE, "cell", "start", end.alias("end"))


def _cell_number(cells: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, cells)), F.col("cell")) - 1).cast("int")


def _along_the_axis(points: DataFrame) -> DataFrame:
    """Points in ranges of the axis, an end before the starts at its position."""
    order = [*_SITE, "pos", "is_start"]
    return points.repartitionByRange(*order).sortWithinPartitions(*order)


def _site_runs(batch: pa.RecordBatch):
    """``site, first row, end`` of the runs of one site in a batch sorted by site."""
    groups, which = group_numbers(batch, _SITE)
    cuts = np.flatnonzero(np.diff(which)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(which)], strict=True):
        yield groups[which[a]], a, b


def _earlier() -> W:
    """The ranges of a site before this one."""
    return W.partitionBy(*_SITE).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)


def _range_totals(iv: DataFrame, cells: list[str]) -> DataFrame:
    """A row per site and range: starts ``s<i>`` and ends ``e<i>`` per cell, those of earlier ranges, and the pairs ``l<i>_<j>`` inside it."""
    point = lambda pos, is_start: F.struct(F.col(pos).alias("pos"), F.lit(is_start).alias("is_start"))
    rows = iv.select(*_SITE, _cell_number(cells).alias("c"), F.inline(F.array(point("start", True), point("end", False))))
    points = rows.groupBy(*_SITE, "pos", "is_start", "c").agg(F.count(F.lit(1)).alias("times"))
    n = len(cells)
    kinds = dict(points.dtypes)
    counts = [*[f"s{i}" for i in range(n)], *[f"e{i}" for i in range(n)]]
    inside = [f"l{i}_{j}" for i in range(n) for j in range(n)]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in _SITE), "slice int", *(f"{c} long" for c in (*counts, *inside))])

    def row(site, total, pairs, kind):
        values = [pa.array([v], kind.field(c).type) for c, v in zip(_SITE, site, strict=True)]
        values.append(pa.array([TaskContext.get().partitionId()], pa.int32()))
        return pa.RecordBatch.from_arrays(
            [*values, *(pa.array([x], pa.int64()) for x in (*total.tolist(), *pairs.ravel().tolist()))],
            names=[*_SITE, "slice", *counts, *inside],
        )

    def run(found):
        site, total, pairs, kind = None, np.zeros(2 * n, np.int64), np.zeros((n, n), np.int64), None
        for batch in found:
            if not batch.num_rows:
                continue
            kind = batch.schema
            is_start = batch.column("is_start").to_numpy(zero_copy_only=False)
            at = batch.column("c").to_numpy() + np.where(is_start, 0, n)
            steps = np.zeros((batch.num_rows, 2 * n), np.int64)
            steps[np.arange(len(at)), at] = batch.column("times").to_numpy()
            for key, a, b in _site_runs(batch):
                if key != site:
                    if site is not None:
                        yield row(site, total, pairs, kind)
                    site, total, pairs = key, np.zeros(2 * n, np.int64), np.zeros((n, n), np.int64)
                now = steps[a:b]
                upto = total + np.cumsum(now, axis=0)  # an end is no start, so that its own row adds nothing to the starts before it
                pairs = pairs + now[:, n:].T @ upto[:, :n] - now[:, :n].T @ upto[:, n:]
                total = upto[-1]
        if site is not None:
            yield row(site, total, pairs, kind)

    totals = _along_the_axis(points).mapInArrow(run, schema)
    before = [F.coalesce(F.sum(c).over(_earlier()), F.lit(0)).alias(f"{c}_before") for c in counts]
    return totals.select("*", *before)


def interval_overlap_hits(df: DataFrame, cells: list[str]) -> DataFrame:
    """One row per distinct interval: its multiplicity ``m`` and whether it meets each cell (``hit<i>``)."""
    # Repeated intervals are one row with its multiplicity before anything is compared.
    iv = _checked(df, cells).groupBy(*_SITE, "cell", "start", "end").agg(F.count(F.lit(1)).alias("m"))
    iv = iv.where(" and ".join(f"{c} IS NOT NULL" for c in _SITE))
    point = lambda pos, is_start: F.struct(F.col(pos).alias("pos"), F.lit(is_start).alias("is_start"))
    kept = [*_SITE, "cell", "start", "end", "m"]
    points = iv.select(*kept, _cell_number(cells).alias("c"), F.inline(F.array(point("start", True), point("end", False))))
    n, kinds = len(cells), dict(points.dtypes)
    hits, tops = [f"hit{i}" for i in range(n)], [f"top{i}" for i in range(n)]
    fields = [*(f"`{c}` {kinds[c]}" for c in kept), "slice int", *(f"{c} boolean" for c in hits), *(f"{c} {kinds['end']}" for c in tops)]

    def tops_of(site, top, low, kind):
        values = [pa.array([v], kind.field(c).type) for c, v in zip(_SITE, site, strict=True)]
        values += [pa.nulls(1, kind.field(c).type) for c in ("cell", "start", "end", "m")]
        values.append(pa.array([TaskContext.get().partitionId()], pa.int32()))
        values += [pa.nulls(1, pa.bool_()) for _ in hits]
        values += [pa.array([None if x == low else x], kind.field("end").type) for x in top.tolist()]
        return pa.RecordBatch.from_arrays(values, names=[*kept, "slice", *hits, *tops])

    def run(found):
        site, top, low, kind = None, None, None, None
        for batch in found:
            if not batch.num_rows:
                continue
            kind = batch.schema
            is_start = batch.column("is_start").to_numpy(zero_copy_only=False)
            start, end = batch.column("start").to_numpy(), batch.column("end").to_numpy()
            low = np.iinfo(end.dtype).min if end.dtype.kind == "i" else -np.inf
            ends = np.full((batch.num_rows, n), low, end.dtype)
            ends[is_start, batch.column("c").to_numpy()[is_start]] = end[is_start]
            for key, a, b in _site_runs(batch):
                if key != site:
                    if site is not None:
                        yield tops_of(site, top, low, kind)
                    site, top = key, np.full(n, low, end.dtype)
                np.maximum(ends[a], top, out=ends[a])
                np.maximum.accumulate(ends[a:b], axis=0, out=ends[a:b])
                top = ends[b - 1].copy()
            probes = np.flatnonzero(~is_start)
            own = batch.select(kept).take(pa.array(probes))
            met = ends[probes] > start[probes][:, None]
            slices = pa.array(np.full(len(probes), TaskContext.get().partitionId(), np.int32))
            none = [pa.nulls(len(probes), kind.field("end").type) for _ in tops]
            yield pa.RecordBatch.from_arrays(
                [*own.columns, slices, *(pa.array(np.ascontiguousarray(met[:, i])) for i in range(n)), *none], names=[*kept, "slice", *hits, *tops]
            )
        if site is not None:
            yield tops_of(site, top, low, kind)

    walked = materialize(_along_the_axis(points).mapInArrow(run, ", ".join(fields)))
    earlier = walked.where(F.col("start").isNull()).select(*_SITE, "slice", *[F.max(t).over(_earlier()).alias(t) for t in tops])
    earlier = materialize(earlier)  # a row a site and range, of known size to the join
    probes = walked.where(F.col("start").isNotNull()).drop(*tops).join(earlier, [*_SITE, "slice"])
    meets = [(F.col(h) | F.coalesce(F.col(t) > F.col("start"), F.lit(False))).alias(h) for h, t in zip(hits, tops, strict=True)]
    return probes.select(*kept, *meets)


def interval_overlap_count(df: DataFrame, cells: list[str], mode: str = "raw") -> DataFrame:
    """Shared sites per ordered cell pair i < j, summed over RBPs; pairs without any give 0.

    ``raw`` counts overlapping (a, b) pairs, ``unique`` the a intervals with any overlap.
    """
    pairs = [(i, j) for i in range(len(cells)) for j in range(i + 1, len(cells))]
    if mode == "raw":
        # Summed over all a the two points need no a at all: every end counts what
        # has started, every start takes off what has ended.
        rows = _range_totals(_checked(df, cells), cells)
        shared = lambda i, j: F.sum(F.col(f"l{i}_{j}") + F.col(f"e{i}") * F.col(f"s{j}_before") - F.col(f"s{i}") * F.col(f"e{j}_before"))
    else:
        rows = interval_overlap_hits(df, cells)
        shared = lambda i, j: F.sum(
            F.when((F.col("cell") == cells[i]) & F.col(f"hit{j}"), F.col("m"))
        )
    totals = rows.agg(*[F.coalesce(shared(i, j), F.lit(0)).alias(f"p{i}_{j}") for i, j in pairs])
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{cells[i]}&{cells[j]}").alias("interaction"),
                        F.col(f"p{i}_{j}").cast("bigint").alias("n_shared"),
                    )
                    for i, j in pairs
                ]
            )
        )
    )
