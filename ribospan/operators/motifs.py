"""Motif operators: regions, containment, enrichment inputs, PWMs, scanning, similarity, merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ribospan.functions import sequence as S
from ribospan.functions.core import char_at, let, positions
from ribospan.functions.scans import (
    Automaton, best_offsets, code_points, first_words, group_numbers, spelled_numbers, spelled_texts, stacked_top_sums, word_totals,
)
from ribospan.functions.special import true_runs
from ribospan.session import materialize

SHARES = 32  # of the records of a group
MOST_HELD = 1 << 22  # sums in a task

# ---------------------------------------------------------------- regions


def true_regions(mask: str | Column, min_len: int = 5) -> Column:
    """Maximal runs of true in a boolean array as half-open ``(start, end)`` structs."""
    def runs(m: Column) -> Column:
        n = F.size(m)
        on = lambda i: F.element_at(m, i)
        starts = F.filter(
            positions(n), lambda i: on(i) & ((i == 1) | ~on(F.greatest(i - 1, F.lit(1))))
        )
        ends = F.filter(positions(n), lambda i: on(i) & ((i == n) | ~on(F.least(i + 1, n))))
        spans = F.zip_with(
            starts, ends, lambda s, e: F.struct((s - 1).alias("start"), e.alias("end"))
        )
        return F.filter(spans, lambda r: r["end"] - r["start"] >= min_len)

    return let(mask, runs)


def high_score_mask(scores: str | Column) -> Column:
    """Positions above both the mean and the minimum of their record."""
    return let(
        scores,
        lambda v: let(
            F.struct(
                (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).alias("mean"),
                F.array_min(v).alias("low"),
            ),
            lambda t: F.transform(v, lambda x: (x > t["mean"]) & (x > t["low"])),
        ),
    )


def high_score_regions(
    df: DataFrame, keys: list[str], scores: str = "scores", min_len: int = 5,
    condition=None, offset: int = 0,
) -> DataFrame:
    """Runs of high scores per record: ``(keys, start, end)``, half-open, 0-based.

    ``condition`` maps the score array to a boolean array; the default is above the
    record's mean. ``offset`` drops that many leading scores (special tokens). The runs
    of a batch of records, those of :func:`true_regions`, are found together.
    """
    values = F.col(scores)
    if offset:
        values = F.slice(values, offset + 1, F.greatest(F.size(values) - offset, F.lit(0)))
    mask = (condition or high_score_mask)(values)
    rows = df.select(*keys, mask.alias("_mask"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "start int, end int"

    def run(found):
        for batch in found:
            record, start, end = true_runs(batch.column("_mask"), min_len)
            own = batch.select(keys).take(pa.array(record))
            spans = [pa.array(x.astype(np.int32)) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([*own.columns, *spans], names=[*keys, "start", "end"])

    return rows.mapInArrow(run, schema)


def region_instances(df: DataFrame, keys: list[str], scores: str = "scores", **kwargs) -> DataFrame:
    """High-score regions with the subsequence they cover as ``motif``."""
    cut = df.withColumn("_s", F.slice(F.col(scores), F.lit(1 + kwargs.pop("offset", 0)), F.length("seq")))
    spans = high_score_regions(cut, [*keys, "seq"], "_s", **kwargs)
    return spans.withColumn(
        "motif", F.substr("seq", F.col("start") + 1, F.col("end") - F.col("start"))
    )


def centered_window(start: Column, end: Column, width: int) -> Column:
    """Struct ``(start, end)`` of ``width`` around a span; a longer span is cropped."""
    extra = F.lit(width) - (end - start)
    left = F.floor(extra / F.lit(2.0)).cast("int")
    return F.struct((start - left).alias("start"), (end + extra - left).alias("end"))


def extract_windows(instances: DataFrame, width: int = 24) -> DataFrame:
    """Re-centre instances to ``width`` and keep those inside their sequence."""
    moved = instances.withColumn("_w", centered_window(F.col("start"), F.col("end"), width))
    inside = (
        (F.col("_w.start") >= 0)
        & (F.col("_w.start") < F.col("_w.end"))
        & (F.col("_w.end") <= F.length("seq"))
    )
    keep = [c for c in instances.columns if c not in ("start", "end", "seq")]
    return moved.where(inside).select(
        *keep,
        F.col("_w.start").alias("start"),
        F.col("_w.end").alias("end"),
        F.substr("seq", F.col("_w.start") + 1, F.lit(width)).alias("window"),
    )


# ------------------------------------------------------------ containment


def dealt_groups(
    records: DataFrame, small: DataFrame, on: list[str], weight: Column, part_weight: int, group_rows: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with ``_part`` and ``_salt``, and the keys under which they meet.

    The rows of ``small`` of a group are cut into parts of about ``part_weight``, its records into
    ``group_rows``; every part meets all salts. However many rows a group has, one task's work is bounded.
    """
    parts = small.groupBy(*on).agg(F.ceil(F.sum(weight) / part_weight).alias("_parts"))
    salts = records.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("_salts"))
    plan = parts.join(salts, on, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    plan = materialize(plan.withColumn("_parts", F.greatest("_parts", F.lit(1))))  # a row a group
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    share = lambda df, n: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(n))
    left = records.withColumn("_share", F.xxhash64(*[F.col(f"`{c}`") for c in records.columns])).join(plan, on)
    left = left.withColumn("_salt", F.pmod("_share", "_salts")).withColumn("_part", every("_parts")).drop("_share", "_parts", "_salts")
    right = small.join(plan, on).withColumn("_part", share(small, "_parts")).withColumn("_salt", every("_salts"))
    return left, right.drop("_parts", "_salts"), [*on, "_part", "_salt"]


def motif_containment(
    records: DataFrame, motifs: DataFrame, by: list[str], allow_multi: bool = False,
    part_chars: int = 2_000_000, group_rows: int = 100_000,
) -> DataFrame:
    """``n_with`` and ``n_pos_with``: records (or places) containing each motif, zero included.

    The motifs of a group become one automaton, and its records go through it once, many at a
    time: nothing leaves the scan per position, and only counts leave the task. ``motifs`` has
    ``by`` and ``motif``; a group with more than ``part_chars`` letters of motifs has several
    automata, one with more than ``group_rows`` records several tasks.
    """
    wanted = motifs.where(F.length("motif") > 0).select(*by, "motif").distinct()
    rows = records.select(*by, F.coalesce(F.col("label") == 1, F.lit(False)).alias("marked"), F.encode("seq", "UTF-8").alias("text"))
    left, right, keys = dealt_groups(rows, wanted, by, F.octet_length("motif"), part_chars, group_rows)
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*by, "motif"]) + ", n_with long, n_pos_with long"

    def count(texts: pa.Table, words: pa.Table) -> pa.Table:
        names = words.column("motif").to_pylist()
        n = np.zeros((2, len(names)), np.int64)
        if names and texts.num_rows:
            known = texts.filter(pc.is_valid(texts.column("text")))
            marked = known.column("marked").to_numpy()
            n = np.stack(Automaton([w.encode() for w in names]).counts(known.column("text").to_pylist(), marked, allow_multi))
        first = words.num_rows > 0 and words.column("_salt")[0].as_py() == 0
        keep = pa.array((n[0] > 0) | first)
        out = words.select([*by, "motif"]).append_column("n_with", pa.array(n[0])).append_column("n_pos_with", pa.array(n[1]))
        return out.filter(keep)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(count, schema)
    counts = found.groupBy(*by, "motif").agg(F.sum("n_with").alias("n_with"), F.sum("n_pos_with").alias("n_pos_with"))
    return counts.select(*by, "motif", "n_with", "n_pos_with")


def with_population(counts: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Add ``total`` and ``positives`` of the group to containment counts."""
    sizes = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("positives"),
    )
    return counts.join(sizes, by)


# ------------------------------------------------------------------ PWMs


def symbol_frequencies(
    instances: DataFrame, by: list[str], text: str, alphabet: str, dna_to_rna: bool = False, weight: str | None = None
) -> DataFrame:
    """Share of each symbol per position over the motif's instances, zeros filled in.

    Symbols outside ``alphabet`` count in the denominator only. Equal instances are added up (their
    number, or ``weight``) before they are taken apart. All four (or seven)
    shares of a position come out of one aggregate row, so the zero fill needs no join.
    """
    seq = F.translate(text, "T", "U") if dna_to_rna else F.col(text)
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    different = materialize(instances.groupBy(*by, seq.alias("_text")).agg(many.alias("_w")))
    cells = different.select(*by, "_w", F.posexplode(S.kmers("_text", 1)).alias("pos", "symbol"))
    counts = cells.groupBy(*by, "pos").agg(
        *[F.sum(F.when(F.col("symbol") == a, F.col("_w")).otherwise(F.lit(0))).alias(f"_n{j}") for j, a in enumerate(alphabet)],
    )
    totals = different.groupBy(*by).agg(F.sum("_w").alias("_n"))
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("symbol"), (F.col(f"_n{j}") / F.col("_n")).alias("p"))
            for j, a in enumerate(alphabet)
        ]
    )
    return counts.join(totals, by).select(*by, "pos", F.inline(rows))


def pwm_from_instances(instances: DataFrame, by: list[str], text: str = "seq") -> DataFrame:
    """``(by, pos, symbol, p)`` over A, C, G, U."""
    return symbol_frequencies(instances, by, text, S.RNA, dna_to_rna=True)


def seq_struct_pwm(
    seq_instances: DataFrame, struct_instances: DataFrame, by: list[str],
    seq: str = "seq", states: str = "states", weight: str | None = None,
) -> DataFrame:
    """Four base rows and seven state rows, each over its own number of instances (the sum of ``weight``, if given)."""
    bases = symbol_frequencies(seq_instances, by, seq, S.RNA, dna_to_rna=True, weight=weight)
    return bases.withColumn("part", F.lit("seq")).unionByName(
        symbol_frequencies(struct_instances, by, states, S.PWM_STATE_ORDER, weight=weight).withColumn(
            "part", F.lit("struct")
        )
    )


def pwm_entropy(pwm: DataFrame, by: list[str]) -> DataFrame:
    """Total Shannon bits over the non-zero cells of a motif."""
    p = F.col("p")
    return pwm.groupBy(*by).agg(
        (-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))).alias("entropy")
    )


def structure_power(pwm: DataFrame, by: list[str], beta: float = 2.0) -> DataFrame:
    """``|p^b / S * log2 S|`` with S the column sum of ``p^b``; a column is at most seven rows."""
    powered = F.pow("p", F.lit(float(beta)))
    total = F.sum(powered).over(W.partitionBy(*by, "pos"))
    staged = pwm.withColumn("_s", total)
    return staged.select(
        *by, "pos", "symbol",
        F.abs(F.try_divide(powered, F.col("_s")) * F.log2("_s")).alias("height"),
    )


def most_stable(entropies: DataFrame, by: list[str], motif: str = "motif") -> DataFrame:
    """Lowest-entropy motif per dataset, name as tie-break."""
    return entropies.groupBy(*by).agg(F.min(F.struct("entropy", motif)).alias("m")).select(
        *by, F.col(f"m.{motif}").alias(motif), F.col("m.entropy").alias("entropy")
    )


def pwm_rows(pwm: DataFrame, by: list[str], alphabet: str = S.RNA) -> DataFrame:
    """One row per motif: ``cols``, its columns in order, each the shares in alphabet order."""
    shares = F.array(
        *[F.coalesce(F.max(F.when(F.col("symbol") == a, F.col("p"))), F.lit(0.0)) for a in alphabet]
    )
    columns = pwm.groupBy(*by, "pos").agg(shares.alias("c"))
    return columns.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda r: r["c"]).alias("cols")
    )


# ------------------------------------------------------------------ scan


def pfm_scan(
    records: DataFrame, pwms: DataFrame, keys: list[str], on: list[str], motif: str = "motif",
    top_n: int = 1, seq: str = "seq", alphabet: str = S.RNA, part_columns: int = 20_000, group_rows: int = 20_000,
) -> DataFrame:
    """Sum of the ``top_n`` best window scores of each record for each motif of its group.

    A window score is the product of the motif's probabilities along it; a record
    shorter than width + top_n - 1 scores 0. ``pwms`` comes from :func:`pwm_rows` over the
    same alphabet. The PWMs of a group are stacked and a record meets all of them at once, so it enters
    Python once for each ``part_columns`` columns of PWMs.
    """
    rows = records.select(*on, *keys, F.encode(F.col(seq), "UTF-8").alias("_text"))
    left, right, met = dealt_groups(rows, pwms.select(*on, motif, "cols"), on, F.size("cols"), part_columns, group_rows)
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *pwms.schema.fields]}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*on, *keys, motif]) + ", score double"

    def scan(texts: pa.Table, stacked: pa.Table) -> pa.Table:
        texts = texts.filter(pc.is_valid(texts.column("_text")))
        n, m = texts.num_rows, stacked.num_rows
        scores = stacked_top_sums(texts.column("_text").to_pylist(), stacked.column("cols").to_pylist(), alphabet, top_n) if n and m else np.zeros((n, m))
        each = pa.array(np.repeat(np.arange(n), m))
        out = texts.select([*on, *keys]).take(each)
        names = stacked.column(motif).take(pa.array(np.tile(np.arange(m), n)))
        return out.append_column(motif, names).append_column("score", pa.array(scores.ravel()))

    return left.groupBy(*met).cogroup(right.groupBy(*met)).applyInArrow(scan, schema)


# ------------------------------------------------------------ similarity


def motif_similarity(
    queries: DataFrame, db: DataFrame, on: list[str], min_overlap: int = 5, alphabet: str = S.RNA,
    part_columns: int = 4_000, group_rows: int = 200,
) -> DataFrame:
    """Best ungapped offset by mean column Pearson correlation, per query and database motif.

    This ranks similar motifs; it is not a significance model and gives no E-value.
    ``queries`` has ``on``, ``motif``, ``cols``; ``db`` has ``on``, ``target``,
    ``target_cols``. Offset 0 aligns the first columns; of equal offsets the smallest wins. Every query of a
    group meets every database motif of it, ``group_rows`` queries and ``part_columns`` database columns in a task.
    """
    # Columns of their own, since both sides may be made of one table.
    targets = db.select(*[F.col(f"`{k}`").alias(k) for k in [*on, "target", "target_cols"]])
    left, right, met = dealt_groups(
        queries.select(*on, "motif", "cols"), targets, on, F.size("target_cols"), part_columns, group_rows
    )
    kinds = {f.name: f.dataType.simpleString() for f in [*db.schema.fields, *queries.schema.fields]}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*on, "motif", "target"]) + ", similarity double, offset int, overlap int"
    letters = len(alphabet)

    def compare(own: pa.Table, others: pa.Table) -> pa.Table:
        own = own.filter(pc.is_valid(own.column("cols")))
        others = others.filter(pc.is_valid(others.column("target_cols")))
        best = best_offsets(own.column("cols").to_pylist(), others.column("target_cols").to_pylist(), letters, min_overlap)
        q, t = np.nonzero(best[2])
        out = own.select([*on, "motif"]).take(pa.array(q)).append_column("target", others.column("target").take(pa.array(t)))
        for name, values in zip(("similarity", "offset", "overlap"), best, strict=True):
            out = out.append_column(name, pa.array(values[q, t]))
        return out

    return left.groupBy(*met).cogroup(right.groupBy(*met)).applyInArrow(compare, schema)


def best_match(similarities: DataFrame, by: list[str]) -> DataFrame:
    """Most similar database motif per query; name as tie-break."""
    order = W.partitionBy(*by).orderBy(F.desc("similarity"), "target")
    return similarities.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


# ----------------------------------------------------------------- merge


def alignment(a: Column, b: Column) -> Column:
    """Best ungapped alignment: struct of match count ``score`` and ``offset`` of b's start in a.

    Of equal offsets the smallest wins.
    """
    def at(o: Column) -> Column:
        first, last = F.greatest(F.lit(1), o + 1), F.least(F.length(a), F.length(b) + o)
        same = F.filter(
            F.sequence(first, F.greatest(first, last)),
            lambda i: char_at(a, i) == char_at(b, i - o),
        )
        return F.struct(F.size(same).alias("score"), (-o).alias("neg_offset"))

    best = F.array_max(F.transform(F.sequence(1 - F.length(b), F.length(a) - 1), at))
    return let(
        best, lambda x: F.struct(x["score"].alias("score"), (-x["neg_offset"]).alias("offset"))
    )


def merge_threshold(a: Column, b: Column, min_len: int, fixed: float | None = None) -> Column:
    if fixed is not None:
        return F.lit(float(fixed))
    return F.greatest(F.lit(min_len - 1.0), F.lit(0.5) * F.least(F.length(a), F.length(b)))


def shared_run(length: int, min_len: int, fixed: float | None) -> int:
    """Letters in a row that a motif of ``length`` shares with any similar one that is no shorter.

    With ``m`` matches and the rest of the overlap mismatched, some run has ``m / (mismatches + 1)`` matches.
    """
    matches = math.ceil(fixed if fixed is not None else max(min_len - 1, 0.5 * length))
    return max(1, -(-matches // (length - matches + 1))) if matches <= length else length


def similar_pairs(
    rows: DataFrame, earlier: DataFrame, by: list[str], length: int, min_len: int, fixed: float | None
) -> DataFrame:
    """``by, rank, kept, score, shift``: motifs of ``rows(by, rank)`` with the similar ones of ``earlier(by, rank)`` before them.

    All of ``earlier`` have ``length`` letters, those of ``rows`` as many or more. Only motifs that share a
    run as long as similar ones must have meet; any motifs of a group do where that is one letter.
    """
    q = shared_run(length, min_len, fixed)
    runs = lambda m: F.array_distinct(S.kmers(m, q)) if q > 1 else F.array(F.lit(""))
    left = rows.select(*by, "rank", F.explode(runs(F.col("rank.m"))).alias("_run"))
    right = earlier.select(*by, F.col("rank").alias("kept"), F.explode(runs(F.col("rank.m"))).alias("_run"))
    met = left.join(right, [*by, "_run"]).where(F.col("kept") < F.col("rank"))
    met = (met.select(*by, "rank", "kept").distinct() if q > 1 else met.select(*by, "rank", "kept")).withColumn(
        "_al", alignment(F.col("rank.m"), F.col("kept.m"))
    )
    enough = F.col("_al.score") >= merge_threshold(F.col("rank.m"), F.col("kept.m"), min_len, fixed)
    return met.where(enough).select(*by, "rank", "kept", F.col("_al.score").alias("score"), F.col("_al.offset").alias("shift"))


def first_independent(rows: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """The motifs of ``rows(by, rank)`` that a walk in rank order keeps, each dropping its later neighbours in ``edges``.

    Rounds over the graph: what has no undecided earlier neighbour is kept, what has a kept one goes.
    A round decides all motifs at once that do not wait for another.
    """
    keys, kept, open_rows = [*by, "rank"], None, rows
    while True:
        waiting = edges.join(open_rows, keys, "left_semi").join(
            open_rows.withColumnRenamed("rank", "kept"), [*by, "kept"], "left_semi"
        )
        free = materialize(open_rows.join(waiting.select(*keys).distinct(), keys, "left_anti"))
        kept = free if kept is None else kept.unionByName(free)
        dropped = edges.join(free.withColumnRenamed("rank", "kept"), [*by, "kept"], "left_semi").select(*keys).distinct()
        rest = open_rows.join(free, keys, "left_anti").join(dropped, keys, "left_anti")
        open_rows = materialize(rest)
        if not open_rows.head(1):
            return kept


def merge_similar_motifs(
    motifs: DataFrame, by: list[str], min_len: int = 5, all_ties: bool = True, score_threshold: float | None = None,
) -> DataFrame:
    """Greedy merge, shortest motif first: ``(by, motif, target, shift)``.

    ``motifs`` has ``by``, ``motif`` and ``first_seen`` (an orderable first
    appearance). A motif similar to no kept motif is kept (``target = motif``,
    ``shift = 0``); otherwise it maps to its best kept motif (all ties by default),
    whose start lies ``shift`` after the motif's own.

    The greedy order is kept exactly but not walked one motif at a time. Motifs are taken length by
    length. Those of a length that are similar to no kept shorter one form a graph, and
    :func:`first_independent` decides them in a few rounds. Those kept meet all later motifs once, which gives
    both the candidates for their targets and what is still open, so work is motifs times kept motifs.
    """
    rank = F.struct(F.length("motif").alias("len"), F.col("first_seen"), F.col("motif").alias("m"))
    ranked = materialize(motifs.select(*by, rank.alias("rank")))
    lengths = [r[0] for r in ranked.select("rank.len").distinct().orderBy("len").collect()]  # as many as a record has letters at most
    keys = [*by, "rank"]
    open_rows, kept, hits = ranked, [], []
    for length in lengths:
        level = open_rows.where(F.col("rank.len") == length)
        if not level.head(1):
            continue
        edges = materialize(similar_pairs(level, level, by, length, min_len, score_threshold).select(*keys, "kept"))
        chosen = materialize(first_independent(level, edges, by))
        kept.append(chosen)
        later = ranked.where(F.col("rank.len") >= length)
        hits.append(materialize(similar_pairs(later, chosen, by, length, min_len, score_threshold)))
        gone = hits[-1].select(*keys).distinct()
        open_rows = materialize(open_rows.where(F.col("rank.len") > length).join(gone, keys, "left_anti"))
    if not kept:
        return motifs.select(*by, "motif", F.col("motif").alias("target"), F.lit(0).alias("shift"))
    candidates, own = hits[0], kept[0]
    for more_hits, more_kept in zip(hits[1:], kept[1:], strict=True):
        candidates, own = candidates.unionByName(more_hits), own.unionByName(more_kept)
    candidates = candidates.join(own, keys, "left_anti")
    top = candidates.groupBy(*keys).agg(F.max("score").alias("_top"))
    best = candidates.join(top, keys).where(F.col("score") == F.col("_top"))
    if not all_ties:
        first = best.groupBy(*keys).agg(F.min("kept").alias("kept"))
        best = best.join(first, [*keys, "kept"], "left_semi")
    merged = best.select(*by, F.col("rank.m").alias("motif"), F.col("kept.m").alias("target"), "shift")
    return own.select(*by, F.col("rank.m").alias("motif"), F.col("rank.m").alias("target"), F.lit(0).alias("shift")).unionByName(merged)


# ------------------------------------------------------------- structure


def structure_at_motif(
    motifs: DataFrame, records: DataFrame, by: list[str], width: int = 6, totals: bool = False
) -> DataFrame:
    """State string under the first occurrence of each ``width``-letter motif in each record.

    With ``totals`` the records of equal motif and states are one row, ``n`` of them, and ``positions`` their sum.

    ``records`` has ``by``, ``rec_id``, ``seq`` (RNA) and ``states``; motifs are matched by
    an equi-join on the distinct k-mers of the record, each of which carries its own place and
    states only. The k-mers of a batch of records are found together.
    """
    wanted = (
        motifs.where(F.length("motif") == width)
        .select(*by, F.translate("motif", "T", "U").alias("motif"))
        .distinct()
    )
    wanted = materialize(wanted)  # at most a row a word and group, of known size to the join
    if totals:
        return _state_totals(wanted, records, by, width)

    rows = records.select(*by, "rec_id", F.col("seq").alias("_text"), F.col("states").alias("_states")).where(F.length("_text") >= width)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*by, "rec_id"]) + ", motif string, position int, states string"

    def run(found):
        for batch in found:
            if not batch.num_rows:
                continue
            record, at, words, under = _first_states(batch.column("_text").to_pylist(), batch.column("_states").to_pylist(), width)
            keys = batch.select([*by, "rec_id"]).take(pa.array(record))
            yield pa.RecordBatch.from_arrays(
                [*keys.columns, words, pa.array((at + 1).astype(np.int32)), under], names=[*keys.schema.names, "motif", "position", "states"]
            )

    cells = rows.mapInArrow(run, schema)
    return cells.join(wanted, [*by, "motif"]).select(*by, "motif", "rec_id", "position", "states")


def _first_states(texts: list[str], states: list, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Record, place from 0, text and states of the first of each different word of ``width`` letters in each text."""
    record, at, words = first_words(texts, width)
    if all(t is not None and len(t) == len(s) for s, t in zip(texts, states, strict=True)):
        ends = np.cumsum([0, *map(len, texts)])
        return record, at, words, spelled_texts(code_points(states)[(ends[record] + at)[:, None] + np.arange(width)])
    parts = zip(record.tolist(), at.tolist(), strict=True)
    return record, at, words, pa.array([None if states[r] is None else states[r][a : a + width] for r, a in parts], pa.string())


def _state_totals(wanted: DataFrame, records: DataFrame, by: list[str], width: int) -> DataFrame:
    """``by, motif, states, n, positions`` of the wanted motifs.

    Records are dealt by group and share of a group, so that a task, which adds up the words of its records, has
    few groups. Sums move by (group, motif), of which the joins and later sums of either need no other move.
    """
    rows = records.select(*by, F.col("seq").alias("_text"), F.col("states").alias("_states"), "rec_id").where(F.length("_text") >= width)
    rows = rows.repartition(*by, F.pmod(F.xxhash64("rec_id"), F.lit(SHARES))).drop("rec_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*by, "motif", "states", "n", "positions"]
    schema = "".join(f"`{k}` {kinds[k]}, " for k in by) + "motif string, states string, n long, positions long"

    def added(parts: list) -> tuple:
        word, mark, n, places = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(word << 30 | mark, kind="stable")
        word, mark, n, places = word[order], mark[order], n[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (mark[1:] != mark[:-1])]))
        return word[first], mark[first], np.add.reduceat(n, first), np.add.reduceat(places, first)

    def emitted(keys: dict, kind: pa.Schema):
        for key, parts in keys.items():
            word, mark, n, places = added(parts)
            values = [pa.repeat(pa.scalar(v, kind.field(c).type), len(n)) for c, v in zip(by, key, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*values, spelled_numbers(word, width), spelled_numbers(mark, width), pa.array(n), pa.array(places)], names=names
            )

    def run(found):
        held: dict[tuple, list] = {}
        size = 0
        for batch in found:
            if not batch.num_rows:
                continue
            texts, states = batch.column("_text").to_pylist(), batch.column("_states").to_pylist()
            groups, which = group_numbers(batch, by)
            whole = all(t is not None and len(t) == len(s) for s, t in zip(texts, states, strict=True))
            found_here = word_totals(texts, states, which, width) if whole else None
            if found_here is None:
                record, at, words, under = _first_states(texts, states, width)
                own = batch.select(by).take(pa.array(record)).columns
                yield pa.RecordBatch.from_arrays([*own, words, under, pa.array(np.ones(len(at), np.int64)), pa.array(at + 1)], names=names)
                continue
            of, *sums = found_here
            cuts = np.searchsorted(of, np.arange(len(groups) + 1)).tolist()
            for key, a, b in zip(groups, cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    held.setdefault(key, []).append(tuple(x[a:b] for x in sums))
            size += len(of)
            if size > MOST_HELD:
                held = {key: [added(parts)] for key, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > MOST_HELD // 2:
                    yield from emitted(held, batch.schema)
                    held, size = {}, 0
        if held:
            yield from emitted(held, batch.schema)

    sums = rows.mapInArrow(run, schema).repartition(*by, "motif").groupBy(*by, "motif", "states")
    sums = sums.agg(F.sum("n").alias("n"), F.sum("positions").alias("positions"))
    return sums.join(wanted, [*by, "motif"]).select(*names)
