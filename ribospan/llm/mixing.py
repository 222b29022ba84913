"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source has a target in words. Its documents get the whole copies that all of them are due
(``floor(target / source_size)``); the rest of the target is the quota of a Pareto sample. A
document's inclusion probability is proportional to its size, ``p = min(1, level * size)``, with the
level at which the expected words of the sample are the quota; documents with ``p = 1`` are certain.
With a uniform number u a document ranks by

    (u / (1 - u)) / (p / (1 - p))

(certain ones first) and documents are taken in that order until their words come nearest to the
quota. The sample size is fixed in words, so a source misses its target by at most half a document.

``u`` comes from a digest of seed, id and text, and of a running number among rows that are equal in
them and in source: reruns agree whatever the partitioning, and repeated rows are drawn one by one.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, last in
order; a source without words has target 0; of rows equal in id, text and source it does not matter
which one is taken; null ids are allowed; ties in rank go by digest and running number; very
long texts are counted and digested where they are read; an empty table gives an empty result;
extra columns, whatever their names, stay in :func:`mixed_documents` and are left out of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ribospan.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn. ``share`` times all sizes
    is dealt out by weight; a target stops at ``most`` times its source's size and the excess is
    dealt out again by weight until none is above. With the sources in order of cap by weight
    that is one level for all that are not capped. The level that each source gives, if those
    before it are capped, rises as long as the source is above its cap and falls from then on,
    so the largest of them is the level sought.
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share
         - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    )
    level = F.max("level").over(everything)
    return leveled.select(
        "source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target")
    )


def _same_source(other: str) -> Column:
    return F.col("source").eqNullSafe(F.col(other))


def sample_levels(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """``plan_source, level`` of each source with a quota: ``sum(min(1, level * size) * size)`` is the quota.

    That sum, as a function of the level, is the least of the lines "all sizes from s on are certain,
    the others in proportion", so the level sought is the largest at which such a line reaches the quota.
    The lines come from running sums over the distinct sizes of a source.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source")
    squares = (F.col("n") * F.col("size")).cast("double") * F.col("size")
    lines = sizes.withColumn("certain", F.sum(F.col("n") * F.col("size")).over(down))
    lines = lines.withColumn("others", F.sum(squares).over(whole) - F.sum(squares).over(down)).withColumn("all", F.sum(squares).over(whole))
    met = lines.join(quotas, F.col("source").eqNullSafe(F.col("plan_source"))).where("quota > 0")
    reached = F.when(F.col("others") > 0, (F.col("quota") - F.col("certain")) / F.col("others"))
    return met.groupBy("plan_source").agg(F.greatest(F.max(F.col("quota") / F.col("all")), F.max(reached)).alias("level"))


def mixture_plan(
    rows: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, slice_rows: int = 5000
) -> DataFrame:
    """How many copies each source takes, from ``rows(source, size, u, digest, nth)``.

    Returns one row a source: target, whole copies, level and the place in its Pareto order up to which
    one copy more is taken. Only sums leave the scan: the order is cut into slices of about
    ``slice_rows`` documents, slice sums are accumulated, and only the slice in which the quota
    ends is looked at document by document. No task holds a source.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = materialize(sums)
    targets = source_targets(sums.select("source", "source_size"), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (
        targets.withColumn("whole", F.floor(ratio))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "plan_source")
        .join(sums.select(F.col("source"), "n"), F.col("plan_source").eqNullSafe(F.col("source")))
        .drop("source")
        .withColumn("slices", F.ceil(F.col("n") / slice_rows))
    )
    plan = materialize(plan)
    levels = sample_levels(rows, plan.select("plan_source", "quota")).withColumnRenamed("plan_source", "level_source")
    plan = plan.join(levels, F.col("plan_source").eqNullSafe(F.col("level_source")), "left").drop("level_source")
    plan = materialize(plan)
    ordered = rows.join(plan, _same_source("plan_source")).where(inclusion() > 0).withColumn("rank", pareto_rank())
    ordered = ordered.withColumn("slice", slice_of()).select("plan_source", "slice", "rank", "digest", "nth", "size", "quota")
    slices = ordered.groupBy("plan_source", "slice").agg(F.sum("size").alias("words"), F.max("quota").alias("quota"))
    slices = slices.withColumn("end", F.sum("words").over(Window.partitionBy("plan_source").orderBy("slice")))
    last = slices.where((F.col("end") >= F.col("quota")) & (F.col("end") - F.col("words") < F.col("quota")))
    last = materialize(
        last.select(F.col("plan_source").alias("s"), F.col("slice").alias("k"), (F.col("end") - F.col("words")).alias("before"))
    )
    within = ordered.join(last, F.col("plan_source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    place = F.struct("rank", "digest", "nth")
    running = Window.partitionBy("s").orderBy("rank", "digest", "nth")
    cum = F.col("before") + F.sum("size").over(running)
    ends = (
        within.withColumn("cum", cum)
        .groupBy("s")
        .agg(
            F.max("slice").alias("last_slice"),
            F.max(F.when(F.col("cum") * 2 - F.col("size") <= F.col("quota") * 2, place)).alias("last_place"),
        )
    )
    plan = plan.join(ends, F.col("plan_source").eqNullSafe(F.col("s")), "left").drop("s")
    return materialize(plan)


def inclusion() -> Column:
    """The inclusion probability of a row that is joined with its source's plan; 0 for what is never drawn."""
    return F.coalesce(F.least(F.lit(1.0), F.col("level") * F.col("size")), F.lit(0.0))


def pareto_rank() -> Column:
    p = inclusion()
    return F.when(p >= 1, 0.0).when(p > 0, F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(p, 1 - p)))


def slice_of() -> Column:
    """The slice of a row: it grows with the rank, and has about even shares where the documents' p are alike."""
    mean = F.try_divide("quota", "source_size")
    even = pareto_rank() * F.try_divide(mean, 1 - mean)
    return F.floor(even / (1 + even) * F.col("slices"))


def copies() -> Column:
    """Copies of a row that is joined with its source's plan."""
    place = F.struct(pareto_rank().alias("rank"), F.col("digest"), F.col("nth"))
    more = (inclusion() > 0) & F.col("last_slice").isNotNull() & (
        (slice_of() < F.col("last_slice"))
        | ((slice_of() == F.col("last_slice")) & F.coalesce(place <= F.col("last_place"), F.lit(False)))
    )
    return F.when(F.col("source_size") > 0, F.col("whole") + F.when(more, 1).otherwise(0)).otherwise(0)


def unit_columns(seed: int, doc_id: Column, text: Column, source: Column) -> list[Column]:
    """What one document is to the plan: ``digest`` tells rows apart that differ in id, text or source."""
    spelled = [F.coalesce(p.cast("string"), F.lit("")) for p in (doc_id, text)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *spelled))
    return [doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), n_words(text).alias("size"), digest.alias("digest")]


def uniform(nth: Column) -> Column:
    """A number in (0, 1), on a grid of 2**-52, from the digest of a row and its number among equal rows."""
    own = F.when(nth == 1, F.col("digest")).otherwise(F.md5(F.concat_ws("|", F.col("digest"), nth.cast("string"))))
    return (F.conv(F.substring(own, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def repeated(df: DataFrame, times: str, number: str, portion: int = 10_000) -> DataFrame:
    """Each row ``times`` times, numbered from 1; a row with very many is dealt out in portions first."""
    last = F.ceil(F.col(times) / portion) - 1
    few = df.where(F.col(times).between(1, portion)).withColumn("_from", F.lit(0).cast("long"))
    many = df.where(F.col(times) > portion).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("_from")
    both = few.unionByName(many)
    end = F.least(F.col(times), (F.col("_from") + 1) * portion)
    return both.withColumn(number, F.explode(F.sequence(F.col("_from") * portion + 1, end))).drop("_from")


def single_units(units: DataFrame) -> DataFrame:
    """``doc_id, source, size, digest, nth, u`` of every row, from ``units`` (rows with equal ones put together, with ``n``)."""
    return repeated(units, "n", "nth").withColumn("u", uniform(F.col("nth"))).drop("n")


def counted_units(docs: DataFrame, seed: int) -> DataFrame:
    rows = docs.select(*unit_columns(seed, F.col("doc_id"), F.col("text"), F.col("source")))
    return rows.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n"))


def mix_sources(docs: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source)``, in words."""
    rows = materialize(single_units(materialize(counted_units(docs, seed))))
    plan = mixture_plan(rows, **options)
    return rows.join(plan, _same_source("plan_source")).select(
        "doc_id", "size", "source_size", "target", (copies() * F.col("size")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it, all columns kept.

    Texts do not move: the plan has a row a source and meets them where they are read. Only rows
    that are repeated are put together first, and come as often as all of them are taken.
    """
    units = materialize(counted_units(docs, seed))
    rows = materialize(single_units(units))
    plan = mixture_plan(rows, **options)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    doc_id, text, source = (F.col("row").getField(c) for c in ("doc_id", "text", "source"))
    sized = packed.select("row", *unit_columns(seed, doc_id, text, source))
    key = ["digest", "source"]
    same = F.col("digest").eqNullSafe(F.col("digest_again")) & F.col("source").eqNullSafe(F.col("source_again"))
    again = materialize(units.where("n > 1").select(*[F.col(c).alias(f"{c}_again") for c in key]).distinct())
    some_again = bool(again.head(1))
    alone = sized.join(again, same, "left_anti") if some_again else sized
    alone = alone.withColumn("nth", F.lit(1).cast("long")).withColumn("u", uniform(F.lit(1)))
    taken = alone.join(plan, _same_source("plan_source")).select("row", copies().cast("long").alias("copies"))
    # A few copies a row at most (``most``), so rows are repeated where they are read.
    out = taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
    if not some_again:
        return out
    drawn = rows.join(again, same, "left_semi").join(plan, _same_source("plan_source"))
    drawn = drawn.groupBy(*[F.col(c).alias(f"{c}_again") for c in key]).agg(F.sum(copies()).cast("long").alias("copies"))
    one = sized.join(again, same, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
    many = one.join(drawn, same).select("row", "copies")
    return out.unionByName(repeated(many, "copies", "copy").select("row.*"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS digest
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, digest) AS nth FROM docs),
drawn AS (
  SELECT *, (('0x' || substr(CASE WHEN nth = 1 THEN digest ELSE md5(concat_ws('|', digest, nth::VARCHAR)) END, 1, 13))::BIGINT + 0.5::DOUBLE)
            / 4503599627370496::DOUBLE AS u
  FROM numbered),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
                  source_size * 2.0::DOUBLE AS cap,
                  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
leveled AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM ranked),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM leveled),
plan AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM targets),
quotas AS (SELECT *, target - whole * source_size AS quota FROM plan),
by_size AS (SELECT source, size, count(*) AS n FROM docs WHERE size > 0 GROUP BY ALL),
lines AS (
  SELECT source, (sum(n * size) OVER down)::DOUBLE AS certain, sum((n * size)::DOUBLE * size) OVER every - sum((n * size)::DOUBLE * size) OVER down AS others,
         sum((n * size)::DOUBLE * size) OVER every AS everything
  FROM by_size WINDOW down AS (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING), every AS (PARTITION BY source)),
samples AS (
  SELECT q.source, greatest(max(quota / everything), max(CASE WHEN others > 0 THEN (quota - certain) / others END)) AS level
  FROM lines l JOIN quotas q ON l.source IS NOT DISTINCT FROM q.source WHERE quota > 0 GROUP BY q.source),
chances AS (
  SELECT d.doc_id, d.source, d.size, d.digest, d.nth, d.u, q.source_size, q.target, q.whole, q.quota,
         coalesce(least(1.0::DOUBLE, s.level * d.size), 0) AS p
  FROM drawn d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN samples s ON d.source IS NOT DISTINCT FROM s.source),
placed AS (
  SELECT *, sum(size) OVER (
    PARTITION BY source, p > 0 ORDER BY CASE WHEN p >= 1 THEN 0 ELSE (u / (1 - u)) / (p / (1 - p)) END, digest, nth ROWS UNBOUNDED PRECEDING) AS cum
  FROM chances)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (whole + CASE WHEN p > 0 AND cum * 2 - size <= quota * 2 THEN 1 ELSE 0 END) * size ELSE 0 END)::BIGINT AS taken
FROM placed
"""
