"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared by their lower-cased words. A line goes if an earlier line of the corpus (by
document id, then place) equals it or, if it has ``least_words`` or more words, is one word edit
away: a word changed, added or removed. With five words and more that is a similarity of 0.8
or above. "Earlier" does not ask whether the earlier line stays itself, so the result does not
depend on any order of work.

Every line emits its variants as hashed keys: itself and itself without each one of its words.
Two lines are within one edit exactly if they share a variant that both lack the same word of, or
that is one of them whole. So in a key's group the earliest line of each missing position, and
the earliest of all for the whole line, decide; they come from aggregates, and no pair of a group
is formed. The earliest candidate of each line is then verified on the words themselves.

Variants that cannot have a partner are not emitted: within one edit either the first or the
second half of the words is equal, so only lines that share the hash of a half with another one
go on, with the variants that lack a word of the other half.

Edge cases: a null text and one without lines have none and stay as they are; blank lines are
never dropped; null ids come last; rows that share an id share its place (of equal lines at the
same place each stays), and rows equal in id and text share their result; very long lines are taken whole, in time
in proportion to their words; an empty table gives an empty result. A document of which every line goes is left
with an empty text. Columns of the caller, whatever their names, travel in one struct and never meet those used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ribospan.session import materialize

LAST = (1 << 63) - 1
LONG = 64  # words; the variants of longer texts are hashed word by word


ODD_SPACE = r"\x20\x20|[\x09\x0B-\x0D]"


def normal(low: Column) -> Column:
    """The words of a lower-cased line with one space between them."""
    return F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))


def normal_lines(text: Column) -> Column:
    """The lines of a text, each :func:`normal`; most texts have single spaces only and need a trim."""
    low = F.split(F.lower(text), "\n", -1)
    return F.when(text.rlike(ODD_SPACE), F.transform(low, normal)).otherwise(F.transform(low, F.trim))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key`` (id and text) and ``at`` (the place of the document)."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select("*", F.xxhash64(doc_id, "text").alias("key"), F.coalesce(doc_id, F.lit(LAST)).alias("at"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """``key, at, line_no, h, line`` of ``docs(key, at, text)``: one row a line that is not blank."""
    lines = docs.select("key", "at", F.posexplode(normal_lines(F.col("text"))).alias("line_no", "line"))
    return lines.where("line <> ''").select("key", "at", "line_no", F.xxhash64("line").alias("h"), "line")


def half_keys(line: Column, n: Column) -> list[Column]:
    """Hashes of the halves that lines within one edit share: for n words, and for n - 1."""
    keys = []
    for m in (n, n - 1):
        head = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), m, first_words(line, head)))
        keys.append(F.xxhash64(F.lit("tail"), m, first_words(line, head - m)))
    return keys


def n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1


def first_words(line: Column, n: Column) -> Column:
    """The first ``n`` words, or the last ``-n``; empty for 0."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def without(line: Column, n: Column, k: Column) -> Column:
    """The line of ``n`` words without its word ``k`` (from 1; 0: whole)."""
    head, tail = first_words(line, k - 1), first_words(line, k - n)
    return F.when(k == 0, line).otherwise(F.concat_ws(" ", F.nullif(head, F.lit("")), F.nullif(tail, F.lit(""))))


def word_hash(line: Column) -> Column:
    """Hash of a line from the hashes of its words and places, which a variant can be put together from."""
    words = F.transform(F.split(line, " "), lambda w, i: F.xxhash64(w, i))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def variants_of(spelled: DataFrame) -> DataFrame:
    """``h, first, missing, n, variant`` of ``spelled(h, first, head, tail, line, n)``: the line, and without each word in play.

    A variant of up to ``LONG`` words is hashed as text. Those of more words are put together from running
    sums of the words' hashes, a row a word, so that time is in proportion to the words of a line.
    """
    in_play = lambda k: (
        F.col("head") & (k > F.floor((F.col("n") - 1) / 2)) | F.col("tail") & (k <= F.floor((F.col("n") + 1) / 2))
    )
    rows = spelled.repartition("h")
    short = rows.where(F.col("n") <= LONG + 1)
    places = F.filter(F.sequence(F.lit(0), F.col("n")), lambda k: (k == 0) | in_play(k))
    short = short.select("h", "first", "line", "n", F.explode(places).alias("missing"))
    as_text = F.xxhash64(without(F.col("line"), F.col("n"), F.col("missing")))
    by_words = (F.col("missing") == 0) & (F.col("n") > LONG)
    short = short.select("h", "first", "missing", "n", F.when(by_words, word_hash(F.col("line"))).otherwise(as_text).alias("variant"))
    long = rows.where(F.col("n") > LONG + 1)
    whole = long.select("h", "first", F.lit(0).alias("missing"), "n", word_hash(F.col("line")).alias("variant"))
    words = long.select("h", "first", "head", "tail", "n", F.posexplode(F.split("line", " ")).alias("at", "word"))
    words = words.select("h", "first", "head", "tail", "n", "at", F.xxhash64("word", "at").alias("own"), F.xxhash64("word", F.col("at") - 1).alias("moved"))
    line = Window.partitionBy("h")
    so_far = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.bit_xor("own").over(so_far).bitwiseXOR(F.col("own"))
    after = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(so_far))
    each = words.withColumn("variant", before.bitwiseXOR(after)).withColumn("missing", F.col("at") + 1).where(in_play(F.col("missing")))
    return short.unionByName(whole).unionByName(each.select("h", "first", "missing", "n", "variant"))


def line_marks(lines: DataFrame) -> DataFrame:
    """Place, hash, number of words and half keys of each line; no text."""
    n = n_words(F.col("line"))
    halves = half_keys(F.col("line"), n)
    return lines.select("key", "at", "line_no", "h", n.alias("n"), *[k.alias(f"k{i}") for i, k in enumerate(halves)])


def deciding_lines(docs: DataFrame, marks: DataFrame, least_words: int, small: int = 500_000) -> DataFrame:
    """``h, stays``: each line that goes somewhere, and the one place where it stays.

    The place is null for a line that goes everywhere, as an earlier one is an edit away. The
    list of lines whose words are fetched is broadcast up to ``small`` rows (of three numbers),
    beyond that lines are dealt out by hash.
    """
    place = F.struct("at", "line_no")
    half_names = [c for c in marks.columns if c.startswith("k") and c != "key"]
    distinct = materialize(
        marks.groupBy("h").agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), F.max("n").alias("n"),
            *[F.max(c).alias(c) for c in half_names],
        )
    )
    half = distinct.where(F.col("n") >= least_words - 1).select(
        "h", F.posexplode(F.array(*half_names)).alias("which", "half")
    )
    shared = half.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    # A shared first half (even keys) leaves edits in the second one, and the other way round.
    in_play = half.join(shared, "half", "left_semi").groupBy("h").agg(
        F.max(F.col("which") % 2 == 0).alias("head"), F.max(F.col("which") % 2 == 1).alias("tail")
    )
    in_play = materialize(
        distinct.join(in_play, "h").select(
            "h", F.col("first.at").alias("at"), F.col("first.line_no").alias("line_no"), "head", "tail"
        )
    )
    way = "broadcast" if in_play.count() <= small else "shuffle_hash"
    # Places meet the raw lines first; only the lines found are normalised and checked by hash.
    raw = docs.select("at", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    spelled = (
        raw.join(in_play.hint(way), ["at", "line_no"])
        .select("h", place.alias("first"), "head", "tail", normal(F.lower("raw")).alias("line"))
        .where(F.xxhash64("line") == F.col("h"))
        .dropDuplicates(["h"])
    )
    spelled = materialize(spelled.withColumn("n", n_words(F.col("line"))))
    # Dealt out by hash, so that long lines do not all stay with the task that read them.
    every = materialize(variants_of(spelled))
    met = every.groupBy("variant").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("variant")
    variants = materialize(every.join(met, "variant", "left_semi"))
    # The earliest line that lacks the same word, or is whole; for a whole line the earliest of all.
    by_place = variants.groupBy("variant", "missing").agg(F.min(F.struct("first", "h", "missing")).alias("best"))
    tops = by_place.groupBy("variant").agg(
        F.min("best").alias("any"), F.min(F.when(F.col("missing") == 0, F.col("best"))).alias("whole")
    )
    partners = by_place.join(tops, "variant").select(
        "variant", "missing",
        F.when(F.col("missing") == 0, F.col("any")).otherwise(F.least("best", "whole")).alias("partner"),
    )
    candidates = (
        variants.where(F.col("n") >= least_words)
        .join(partners, ["variant", "missing"])
        .where(F.col("partner.first") < F.col("first"))
        .groupBy("h")
        .agg(F.min(F.struct("partner", "missing")).alias("c"))
        .select("h", "c.missing", F.col("c.partner.h").alias("p"), F.col("c.partner.missing").alias("p_missing"))
    )
    own = spelled.select("h", F.col("line").alias("own"), "n")
    theirs = spelled.select(F.col("h").alias("p"), F.col("line").alias("theirs"), F.col("n").alias("p_n"))
    same = without(F.col("own"), F.col("n"), F.col("missing")) == without(
        F.col("theirs"), F.col("p_n"), F.col("p_missing")
    )
    one_edit = (F.col("missing") == F.col("p_missing")) | (F.col("missing") == 0) | (F.col("p_missing") == 0)
    edited = candidates.join(own, "h").join(theirs, "p").where(same & one_edit)
    edited = edited.select("h", F.lit(True).alias("edited"))
    repeated = distinct.where("times > 1").select("h", "first")
    return repeated.join(edited, "h", "full_outer").select(
        "h", F.when(F.col("edited").isNull(), F.col("first")).alias("stays")
    )


def dropped_lines(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """``key, gone``: numbers (from 0) of the lines that go, for each document of ``docs(key, at, text)`` that has any."""
    lines = numbered_lines(docs)
    marks = materialize(line_marks(lines))
    decided = materialize(deciding_lines(docs, marks, least_words))
    place = F.struct("at", "line_no")
    gone = marks.select("key", "at", "line_no", "h").join(decided, "h").where(
        F.col("stays").isNull() | (F.col("stays") != place)
    )
    return gone.groupBy("key").agg(F.collect_set("line_no").alias("gone"))


def deduplicated(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """``row`` (the columns of ``docs``), ``lines`` and ``kept`` (arrays of lines; null for a null text)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = keyed(rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")))
    gone = dropped_lines(rows.select("key", "at", "text"), least_words)
    lines = F.split("row.text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i))
    return (
        rows.select("row", "key").join(gone.hint("shuffle_hash"), "key", "left")
        .select("row", lines.alias("lines"), F.when(F.col("gone").isNull(), lines).otherwise(kept).alias("kept"))
    )


def dedup_report(docs: DataFrame, least_words: int = 5) -> DataFrame:
    rows = deduplicated(docs.select("doc_id", "text"), least_words)
    count = lambda a: F.coalesce(F.when(F.col(a).isNotNull(), F.size(a)), F.lit(0)).cast("long")
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), count("lines").alias("n_lines"), count("kept").alias("n_kept"),
        F.concat_ws("\n", "kept").alias("text"),
    )


def dedup_documents(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """``docs`` with the lines that stay, and ``n_chars`` to match; documents left without any line go."""
    rows = deduplicated(docs, least_words)
    changed = F.size("kept") < F.size("lines")
    text = F.when(changed, F.concat_ws("\n", "kept")).otherwise(F.col("row.text"))
    rows = rows.where(~F.coalesce(changed & (F.trim(F.concat_ws("", "kept")) == ""), F.lit(False))).withColumn("new", text)
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH docs AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT id, text, i AS line_no, trim(regexp_replace(lower(parts[i]), '[ 	-
]+', ' ', 'g'), ' ') AS line
  FROM docs, unnest(range(1, len(parts) + 1)) AS u(i)),
firsts AS (
  SELECT line, min({'id': id, 'no': line_no}) AS first, string_split(line, ' ') AS words
  FROM lines WHERE line <> '' GROUP BY line),
variants AS (
  SELECT line, first, len(words) AS n, k,
         CASE WHEN k = 0 THEN line ELSE array_to_string(list_concat(words[1:k - 1], words[k + 1:]), ' ') END AS variant
  FROM firsts, unnest(range(0, len(words) + 1)) AS u(k)),
near AS (
  SELECT DISTINCT v.line FROM variants v JOIN variants w
  ON v.variant = w.variant AND (v.k = w.k OR v.k = 0 OR w.k = 0) AND w.first < v.first WHERE v.n >= 5),
placed AS (
  SELECT l.id, l.text, l.line_no,
         l.line <> '' AND (n.line IS NOT NULL OR f.first <> {'id': l.id, 'no': l.line_no}) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line),
dropped AS (SELECT id, text, list(line_no) AS gone FROM placed WHERE gone GROUP BY id, text)
SELECT d.doc_id, coalesce(len(d.parts), 0) AS n_lines,
       coalesce(len(d.parts), 0) - coalesce(len(g.gone), 0) AS n_kept,
       coalesce(array_to_string([d.parts[i] for i in range(1, len(d.parts) + 1) IF g.gone IS NULL OR NOT list_contains(g.gone, i)], chr(10)), '') AS text
FROM docs d LEFT JOIN dropped g ON d.id = g.id AND d.text IS NOT DISTINCT FROM g.text
"""
