"""Motif prior features: enriched words per alphabet, turned into PWMs and scanned back.

Enriched k-mers stand in for an external motif solver; everything else follows the
prior's steps: Bonferroni rule, PWM per motif, scan of both classes, one feature
column per (alphabet, motif) joined by record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ribospan.functions import sequence as S
from ribospan.functions.scans import WordSums, code_points, group_numbers, spelled_texts, word_places
from ribospan.functions.special import text_bytes
from ribospan.operators import motifs as M
from ribospan.operators.stats import hypergeom_enrichment
from ribospan.session import materialize

MOST_SUMS = 1 << 21  # of words in a task

# Symbols of each alphabet.
ALPHABETS = {
    "seq_4": S.RNA,
    "seq_struct_8": S.LETTERS_28[:8],
    "seq_struct_16": S.LETTERS_28[:16],
    "seq_struct_28": S.LETTERS_28,
    "struct_2": "PU",
    "struct_4": "LMPU",
    "struct_7": S.STATES_7,
}


def alphabet_rows(df: DataFrame, keys: list[str], alphabets: list[str]) -> DataFrame:
    """Long ``(keys, alphabet, seq)`` from ``seq`` and ``states``: a batch of records becomes a batch in each alphabet."""
    chosen = df.select(*keys, F.col("seq").alias("_seq"), F.col("states").alias("_states"))
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "alphabet string, seq string"
    encoded = S.alphabet_texts()

    def run(found):
        for batch in found:
            texts = encoded(batch.column("_seq"), batch.column("_states"))
            own = batch.select(keys).columns
            for a in alphabets:
                yield pa.RecordBatch.from_arrays([*own, pa.repeat(a, batch.num_rows), texts[a]], names=[*keys, "alphabet", "seq"])

    return chosen.mapInArrow(run, schema)


def _words(codes: np.ndarray, starts: np.ndarray, symbols: np.ndarray, width: int, records: int) -> tuple[np.ndarray, int, callable]:
    """A number for the word at each start, a bound on the numbers, and what gives the words of numbers as rows of code points."""
    m = len(symbols)
    if m**width * records < 1 << 62:
        ids = np.zeros(len(starts), np.int64)
        for j in range(width):
            ids = ids * m + codes[starts + j]
        powers = m ** np.arange(width - 1, -1, -1, dtype=np.int64)
        return ids, m**width, lambda found: symbols[found[:, None] // powers % m]
    each, ids = np.unique(codes[starts[:, None] + np.arange(width)], axis=0, return_inverse=True)
    return ids.ravel(), len(each), lambda found: symbols[each[found]]


def _batch_counts(batch: pa.RecordBatch, by: list[str], width: int) -> pa.RecordBatch | None:
    """``by, motif, n_with, n_pos_with`` of one batch of any texts."""
    batch = batch.filter(pc.greater_equal(pc.utf8_length(batch.column("_text")), width))
    n = batch.num_rows
    if not n:
        return None
    group = np.zeros(n, np.int64)
    for k in by:
        values = batch.column(k).dictionary_encode(null_encoding="encode")
        group = group * (len(values.dictionary) + 1) + values.indices.to_numpy()
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    texts = batch.column("_text").to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, n)
    symbols, codes = np.unique(points, return_inverse=True)
    record = np.repeat(np.arange(n), sizes - width + 1)
    starts = np.arange(len(record)) + np.repeat(np.cumsum(sizes) - sizes - np.concatenate([[0], np.cumsum(sizes - width + 1)[:-1]]), sizes - width + 1)
    ids, bound, spelled = _words(codes, starts, symbols, width, n)
    # A word counts once in a record.
    pairs = np.sort(record * bound + ids)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    record, ids = np.divmod(pairs, bound)
    marked = batch.column("_marked").to_numpy(zero_copy_only=False)
    held = np.sort((group[record] * bound + ids) * 2 + marked[record])
    at = np.flatnonzero(np.concatenate([[True], held[1:] >> 1 != held[:-1] >> 1]))
    n_with, n_pos = np.diff(np.append(at, len(held))), np.add.reduceat(held & 1, at)
    which, ids = np.divmod(held[at] >> 1, bound)
    spelling = np.ascontiguousarray(spelled(ids), dtype="<u4").view(f"<U{width}").ravel()
    keys = batch.select(by).take(pa.array(first[which]))
    return pa.RecordBatch.from_arrays(
        [*keys.columns, pa.array(spelling.tolist(), pa.string()), pa.array(n_with), pa.array(n_pos)],
        names=[*by, "motif", "n_with", "n_pos_with"],
    )


def word_totals(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """:func:`word_counts`, and for each group a row without a motif that counts all its records and all positive ones.

    A task adds up the words of its batches, and passes on the sums when there are too many of them.
    """
    chosen = rows.select(*by, F.coalesce(F.col("label") == 1, F.lit(False)).alias("_marked"), F.col("seq").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    names = [*by, "motif", "n_with", "n_pos_with"]
    schema = "".join(f"`{k}` {kinds[k]}, " for k in by) + "motif string, n_with long, n_pos_with long"

    def run(found):
        sums, sizes, types = WordSums(width), {}, None

        def keys_of(groups: list[tuple], which) -> list[pa.Array]:
            return [pa.array([g[i] for g in groups], t).take(pa.array(which)) for i, t in enumerate(types)]

        def held():
            for groups, which, words, n, in_marked in sums.taken():
                yield pa.RecordBatch.from_arrays([*keys_of(groups, which), words, pa.array(n), pa.array(in_marked)], names=names)
            groups, many = list(sizes), np.array(list(sizes.values()), np.int64).reshape(-1, 2)
            sizes.clear()
            if groups:
                motif = pa.nulls(len(groups), pa.string())
                yield pa.RecordBatch.from_arrays([*keys_of(groups, np.arange(len(groups))), motif, pa.array(many[:, 0]), pa.array(many[:, 1])], names=names)

        for batch in found:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in by]
            groups, which = group_numbers(batch, by)
            marked = batch.column("_marked").to_numpy(zero_copy_only=False)
            for g, n, m in zip(groups, np.bincount(which).tolist(), np.bincount(which[marked], minlength=len(groups)).tolist(), strict=True):
                n_all, n_marked = sizes.get(g, (0, 0))
                sizes[g] = n_all + n, n_marked + m
            if not sums.add(*text_bytes(batch.column("_text")), groups, which, marked):
                counts = _batch_counts(batch, by, width)
                if counts is not None:
                    yield counts
            if sums.size > MOST_SUMS:
                sums.merge()
                if sums.size > MOST_SUMS // 2:
                    yield from held()
            if len(sizes) > MOST_SUMS // 8:
                yield from held()
        if types:
            yield from held()

    # Equal words of a task are one row already, so they are added up behind the move only.
    counts = chosen.mapInArrow(run, schema).repartition(*by, "motif")
    return counts.groupBy(*by, "motif").agg(F.sum("n_with").alias("n_with"), F.sum("n_pos_with").alias("n_pos_with"))


def word_counts(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """``by, motif, n_with, n_pos_with``: records and positive records that hold each word, each record read once."""
    return word_totals(rows, by, width).where(F.col("motif").isNotNull())


def enriched_words(rows: DataFrame, by: list[str], width: int, max_motifs: int | None) -> DataFrame:
    """The most enriched words per group under the Bonferroni rule, at most ``max_motifs`` (None: all).

    Enriched means p below 0.01 / n, n being the words seen in the group. ``rows`` is read once.
    """
    totals = materialize(word_totals(rows, by, width))
    counts = totals.where(F.col("motif").isNotNull())
    sizes = totals.where(F.col("motif").isNull()).select(*by, F.col("n_with").alias("total"), F.col("n_pos_with").alias("positives"))
    n_words = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = counts.join(sizes, by).join(n_words, by).withColumn("_cut", F.lit(0.01) / F.col("_n"))
    # A word seen n times can't have a smaller p than if all n were positive; most words are too rare to pass.
    n = F.col("n_with").cast("double")
    least = n * F.log(F.greatest(F.col("positives") - n + 1, F.lit(1e-9)) / (F.col("total") - n + 1))
    # The counts are small, the sums over their tails long: they are dealt out whatever their size, and added up once.
    tested = materialize(hypergeom_enrichment(sized.where(least < F.log("_cut")).repartition(M.SHARES, *by, "motif")))
    passing = tested.where(F.col("p") < F.col("_cut")).drop("_n", "_cut")
    if max_motifs is None:
        return passing
    order = W.partitionBy(*by).orderBy("p", "motif")
    return passing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_motifs)


def word_instances(rows: DataFrame, words: DataFrame, by: list[str], width: int, flank: int) -> DataFrame:
    """``by, motif, seq``: the places of ``words`` widened by ``flank``, those inside the record.

    A record meets the list of its group's words, of which there are few, and leaves only its places.
    """
    lists = materialize(words.groupBy(*by).agg(F.collect_list("motif").alias("_words")))
    met = rows.select(*by, F.col("seq").alias("_text")).where(F.length("_text") >= width).join(lists, by)
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in by) + "motif string, seq string"

    def run(found):
        for batch in found:
            if not batch.num_rows:
                continue
            groups, which = group_numbers(batch, by)
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(groups) + 1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = batch.take(pa.array(order[a:b]))
                listed = own.column("_words")[0].as_py()
                points, ends = text_bytes(own.column("_text"))
                if points.max(initial=0) > 127:
                    texts = own.column("_text").to_pylist()
                    points, ends = code_points(texts), np.cumsum([0, *map(len, texts)])
                word, text, at = word_places(points, ends, listed, width, flank)
                if len(at):
                    wide = spelled_texts(points[(at - flank)[:, None] + np.arange(width + 2 * flank)])
                    keys = own.select(by).take(pa.array(text)).columns
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(listed, pa.string()).take(pa.array(word)), wide], names=[*by, "motif", "seq"])

    return met.select(*by, "_text", "_words").mapInArrow(run, schema)


def prior_features(
    records: DataFrame, alphabets: list[str], width: int = 5, max_motifs: int = 5, top_n: int = 1,
    flank: int = 0,
) -> DataFrame:
    """Long features ``(dataset_id, rec_id, label, feature, score)``; feature is ``<alphabet>_<motif>``.

    ``records`` has ``dataset_id``, ``rec_id``, ``label``, ``seq`` (RNA) and ``states``. The PWM of
    a word is built from its occurrences widened by ``flank`` positions on each side.
    """
    by = ["dataset_id", "alphabet"]
    rows = materialize(alphabet_rows(records, ["dataset_id", "rec_id", "label"], alphabets))
    # Few rows; as a stored table their size is known to the join, so no gram is shuffled to meet them.
    words = materialize(enriched_words(rows, by, width, max_motifs))
    instances = word_instances(rows.where(F.col("label") == 1), words, by, width, flank)
    symbols = "".join(sorted({c for a in alphabets for c in ALPHABETS[a]}))
    shares = M.symbol_frequencies(instances, [*by, "motif"], "seq", symbols)
    # At most max_motifs rows per group; as a stored table its size is known to the join.
    pwms = materialize(M.pwm_rows(shares, [*by, "motif"], symbols))
    scores = M.pfm_scan(rows, pwms, ["rec_id", "label"], by, "motif", top_n, alphabet=symbols)
    return scores.select(
        "dataset_id", "rec_id", "label", F.concat_ws("_", "alphabet", "motif").alias("feature"), "score"
    )


def feature_vectors(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A sparse vector for each record, and the table of what its places mean.

    The first is ``dataset_id, rec_id, class, places, scores`` with the non-zero scores in order of place,
    the second ``dataset_id, place, feature``: the features of a dataset in order of name, from 0.
    A record's vector has no more entries than its dataset has features.
    """
    names = materialize(features.select("dataset_id", "feature").distinct())
    order = W.partitionBy("dataset_id").orderBy("feature")
    places = materialize(names.withColumn("place", F.row_number().over(order) - 1))
    keys = ["dataset_id", "rec_id", F.col("label").alias("class")]
    entry = F.struct("place", "score")
    # Most scores are 0: a record has one row for them all, so that it has a vector, and one for each other score.
    some = features.where(F.col("score") != 0).join(places, ["dataset_id", "feature"]).select(*keys, entry.alias("entry"))
    named = features.where(F.col("dataset_id").isNotNull() & F.col("feature").isNotNull())
    none = named.select(*keys).distinct().withColumn("entry", F.lit(None).cast(some.schema["entry"].dataType))
    vectors = some.unionByName(none).groupBy("dataset_id", "rec_id", "class").agg(F.sort_array(F.collect_list("entry")).alias("e"))
    return vectors.select("dataset_id", "rec_id", "class", F.col("e.place").alias("places"), F.col("e.score").alias("scores")), places


def feature_matrix(features: DataFrame, names: list[str]) -> DataFrame:
    """Wide table with ``class`` 1/0 and one column per listed feature, joined by record."""
    return (
        features.groupBy("dataset_id", "rec_id", F.col("label").alias("class"))
        .pivot("feature", names)
        .agg(F.first("score"))
    )
