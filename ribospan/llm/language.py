"""Multilingual language identification: mixture proportions by expectation-maximisation.

Each language is a distribution over character trigrams (letters, with word ends), learned from
labelled texts. A document is a mixture: every word is written in one of the languages, and EM
estimates the proportions from the words' likelihoods. Sets of languages are compared by
penalised likelihood (half the logarithm of the number of words for each further language): the
set grows by the language with the next largest share as long as that rises, however many there are.
The largest share in the chosen set is the prediction; :func:`predict` returns the set and its shares as well.

The score is the share that EM gives the predicted language among all languages: near 1 for a
text in one language, the language's part in a mixed one, lower for a few words that could be
written in several.

The model is fitted on about ``per_language`` labelled rows of each of the ``most_languages`` languages that
have the most labelled rows (both stated bounds), so its size does not grow with the corpus.

Edge cases: a null text and one without letters are ``und`` with score 0; ties go to the language
that sorts first; null ids are allowed, repeated rows keep a row each; without
labelled texts every document is ``und``; very long texts are taken whole, a batch at a time; extra columns,
whatever their names, are left out of the report and kept by :func:`keep_identified`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospan.llm.tokens import batches, release_encoders, release_memory

UNDETERMINED = "und"
CELLS = 1 << 16
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams around every letter, the starts of words among them, and each word's text."""
    lowered = [t.lower() for t in texts]
    joined = " " + " ".join(lowered) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    code = np.where(letter, points, 0).astype(np.uint32)
    mixed = code[:-2] * np.uint32(2654435761) + code[1:-1] * np.uint32(2246822519) + code[2:] * np.uint32(3266489917)
    cell = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(668265263) >> np.uint32(16)
    inner = letter[1:-1]
    starts = inner & ~letter[:-2]
    at = np.flatnonzero(inner)
    word_starts = np.flatnonzero(starts[at])
    bounds = np.cumsum([1] + [len(t) + 1 for t in lowered])
    owner = np.searchsorted(bounds, np.flatnonzero(starts) + 1, side="right") - 1
    return cell[at].astype(np.int64), word_starts, owner


def training_rows(docs: DataFrame, held_out: Column, per_language: int, most_languages: int, seed: int = 5) -> DataFrame:
    """``text, lang`` of the sample: about ``per_language`` rows of each language, by a hash of the row.

    Rows are counted by language first (a number for each of ``most_languages`` reaches the driver, as the model
    does); then each task decides on its own rows, and no row moves.
    """
    rows = docs.select(
        "text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.octet_length("text")).alias("h")
    ).where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return rows.select("text", "lang").limit(0)
    bound = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, per_language / r["n"]) * (1 << 31)))])
    return rows.where(F.pmod("h", F.lit(1 << 31)) < F.coalesce(F.try_element_at(bound, F.col("lang")), F.lit(0))).select("text", "lang")


def train(docs: DataFrame, held_out: Column, *, per_language: int = 3000, most_languages: int = 256, smoothing: float = 0.2) -> dict:
    """Log likelihoods of trigram cells, a row a language: ``{"languages": [...], "cells": array}``.

    Fitted on a sample of about ``per_language`` labelled rows of each language. Counting is spread over
    the tasks; what reaches the driver has at most one row a language and cell.
    """

    def count(found):
        for batch in found:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                cells, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                n = np.bincount(cells, minlength=CELLS)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])],
                    names=["lang", "cell", "n"],
                )

    sample = training_rows(docs, held_out, per_language, most_languages)
    counted = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    counts = np.zeros((len(languages), CELLS))
    if languages:
        row = np.searchsorted(languages, names.astype(str))
        counts[row, found.column("cell").to_numpy()] = found.column("n").to_numpy()
    odds = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * CELLS)
    return {"languages": languages, "cells": np.ascontiguousarray(odds.T, np.float32)}


def _mixture(weight: np.ndarray, allowed: np.ndarray, first: np.ndarray, owner: np.ndarray, steps: int) -> tuple:
    """EM over all documents of a batch: proportions and log likelihood.

    ``weight``: likelihoods of each word, relative to its best language; ``first``: where each
    document's words begin; ``allowed``: the languages in each document's set.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.diff(np.append(first, len(weight)))[:, None]
    for _ in range(steps):
        part = weight * share[owner]
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        share = np.add.reduceat(part, first, axis=0) / n
    like = np.log((weight * share[owner]).sum(axis=1) + 1e-30)
    return share, np.add.reduceat(like, first)


def mixtures(texts: list[str], model: dict, *, steps: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the languages in each text's set (0 outside), shares among all languages, log likelihood a letter.

    Rows of texts without letters are 0.
    """
    n, languages = len(texts), len(model["languages"])
    sets, shares, fit = np.zeros((n, languages)), np.zeros((n, languages)), np.zeros(n)
    cells, starts, owner = grams(texts)
    if not languages or not len(starts):
        return sets, shares, fit
    words = np.add.reduceat(model["cells"][cells], starts, axis=0).astype(np.float64)
    which, first, place = np.unique(owner, return_index=True, return_inverse=True)
    alone = np.add.reduceat(words, first, axis=0)
    best_word = words.max(axis=1, keepdims=True)
    weight = np.exp(words - best_word)
    count = np.diff(np.append(first, len(words)))
    share, _ = _mixture(weight, np.ones((len(which), languages)), first, place, steps)
    order = np.argsort(-share, axis=1, kind="stable")
    # The most likely single language, then sets of the languages with the largest shares while that pays.
    rows, top = np.arange(len(which)), np.argmax(alone, axis=1)
    ceiling = np.add.reduceat(best_word[:, 0], first)
    chosen = np.zeros((len(which), languages))
    chosen[rows, top] = 1.0
    value = alone[rows, top] - ceiling
    like, growing = value.copy(), rows
    for size in range(2, languages + 1):
        allowed = np.zeros((len(which), languages))
        np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
        own = np.isin(place, growing)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(place[own]) > 0]))
        local = np.repeat(np.arange(len(growing)), np.diff(np.append(begin, own.sum())))
        found, log_like = _mixture(weight[own], allowed[growing], begin, local, steps)
        penalised = log_like - 0.5 * (size - 1) * np.log(count[growing])
        better = penalised > value[growing]
        # Two languages may both be needed where neither pays alone, so a set gets a second chance.
        chosen[growing[better]], value[growing[better]], like[growing[better]] = found[better], penalised[better], log_like[better]
        growing = growing[better | (size < 3)]
        if not len(growing):
            break
    letters = np.diff(np.append(starts[first], len(cells)))
    sets[which], shares[which], fit[which] = chosen, share, (like + ceiling) / letters
    return sets, shares, fit


def infer(texts: list[str], model: dict, **options) -> tuple[np.ndarray, np.ndarray]:
    """Index of the predicted language (-1: undetermined) and score of each text."""
    sets, shares, _ = mixtures(texts, model, **options)
    some = sets.sum(axis=1, initial=0.0) > 0 if sets.size else np.zeros(len(texts), bool)
    pick = np.argmax(sets, axis=1) if sets.size else np.zeros(len(texts), np.int64)
    score = np.minimum(1.0, shares[np.arange(len(texts)), pick]) if sets.size else np.zeros(len(texts))
    return np.where(some, pick, -1), np.where(some, score, 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score, languages, shares`` of every row; only ``text`` is an input.

    ``languages`` are those of the document's set, the largest share first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_languages x 65,536 cells at most, whatever the corpus

    def run(found):
        known = shared.value
        names = np.array([*known["languages"], UNDETERMINED], dtype=object)
        release_encoders()
        for batch in found:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, listed, parts = [], [], [], []
            for i, j in batches(texts):
                sets, shares, _ = mixtures(texts[i:j], known)
                for row, all_shares in zip(sets, shares, strict=True):
                    order = [k for k in np.argsort(-row, kind="stable").tolist() if row[k] > 0]
                    langs.append(names[order[0]] if order else UNDETERMINED)
                    scores.append(min(1.0, float(all_shares[order[0]])) if order else 0.0)
                    listed.append([names[k] for k in order])
                    parts.append([float(row[k]) for k in order])
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            columns += [pa.array(listed, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "languages", "shares"])
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out_key(doc_id: str = "doc_id") -> Column:
    """The fold: documents whose crc32 of the id as text leaves 2 on division by 4 are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Predict every row of ``docs(doc_id, text, lang)`` by a model of the rows that are not held out."""
    model = train(docs, held_out_key(), **options)
    return predict(docs, model).select("doc_id", held_out_key().alias("held_out"), "lang_pred", "score", "languages", "shares")


#: Log likelihood a letter of a text whose trigrams are drawn from all cells alike.
BLIND = -float(np.log(CELLS))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are written in some of the languages, alone or mixed; all columns kept.

    Rejected are documents without letters, and those whose best set of languages makes them no likelier
    than blind chance over the cells.
    """
    model = train(docs, F.lit(False), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        release_encoders()
        values = [t or "" for t in texts]
        out = [np.empty(0, bool)]
        for i, j in batches(values):
            sets, _, fit = mixtures(values[i:j], shared.value)
            out.append((sets.sum(axis=1) > 0) & (fit > BLIND))
        del values
        release_memory()
        return pd.Series(np.concatenate(out))

    return docs.where(kept(F.col("text")))
