"""Position-wise sequence features, computed inside the row.

A record is one window, so all features of a window are array expressions over
its own string: no shuffle happens until a caller aggregates the long rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ribospan.functions import sequence as S
from ribospan.functions.core import col, let, positions
from ribospan.functions.scans import code_points
from ribospan.functions.special import letter_rows, list_array

WINDOW = 101

# Three chemistry channels per base.
CHEMISTRY = {"A": [1.0, 1.0, 1.0], "U": [0.0, 0.0, 1.0], "C": [0.0, 1.0, 0.0], "G": [1.0, 0.0, 0.0]}
# Dinucleotide property names and table, one row per dinucleotide.
DINUCLEOTIDE_PROPERTIES = [
    "shift", "slide", "rise", "tilt", "roll", "twist", "stacking_energy",
    "enthalpy", "entropy", "free_energy", "hydrophilicity",
]
DINUCLEOTIDES = {
    "AA": [-0.08, -1.27, 3.18, -0.8, 7, 31, -13.7, -6.6, -18.4, -0.93, 0.04],
    "AU": [-0.06, -1.36, 3.24, 1.1, 7.1, 33, -15.4, -5.7, -15.5, -1.1, 0.14],
    "AC": [0.23, -1.43, 3.24, 0.8, 4.8, 32, -13.8, -10.2, -26.2, -2.24, 0.14],
    "AG": [-0.04, -1.5, 3.3, 0.5, 8.5, 30, -14, -7.6, -19.2, -2.08, 0.08],
    "UA": [0.07, -1.7, 3.38, 1.3, 9.4, 32, -14.2, -13.3, -35.5, -2.35, 0.1],
    "UU": [0.23, -1.43, 3.24, 0.8, 4.8, 32, -13.8, -10.2, -26.2, -2.24, 0.27],
    "UC": [0.07, -1.39, 3.22, 0, 6.1, 35, -16.9, -14.2, -34.9, -3.42, 0.26],
    "UG": [-0.01, -1.78, 3.32, 0.3, 12.1, 32, -11.1, -12.2, -29.7, -3.26, 0.17],
    "CA": [0.11, -1.46, 3.09, 1, 9.9, 31, -14.4, -10.5, -27.8, -2.11, 0.21],
    "CU": [-0.04, -1.5, 3.3, 0.5, 8.5, 30, -14, -7.6, -19.2, -2.08, 0.52],
    "CC": [-0.01, -1.78, 3.32, 0.3, 8.7, 32, -11.1, -12.2, -29.7, -3.26, 0.49],
    "CG": [0.3, -1.89, 3.3, -0.1, 12.1, 27, -15.6, -8, -19.4, -2.36, 0.35],
    "GA": [-0.02, -1.45, 3.26, -0.2, 10.7, 32, -16, -8.1, -22.6, -1.33, 0.21],
    "GU": [-0.08, -1.27, 3.18, -0.8, 7, 31, -13.7, -6.6, -18.4, -0.93, 0.44],
    "GC": [0.07, -1.7, 3.38, 1.3, 9.4, 32, -14.2, -10.2, -26.2, -2.35, 0.48],
    "GG": [0.11, -1.46, 3.09, 1, 9.9, 31, -14.4, -7.6, -19.2, -2.11, 0.34],
}


def _lookup(table: dict[str, list[float]], key: Column) -> Column:
    pairs = [
        x
        for name, values in table.items()
        for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in values]))
    ]
    return F.try_element_at(F.create_map(*pairs), key)


def chemistry_features(rna: str | Column, length: int = WINDOW) -> Column:
    """Array of three channels over the sequence, padded to ``length`` positions; padding has only the last channel set."""
    return letter_rows(CHEMISTRY, [0.0, 0.0, 1.0], length)(col(rna))


def dinucleotide_features(rna: str | Column, length: int = WINDOW) -> Column:
    """Array of eleven properties / ``length`` over the sequence, padded to ``length`` positions; zeros without a pair."""
    scaled = {k: [v / length for v in row] for k, row in DINUCLEOTIDES.items()}
    zeros = F.array(*[F.lit(0.0)] * len(DINUCLEOTIDE_PROPERTIES))
    return let(
        rna,
        lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(length), F.length(s))),
            lambda i: F.when(
                i < F.length(s), _lookup(scaled, F.substr(s, i, F.lit(2)))
            ).otherwise(zeros),
        ),
    )


def _ties_rounded_up(length: int) -> list[tuple[int, int]]:
    """Counts c of i whose c/i is a decimal tie that binary rounding to 3 places takes upwards."""
    return [
        (c, i)
        for i in range(1, length + 1)
        for c in range(1, i + 1)
        if 2 * (1000 * c % i) == i and round(round(c / i, 3) * 1000) > 1000 * c // i
    ]


def running_shares(text: str) -> np.ndarray:
    """Share of the letter found at each position among the letters up to it, to three places.

    Rounded as the correctly rounded double is: only exact decimal ties depend on the binary
    value, and those are looked at one by one.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]]))
    count = np.empty(len(codes), np.int64)
    count[order] = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) + 1
    pos = np.arange(1, len(codes) + 1)
    down, rest = np.divmod(1000 * count, pos)
    share = (down + (2 * rest > pos)) / 1000.0
    for k in np.flatnonzero(2 * rest == pos).tolist():
        share[k] = round(int(count[k]) / (k + 1), 3)
    return share


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _running_shares(texts: pa.Array) -> pa.Array:
    known = [t or "" for t in texts.to_pylist()]
    sizes = np.array([len(t) for t in known], np.int64)
    symbols, codes = np.unique(code_points(known), return_inverse=True)
    out, starts = np.empty(len(codes)), np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == size)
        step = max(1, (1 << 20) // size)
        for k in range(0, len(mine), step):
            cells = starts[mine[k : k + step]][:, None] + np.arange(size)
            out[cells] = _kept_shares(codes[cells], len(symbols))
    return list_array(out, sizes, texts)


def nucleotide_density(rna: str | Column) -> Column:
    """Running share of the base found at each position of the sequence, in one pass over it."""
    return _running_shares(col(rna))


def kmer_position_features(rna: str | Column, k: int) -> Column:
    """Structs ``(pos, kmer, value)``: occurrences of the k-mer in its sequence / 100."""
    def counted(grams: Column, joined: Column) -> Column:
        # A k-mer cannot straddle the separator, so deleting it from the joined text counts
        # its (overlapping) occurrences: once for each distinct k-mer.
        count = lambda g: (F.length(joined) - F.length(F.replace(joined, g))) / F.lit(float(k)) / 100
        return let(F.array_distinct(grams), lambda d: F.map_from_arrays(d, F.transform(d, count)))

    def build(grams: Column) -> Column:
        counts = let(F.concat_ws("|", grams), lambda joined: counted(grams, joined))
        return let(
            counts,
            lambda m: F.transform(
                grams,
                lambda g, i: F.struct(i.alias("pos"), g.alias("kmer"), F.element_at(m, g).alias("value")),
            ),
        )

    return let(S.kmers(rna, k), build)


def _kept_shares(codes: np.ndarray, symbols: int = len(S.RNA)) -> np.ndarray:
    """:func:`running_shares` of texts of one length, given as rows of letter numbers."""
    pos = np.arange(1, codes.shape[1] + 1)
    if symbols > 16:
        order = np.argsort(codes, axis=1, kind="stable")
        ordered = np.take_along_axis(codes, order, 1)
        fresh = np.concatenate([np.ones((len(codes), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
        count = np.empty(codes.shape, np.int64)
        np.put_along_axis(count, order, pos - np.maximum.accumulate(np.where(fresh, pos - 1, 0), axis=1), 1)
    else:
        count = np.zeros(codes.shape, np.int64)
        for c in range(symbols):
            mine = codes == c
            np.copyto(count, np.cumsum(mine, axis=1), where=mine)
    down, rest = np.divmod(1000 * count, pos)
    share = (down + (2 * rest > pos)) / 1000.0
    row, at = np.nonzero(2 * rest == pos)
    if len(row):
        ties, which = np.unique(np.stack([count[row, at], at + 1], axis=1), axis=0, return_inverse=True)
        share[row, at] = np.array([round(int(c) / int(i), 3) for c, i in ties])[which.ravel()]
    return share


def _feature_cells(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pos, feature, value`` of texts of one length, a row a text, from rows of base numbers."""
    n, size = codes.shape
    padded, n_props = max(length, size), len(DINUCLEOTIDE_PROPERTIES)
    chemistry = np.zeros((n, padded, 3))
    chemistry[:, size:, 2] = 1.0
    chemistry[:, :size] = np.array([CHEMISTRY[c] for c in S.RNA])[codes]
    pairs = np.zeros((n, padded, n_props))
    table = np.array([[v / length for v in DINUCLEOTIDES[a + b]] for a in S.RNA for b in S.RNA])
    pairs[:, : max(size - 1, 0)] = table[codes[:, :-1] * len(S.RNA) + codes[:, 1:]]
    at, every = np.arange(size), np.arange(padded)
    pos = [np.repeat(every, 3), at, np.repeat(every, n_props)]
    feature = [np.tile(np.arange(3), padded), np.full(size, 3), np.tile(np.arange(4, 4 + n_props), padded)]
    feature = [np.broadcast_to(f, (n, len(f))) for f in feature]
    value = [chemistry.reshape(n, -1), _kept_shares(codes), pairs.reshape(n, -1)]
    offset = 4 + n_props
    for k in (1, 2, 3):
        many = max(size - k + 1, 0)
        index = np.zeros((n, many), np.int64)
        for j in range(k):
            index += codes[:, j : j + many] * 4**j
        cell = index + np.arange(n)[:, None] * 4**k
        pos.append(at[:many])
        feature.append(index + offset)
        value.append(np.bincount(cell.ravel(), minlength=n * 4**k)[cell] / 100)
        offset += 4**k
    pos = np.concatenate(pos)
    return np.broadcast_to(pos, (n, len(pos))), np.concatenate(feature, axis=1), np.concatenate(value, axis=1)


def encode_features(df: DataFrame, keys: list[str], length: int = WINDOW, most_cells: int = 200_000) -> DataFrame:
    """Long rows ``(keys, pos, feature, value)`` in the fixed column order 3 + 1 + 11 + 4 + 16 + 64.

    ``feature`` is the column number 0..98. K-mer rows are sparse (absent means 0). Records with a
    letter that no table lists have no rows. The texts of one length in a batch are encoded together,
    about ``most_cells`` rows at a time.
    """
    rows = df.select(*keys, S.normalize_rna("seq").alias("_rna"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "pos int, feature int, value double"
    number = np.full(256, len(S.RNA), np.int64)
    number[[ord(c) for c in S.RNA]] = np.arange(len(S.RNA))
    listed = set(S.RNA)

    def run(found):
        for batch in found:
            texts = batch.column("_rna").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, text in enumerate(texts):
                if text is not None and listed.issuperset(text):
                    by_size.setdefault(len(text), []).append(i)
            for size, members in by_size.items():
                step = max(1, most_cells // (14 * max(length, size) + 4 * size + 1))
                for a in range(0, len(members), step):
                    part = members[a : a + step]
                    text = "".join(texts[i] for i in part).encode()
                    pos, feature, value = _feature_cells(number[np.frombuffer(text, np.uint8)].reshape(len(part), size), length)
                    own = batch.select(keys).take(pa.array(np.repeat(part, value.shape[1])))
                    cells = [pa.array(pos.ravel(), pa.int32()), pa.array(feature.ravel().astype(np.int32)), pa.array(value.ravel())]
                    yield pa.RecordBatch.from_arrays([*own.columns, *cells], names=[*keys, "pos", "feature", "value"])

    return rows.mapInArrow(run, schema)


def importance_vector(attention: str | Column, k: int = 1) -> Column:
    """Per-token importance from ``heads x L x L`` attention: first rows summed over heads,
    spread over k-windows and averaged by coverage, L2-normalised."""
    def first_rows(heads: Column) -> Column:
        return F.transform(
            F.element_at(F.element_at(heads, 1), 1),
            lambda _x, i: F.aggregate(
                heads, F.lit(0.0), lambda a, h: a + F.element_at(F.element_at(h, 1), i + 1)
            ),
        )

    return let(first_rows(col(attention)), lambda row: smooth_scores(row, k))


def smooth_scores(row: str | Column, k: int) -> Column:
    """Mean of the k-window sums covering each position, L2-normalised."""
    def spread(v: Column) -> Column:
        if k == 1:
            return v
        n_windows = F.size(v) - (k - 1)
        sums = F.transform(
            positions(n_windows),
            lambda i: F.aggregate(F.slice(v, i, F.lit(k)), F.lit(0.0), lambda a, x: a + x),
        )

        def mean_cover(w: Column, i: Column) -> Column:
            first = F.greatest(i + 1 - (k - 1), F.lit(1))
            last = F.least(i + 1, F.size(w))
            cover = F.greatest(last - first + 1, F.lit(0))
            total = F.aggregate(F.slice(w, first, cover), F.lit(0.0), lambda a, x: a + x)
            return F.when(cover > 0, total / cover).otherwise(F.lit(0.0))

        return let(sums, lambda w: F.transform(v, lambda _x, i: mean_cover(w, i)))

    def normalise(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + F.lit(1e-12)
        return let(norm, lambda d: F.transform(v, lambda x: x / d))

    return let(spread(col(row)) if k == 1 else let(col(row), spread), normalise)


def one_hot_long(df: DataFrame, keys: list[str], max_len: int | None = None) -> DataFrame:
    """Non-zero one-hot cells ``(keys, pos, channel, value)``; padding shifts the positions."""
    rows = df.select(*keys, F.upper("seq").alias("_seq"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "pos int, channel string, value double"
    place = np.full(256, -1, np.int64)
    place[[ord(c) for c in [*S.DNA, "U"]]] = [*range(len(S.DNA)), S.DNA.index("T")]

    def run(found):
        names = pa.array(list(S.DNA))
        for batch in found:
            texts = [t or "" for t in batch.column("_seq").to_pylist()]
            for a in range(0, len(texts), 1024):
                part = texts[a : a + 1024]
                sizes = np.array([len(t) for t in part], np.int64)
                codes = place[np.minimum(code_points(part), 255)]
                kept = np.flatnonzero(codes >= 0)
                record = np.repeat(np.arange(len(part)), sizes)[kept]
                left = 0 if max_len is None else (max_len - sizes) // 2
                pos = kept + (left - (np.cumsum(sizes) - sizes))[record]
                own = batch.select(keys).take(pa.array(record + a))
                cells = [pa.array(pos.astype(np.int32)), names.take(pa.array(codes[kept])), pa.array(np.ones(len(kept)))]
                yield pa.RecordBatch.from_arrays([*own.columns, *cells], names=[*keys, "pos", "channel", "value"])

    return rows.mapInArrow(run, schema)
