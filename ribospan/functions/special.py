"""Arrow-batched helpers for what Column expressions cannot do, or only position by position.

The tail probabilities run on already aggregated rows (one per motif or group). The structure
states run on records, a whole batch per array operation.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

# The helpers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeom_upper(x: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= x) for ``drawn`` draws from ``total`` items of which ``marked`` count."""
    lo, hi = max(0, drawn - (total - marked)), min(marked, drawn)
    if x <= lo:
        return 1.0
    if x > hi:
        return 0.0

    def tail(start: int, stop: int, step: int) -> float:
        """Sum of the mass from ``start`` towards ``stop``, until terms stop mattering."""
        log_p = (
            _log_choose(marked, start)
            + _log_choose(total - marked, drawn - start)
            - _log_choose(total, drawn)
        )
        term = acc = math.exp(log_p)
        k = start
        while k != stop:
            if step > 0:
                term *= (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))
            else:
                term *= k * (total - marked - drawn + k) / ((marked - k + 1) * (drawn - k + 1))
            k += step
            acc += term
            if term < acc * 1e-18:
                break
        return acc

    mode = (drawn + 1) * (marked + 1) // (total + 2)
    if x > mode:
        return min(1.0, tail(x, hi, 1))
    return max(0.0, 1.0 - tail(x - 1, lo, -1))


def hypergeom_uppers(x: np.ndarray, total: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """:func:`hypergeom_upper` of every row, a term of all open sums at a time."""
    lo, hi = np.maximum(0, drawn - (total - marked)), np.minimum(marked, drawn)
    out = np.where(x <= lo, 1.0, 0.0)
    rows = np.flatnonzero((x > lo) & (x <= hi))
    x, total, marked, drawn = (v[rows] for v in (x, total, marked, drawn))
    up = x > (drawn + 1) * (marked + 1) // (total + 2)
    start = np.where(up, x, x - 1)

    def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        each, which = np.unique(np.concatenate([n, k, n - k]), return_inverse=True)
        a, b, c = np.array([math.lgamma(v + 1) for v in each.tolist()])[which].reshape(3, -1)
        return a - b - c

    if not len(rows):
        return out
    term = np.exp(log_choose(marked, start) + log_choose(total - marked, drawn - start) - log_choose(total, drawn))
    sums, acc = np.zeros(len(rows)), term.copy()
    # Upwards the next term has (marked - k)(drawn - k) over (k + 1)(rest + k + 1), downwards k (rest + k) over
    # (marked - k + 1)(drawn - k + 1). Both are products (a - s)(b - s) / (c + s)(d + s) in the steps s, and 0 from the last term on.
    rest = total - marked - drawn
    a, b = np.where(up, marked - start, start).astype(float), np.where(up, drawn - start, rest + start).astype(float)
    c, d = np.where(up, start + 1, marked - start + 1).astype(float), np.where(up, rest + start + 1, drawn - start + 1).astype(float)
    live, s = np.arange(len(rows)), 0
    while len(live):
        for _ in range(16):
            term = term * ((np.maximum(a - s, 0) * np.maximum(b - s, 0)) / ((c + s) * (d + s)))
            acc = acc + term
            s += 1
        on = term >= acc * 1e-18
        on &= term > 0
        sums[live[~on]] = acc[~on]
        live, term, acc, a, b, c, d = (v[on] for v in (live, term, acc, a, b, c, d))
    out[rows] = np.where(up, np.minimum(1.0, sums), np.maximum(0.0, 1.0 - sums))
    return out


@F.pandas_udf(DoubleType())
def hypergeom_sf(x: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_uppers(*(v.astype("int64").to_numpy() for v in (x, total, marked, drawn))), dtype=float)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype(float)


def rank_sum_exact(w: float, n1: int, n2: int) -> float:
    """Two-sided exact p of a tie-free rank-sum statistic (small groups only)."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        for s in range(n1 * n2, n2 + i - 1, -1):
            ways[s] -= ways[s - n2 - i]
        for s in range(i, n1 * n2 + 1):
            ways[s] += ways[s - i]
    cdf = np.cumsum(ways) / ways.sum()
    w = int(round(w))
    tail = 1.0 - (cdf[w - 1] if w > 0 else 0.0) if w > n1 * n2 / 2 else cdf[w]
    return float(min(1.0, 2.0 * tail))


@F.pandas_udf(DoubleType())
def rank_sum_p(w: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """R's default: exact below 50 per group without ties, else normal with continuity correction."""
    def p_value(w: float, n1: float, n2: float, ties: float) -> float:
        if n1 == 0 or n2 == 0:
            return float("nan")
        if n1 < 50 and n2 < 50 and ties == 0:
            return rank_sum_exact(w, int(n1), int(n2))
        n = n1 + n2
        spread = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1))))
        shift = w - n1 * n2 / 2.0
        if spread == 0:
            return float("nan")
        z = (shift - math.copysign(0.5, shift) * (shift != 0)) / spread
        return min(1.0, math.erfc(abs(z) / math.sqrt(2.0)))

    return pd.Series([p_value(*row) for row in zip(w, n1, n2, ties)], dtype=float)


def regularized_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularized_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            c = 1.0 + coefficient / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h / a


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    def p_value(t: float, dof: float) -> float:
        if dof < 1 or math.isnan(t):
            return float("nan")
        if math.isinf(t):
            return 0.0
        return regularized_beta(dof / 2.0, 0.5, dof / (dof + t * t))

    return pd.Series([p_value(a, b) for a, b in zip(t, dof)], dtype=float)


@F.pandas_udf(StringType())
def dot_bracket_states(structure: pd.Series) -> pd.Series:
    """Seven-state strings of balanced dot-bracket strings, all records of a batch at once."""
    text = "|".join(structure.fillna("")) + "||"
    ch = np.frombuffer(text.encode(), dtype=np.uint8)
    opening, closing, end = (ch == ord(c) for c in "()|")
    depth_after = np.cumsum(opening.astype(np.int64) - closing)
    if depth_after.min() < 0 or depth_after[end].any():
        raise ValueError("unbalanced dot-bracket string")
    at = np.arange(len(ch))
    # Brackets of one depth alternate, so neighbours in depth order are partners.
    brackets = np.flatnonzero(opening | closing)
    depth = (depth_after + closing)[brackets]
    paired = brackets[np.argsort(depth, kind="stable")]
    mate = at.copy()
    mate[paired[0::2]], mate[paired[1::2]] = paired[1::2], paired[0::2]
    # Nearest bracket or record end strictly before and after each position.
    stop = opening | closing | end
    last = len(ch) - 1
    k = np.append(last, np.maximum.accumulate(np.where(stop, at, -1))[:-1])
    k[k < 0] = last
    m = np.append(np.minimum.accumulate(np.where(stop, at, last)[::-1])[::-1][1:], last)
    past, before = ch[m[mate[m]]], ch[k[mate[k]]]
    inner_left, inner_right = opening[k] & opening[m], closing[k] & closing[m]
    state = np.select(
        [
            end, opening, closing, end[k] | end[m], opening[k] & closing[m],
            closing[k] & opening[m] & (depth_after > 0), closing[k] & opening[m],
            mate[m] + 1 == mate[k],
            (inner_left & (past == ord("("))) | (inner_right & (before == ord(")"))),
        ],
        [ord(c) for c in "|LREHMEBM"],
        ord("T"),
    )
    out = state.astype(np.uint8).tobytes().decode().split("|")[: len(structure)]
    return pd.Series(out, index=structure.index).where(structure.notna(), None)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, and where each of them begins and the last one ends; a null is empty."""
    text = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def byte_texts(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts that :func:`text_bytes` takes apart."""
    if ends[-1] >= 1 << 31:
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw)).cast(pa.string())
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with every byte replaced by what ``table`` has for it; a null remains."""
    raw, ends = text_bytes(texts)
    out = byte_texts(table[raw], ends)
    return pa.compute.if_else(texts.is_valid(), out, pa.scalar(None, pa.string())) if texts.null_count else out


def byte_table(letters: str, become: str) -> np.ndarray:
    """For :func:`translated`: each of ``letters`` becomes the one of ``become`` at its place, other bytes remain."""
    table = np.arange(256, dtype=np.uint8)
    table[[ord(c) for c in letters]] = [ord(c) for c in become]
    return table


def base_state_texts(bases: str, states: str, letters: str):
    """A function of Arrow arrays of base strings and state strings: the letter of each pair, all records of a batch at once.

    ``letters`` is base-major. A base string that is too short counts as the first base from there
    on; a base or state that is not listed counts as the one before the first, and letters before the
    first are taken from the end. A record with a null is an empty text.
    """
    place = np.zeros((2, 256), np.int64)
    for row, symbols in zip(place, (bases, states), strict=True):
        for i, c in enumerate(symbols):
            row[ord(c)] = i + 1
    numbers = (np.arange(len(bases) + 1)[:, None] - 1) * len(states) + np.arange(len(states) + 1)
    table = np.frombuffer(letters.encode(), np.uint8)[np.where(numbers > 0, numbers - 1, numbers)]
    every = table[place[0][:, None], place[1]].ravel()  # of a byte of either

    def codes(parts: list[str]) -> np.ndarray:
        return np.minimum(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4"), 255)

    def spelled(seq: pa.Array, state: pa.Array) -> pa.Array:
        if not (seq.null_count or state.null_count):
            (above, ends), (below, same) = text_bytes(seq), text_bytes(state)
            if np.array_equal(ends, same) and max(above.max(initial=0), below.max(initial=0)) < 128:
                return byte_texts(every[above.astype(np.uint16) << 8 | below], ends)
        seq, state = seq.to_pylist(), state.to_pylist()
        known = [s is not None and t is not None for s, t in zip(seq, state, strict=True)]
        below = [t if k else "" for t, k in zip(state, known, strict=True)]
        above = [s[: len(t)].ljust(len(t), bases[0]) if k else "" for s, t, k in zip(seq, below, known, strict=True)]
        return byte_texts(table[place[0][codes(above)], place[1][codes(below)]], np.cumsum([0, *map(len, below)]))

    return spelled


def base_state_letters(bases: str, states: str, letters: str):
    """:func:`base_state_texts` as a function of columns."""
    return F.arrow_udf(StringType())(base_state_texts(bases, states, letters))


def word_numbers(letters: str, width: int, read_as: dict[str, str] | None = None):
    """A function of a text: occurrences of every word over ``letters`` (ASCII), the first letter changing fastest; a null has none.

    A letter in ``read_as`` counts as the one it stands for.
    """
    place = np.full(256, -1, np.int32)
    place[[ord(c) for c in letters]] = np.arange(len(letters))
    for c, known in (read_as or {}).items():
        place[ord(c)] = letters.index(known)
    many = len(letters) ** width

    @F.arrow_udf(ArrayType(DoubleType()))
    def count(texts: pa.Array) -> pa.Array:
        # Letters that are no bytes of their own in UTF-8 count in no word, nor do their bytes.
        text = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        codes = place[raw]
        record = np.repeat(np.arange(len(text)), np.diff(ends))
        n = max(len(codes) - width + 1, 0)
        word, whole = record[:n] * many, record[:n] == record[width - 1 :][:n]
        for j in range(width):
            word += codes[j : j + n] * len(letters) ** j
            whole &= codes[j : j + n] >= 0
        cells = np.bincount(word[whole], minlength=len(text) * many).astype(float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * many), pa.array(cells))

    return count


def listed_words(words: list[str], width: int, most_cells: int = 1 << 22):
    """A function of a text: occurrences of each of ``words``, all of ``width`` letters and different; null for a null.

    The words are a trie whose steps are tables, so that the words of a batch of texts are found by a look-up a letter.
    """
    symbols = sorted({ord(c) for w in words for c in w})
    place = np.full(symbols[-1] + 2, -1, np.int64)  # the last one stands for all greater letters
    place[symbols] = np.arange(len(symbols))
    steps, level = [], {"": 0}
    for j in range(width):
        heads = {h: i for i, h in enumerate(dict.fromkeys(w[: j + 1] for w in words))}
        table = np.full(len(level) * len(symbols), -1, np.int64)
        for h, i in heads.items():
            table[level[h[:-1]] * len(symbols) + place[ord(h[-1])]] = i
        steps.append(table)
        level = heads

    def count(texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t) + 1 for t in texts])
        codes = place[np.minimum(np.frombuffer(("|".join(texts) + "|").encode("utf-32-le", "surrogatepass"), "<u4"), symbols[-1] + 1)]
        codes[np.cumsum(sizes) - 1] = -1  # no word reaches into the next text
        n = max(len(codes) - width + 1, 0)
        at = np.zeros(n, np.int64)
        for j, table in enumerate(steps):
            letter = codes[j : j + n]
            at = np.where((at >= 0) & (letter >= 0), table[at * len(symbols) + letter], -1)
        cell = np.repeat(np.arange(len(texts)) * len(words), sizes)[:n] + at
        return np.bincount(cell[at >= 0], minlength=len(texts) * len(words))

    @F.arrow_udf(ArrayType(DoubleType()))
    def counts(texts: pa.Array) -> pa.Array:
        known, step = [t or "" for t in texts.to_pylist()], max(1, most_cells // len(words))
        parts = [count(known[k : k + step]) for k in range(0, len(known), step)]
        return list_array(np.concatenate([np.empty(0, np.int64), *parts]).astype(float), np.full(len(known), len(words)), texts)

    return counts


def list_array(values, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    """An array of lists of the given sizes, null where ``like`` is."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(offsets, values, mask=like.is_null() if like.null_count else None)


def true_runs(masks: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of true of ``least`` or more in arrays of booleans, half-open; a null has none."""
    flat = masks.flatten()
    sizes = np.asarray(masks.value_lengths().fill_null(0), np.int64)
    on, off = (np.asarray(m.fill_null(False)) for m in (flat, pa.compute.invert(flat)))
    record = np.repeat(np.arange(len(sizes)), sizes)
    edge = np.ones(len(record) + 1, bool)
    edge[1:-1] = record[1:] != record[:-1]
    # A run begins after a false and ends before one; a null next to it leaves it open.
    starts = np.flatnonzero(on & (edge[:-1] | np.concatenate([[False], off])[:-1]))
    ends = np.flatnonzero(on & (edge[1:] | np.concatenate([off, [False]])[1:]))
    first, last = (np.searchsorted(record[x], np.arange(len(sizes) + 1)) for x in (starts, ends))
    paired = np.minimum(np.diff(first), np.diff(last))  # the k-th start with the k-th end
    nth = np.arange(paired.sum()) - np.repeat(np.cumsum(paired) - paired, paired)
    owner = np.repeat(np.arange(len(sizes)), paired)
    begins = (np.cumsum(sizes) - sizes)[owner]
    start, end = starts[first[owner] + nth] - begins, ends[last[owner] + nth] + 1 - begins
    long = end - start >= least
    return owner[long], start[long], end[long]


def vocabulary_ids(vocabulary: list[str], unknown: int):
    """A function of an array of tokens: the place of each in the vocabulary, else ``unknown``; null for a null."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(tokens: pa.Array) -> pa.Array:
        at = pa.compute.index_in(tokens.flatten(), pa.array(vocabulary, tokens.type.value_type))
        sizes = np.asarray(tokens.value_lengths().fill_null(0))
        return list_array(at.fill_null(unknown).cast(pa.int32()), sizes, tokens)

    return ids


def centred_track(letters: str, max_len: int | None, weighted: bool):
    """A function of a text (and its weights): the weight (1) at each place with one of ``letters``, else 0, centred in ``max_len``; empty for a null."""
    wanted = [ord(c) for c in letters]

    def fill(texts: pa.Array, weights: pa.Array | None) -> pa.Array:
        known = [t or "" for t in texts.to_pylist()]
        sizes = np.array([len(t) for t in known], np.int64)
        room = np.maximum((max_len or 0) - sizes, 0) * np.asarray(texts.is_valid())
        left, whole = room // 2, sizes + room
        points = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), "<u4")
        hot = np.flatnonzero(np.logical_or.reduce([points == c for c in wanted]))
        record = np.repeat(np.arange(len(sizes)), sizes)[hot]
        at = hot - (np.cumsum(sizes) - sizes)[record]
        cell = (np.cumsum(whole) - whole + left)[record] + at
        values, missing = np.zeros(whole.sum()), np.zeros(whole.sum(), bool)
        if weights is None:
            values[cell] = 1.0
        else:
            given = np.asarray(weights.value_lengths().fill_null(0), np.int64)
            absent = np.asarray(weights.is_null())[record]
            if (~absent & (at >= given[record])).any():
                raise ValueError("a text has more letters than weights")
            flat = weights.flatten()
            place = ((np.cumsum(given) - given)[record] + at)[~absent]
            missing[cell[absent]] = True
            values[cell[~absent]] = np.asarray(flat.fill_null(0.0))[place]
            missing[cell[~absent]] = np.asarray(flat.is_null())[place]
        offsets = pa.array(np.concatenate([[0], np.cumsum(whole)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(values, mask=missing if missing.any() else None))

    if weighted:

        @F.arrow_udf(ArrayType(DoubleType()))
        def track(texts: pa.Array, weights: pa.Array) -> pa.Array:
            return fill(texts, weights)

    else:

        @F.arrow_udf(ArrayType(DoubleType()))
        def track(texts: pa.Array) -> pa.Array:
            return fill(texts, None)

    return track


def letter_rows(table: dict[str, list[float]], padding: list[float], length: int):
    """A function of a text: the row of ``table`` of each letter, null for others, then ``padding`` up to ``length``; nulls for a null."""
    rows = np.array([[0.0] * len(padding), *table.values(), padding])
    place = np.zeros(256, np.int64)
    place[[ord(c) for c in table]] = np.arange(1, len(table) + 1)

    @F.arrow_udf(ArrayType(ArrayType(DoubleType())))
    def cells(texts: pa.Array) -> pa.Array:
        known = texts.to_pylist()
        sizes = np.array([length if t is None else len(t) for t in known], np.int64)
        whole = np.maximum(sizes, length)
        number = np.full(whole.sum(), len(rows) - 1)
        points = np.frombuffer("".join("\x00" * length if t is None else t for t in known).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.arange(len(points)) + np.repeat(np.cumsum(whole) - whole - (np.cumsum(sizes) - sizes), sizes)
        number[inside] = np.where(points < 256, place[np.minimum(points, 255)], 0)
        width = rows.shape[1]
        offsets = pa.array(np.arange(len(number) + 1, dtype=np.int32) * width)
        inner = pa.ListArray.from_arrays(offsets, pa.array(rows[number].ravel()), mask=pa.array(number == 0) if (number == 0).any() else None)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(whole)]).astype(np.int32)), inner)

    return cells


@F.arrow_udf(StructType().add("total", DoubleType()).add("present", LongType()))
def track_sums(tracks: pa.Array) -> pa.Array:
    """Sum of a track and the number of its values above 0; a null has neither."""
    values = np.asarray(tracks.flatten().fill_null(0.0), float)
    ends = np.concatenate([[0], np.cumsum(np.asarray(tracks.value_lengths().fill_null(0)))])
    record = np.repeat(np.arange(len(tracks)), np.diff(ends))
    total = np.bincount(record, values, len(tracks))
    present = np.bincount(record[values > 0], minlength=len(tracks))
    return pa.StructArray.from_arrays([pa.array(total), pa.array(present)], names=["total", "present"])
