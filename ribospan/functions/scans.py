"""Word automata and stacked PWMs that go over many records at once, one array operation a position or word."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The helpers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1 << 22


def _padded(texts: list[bytes], code: np.ndarray) -> np.ndarray:
    """Letter codes, a row a text, filled up with 0."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(lengths.max(initial=0))), code.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = code[np.frombuffer(b"".join(texts), np.uint8)]
    return out


def _portions(texts: list[bytes]):
    """Row numbers of the texts in order of length, cut so that a padded portion has a bounded size."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(lengths, kind="stable")[::-1]
    start = 0
    while start < len(order):
        rows = max(1, CELLS // max(1, int(lengths[order[start]])))
        yield order[start : start + rows]
        start += rows


class Automaton:
    """Aho-Corasick transitions of distinct non-empty words, built level by level.

    ``delta[state, letter]`` is complete, so a step never looks back. ``first`` is the nearest state at
    or behind a state that ends a word (0: none), ``behind`` the next one after that, ``word`` the
    word that a state ends.
    """

    def __init__(self, words: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        letters = np.unique(flat)
        self.code = np.zeros(256, np.int32)  # 0: a letter that no word has
        self.code[letters] = np.arange(1, len(letters) + 1)
        width, self.words = len(letters) + 1, len(words)
        at, levels, n = np.zeros(len(words), np.int64), [], 1
        for depth in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > depth)
            steps, which = np.unique(at[on] * width + self.code[flat[starts[on] + depth]], return_inverse=True)
            levels.append((steps // width, steps % width, n + np.arange(len(steps))))
            at[on] = n + which
            n += len(steps)
        self.delta = np.zeros((n, width), np.int32)
        self.word = np.full(n, -1, np.int64)
        self.word[at] = np.arange(len(words))
        self.first, self.behind, fail = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
        for parent, letter, state in levels:
            fail[state] = np.where(parent > 0, self.delta[fail[parent], letter], 0)
            self.delta[parent, letter] = state
            self.delta[state] = self.delta[fail[state]]
            self.behind[state] = self.first[fail[state]]
            self.first[state] = np.where(self.word[state] >= 0, state, self.behind[state])

    def counts(self, texts: list[bytes], marked: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each word the texts that contain it (or with ``every`` its places), all and in marked texts."""
        total, in_marked = np.zeros(self.words, np.int64), np.zeros(self.words, np.int64)
        for rows in _portions(texts):
            codes = _padded([texts[k] for k in rows], self.code)
            state, keys = np.zeros(len(rows), np.int32), []
            for place in range(codes.shape[1]):
                state = self.delta[state, codes[:, place]]
                hit = self.first[state]
                row = np.flatnonzero(hit)
                hit = hit[row]
                while len(row):
                    keys.append(row * self.words + self.word[hit])
                    hit = self.behind[hit]
                    row, hit = row[hit > 0], hit[hit > 0]
                if sum(map(len, keys[-8:])) > CELLS or len(keys) > 4096:
                    keys = [np.concatenate(keys) if every else np.unique(np.concatenate(keys))]
            if keys:
                found = np.concatenate(keys)
                found = found if every else np.unique(found)
                word, sign = found % self.words, marked[rows[found // self.words]]
                total += np.bincount(word, minlength=self.words)
                in_marked += np.bincount(word[sign], minlength=self.words)
        return total, in_marked


class StackedPwms:
    """PWMs of one width as tables of the products over short words, and a scan over them."""

    def __init__(self, matrices: np.ndarray, alphabet: str, most_rows: int = 4096) -> None:
        """``matrices``: motif x position x letter; any other letter, like one that no motif has, has probability 0."""
        used = np.flatnonzero((matrices != 0).any(axis=(0, 1)))
        matrices, alphabet = matrices[:, :, used], [alphabet.encode()[k] for k in used]
        motifs, self.width, letters = matrices.shape
        self.code = np.full(256, letters, np.int64)
        for k, letter in enumerate(alphabet):
            self.code[letter] = k
        self.letters, span = letters + 1, 1
        while span < self.width and (letters + 1) ** (span + 1) <= most_rows:
            span += 1
        full = np.concatenate([matrices, np.zeros((motifs, self.width, 1))], axis=2)
        self.cuts = [(k, min(k + span, self.width)) for k in range(0, self.width, span)]
        self.tables = []
        for a, b in self.cuts:
            table = np.ones((1, motifs))
            for k in range(a, b):
                table = (table[:, None, :] * full[:, k, :].T[None, :, :]).reshape(-1, motifs)
            self.tables.append(table)
        # The best that the words after each one can add.
        self.rest = [np.ones(motifs)]
        for table in self.tables[:0:-1]:
            self.rest.insert(0, self.rest[0] * table.max(axis=0))

    def _word_codes(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each cut the numbers of the words, a row a window."""
        windows, out = codes.shape[1] - self.width + 1, []
        codes = np.ascontiguousarray(codes.T, np.int32)  # a table has few rows
        for a, b in self.cuts:
            word = np.zeros((windows, len(codes[0])), np.int32)
            for k in range(a, b):
                word *= self.letters
                word += codes[k : k + windows]
            out.append(word)
        return out

    def top_sums(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Sum of the ``n`` best windows of each row of letter codes for each motif; 0 with fewer windows.

        Windows are taken one after another, for all rows and motifs at once. After each word of a window
        only those (row, motif) go on whose best possible rest would beat the least of their ``n``.
        """
        motifs = self.tables[0].shape[1]
        windows = codes.shape[1] - self.width + 1
        if windows < n:
            return np.zeros((len(codes), motifs))
        words = self._word_codes(codes)
        best = np.zeros((n, len(codes) * motifs))
        for w in range(windows):
            score = self.tables[0].take(words[0][w], axis=0)
            cell = np.flatnonzero((score * self.rest[0]).ravel() > best[-1])
            score = score.ravel()[cell]
            for k in range(1, len(words)):
                if k > 1:
                    on = score * self.rest[k - 1][cell % motifs] > best[-1][cell]
                    cell, score = cell[on], score[on]
                row, motif = np.divmod(cell, motifs)
                score = score * self.tables[k][words[k][w][row], motif]
            for k in range(n):
                known = best[k][cell]
                best[k][cell] = np.maximum(known, score)
                score = np.minimum(known, score)
        return best.sum(axis=0).reshape(len(codes), motifs)


def stacked_top_sums(texts: list[bytes], matrices: list, alphabet: str, n: int) -> np.ndarray:
    """Sum of the ``n`` best windows of each text for each PWM of ``matrices`` (each position x letter)."""
    out = np.zeros((len(texts), len(matrices)))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    widths = np.fromiter(map(len, matrices), np.int64, len(matrices))
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        stacked = StackedPwms(np.stack([np.stack(matrices[k]) for k in own]).astype(float), alphabet)
        for length in np.unique(lengths[lengths >= width + n - 1]).tolist():
            rows = np.flatnonzero(lengths == length)
            step = max(1, (1 << 16) // len(own))  # what a window touches stays in the cache
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                codes = stacked.code[np.frombuffer(b"".join([texts[j] for j in part]), np.uint8)].reshape(len(part), length)
                out[np.ix_(part, own)] = stacked.top_sums(codes, n)
    return out


def _shares(matrices: list, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares (matrix x column x letter) of matrices of one width, the means of their columns and the squares around these, -1 where a share is missing."""
    rows = [[[*(c or [])[:letters], *[None] * (letters - len(c or []))] for c in m] for m in matrices]
    shares = np.array(rows, float)
    total, squares = shares[..., 0], shares[..., 0] * shares[..., 0]
    for j in range(1, letters):
        total, squares = total + shares[..., j], squares + shares[..., j] * shares[..., j]
    mean = total / letters
    whole = np.array([[None not in c for c in m] for m in rows])
    return shares, mean, np.where(whole, squares - mean * mean * letters, -1.0)


def best_offsets(queries: list, targets: list, letters: int, min_overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarity, offset and overlap (query x target) of the offset with the largest mean correlation of columns, the first of equal ones.

    Both sides are matrices, position x letter. The overlap is 0 where no offset has ``min_overlap`` columns; a column
    that is flat, or that lacks a share, correlates with nothing.
    """
    shape = len(queries), len(targets)
    best, offset, overlap = np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    q_widths, t_widths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (queries, targets))
    least = max(min_overlap, 1)
    for wide in np.unique(t_widths[t_widths >= least]).tolist():
        t = np.flatnonzero(t_widths == wide)
        b, mean_b, around_b = _shares([targets[k] for k in t], letters)
        for width in np.unique(q_widths[q_widths >= least]).tolist():
            rows = np.flatnonzero(q_widths == width)
            step = max(1, CELLS // (len(t) * wide * width))
            for k in range(0, len(rows), step):
                q = rows[k : k + step]
                a, mean_a, around_a = (x[:, :, None, None] for x in _shares([queries[j] for j in q], letters))
                with np.errstate(invalid="ignore", divide="ignore"):
                    cross = a[..., 0] * b[..., 0]
                    for j in range(1, letters):
                        cross = cross + a[..., j] * b[..., j]
                    cross = (cross - mean_a * mean_b * letters) / np.sqrt(around_a * around_b)
                cross[(around_a <= 1e-12) | (around_b <= 1e-12)] = 0.0
                top, at, n = np.zeros((len(q), len(t))), np.zeros((len(q), len(t)), np.int32), np.zeros((len(q), len(t)), np.int32)
                for o in range(1 - wide, width):
                    first, last = max(0, o), min(width, wide + o)
                    if last - first < least:
                        continue
                    mean = sum(cross[:, i, :, i - o] for i in range(first, last)) / (last - first)
                    better = (n == 0) | (mean > top) | (np.isnan(mean) & ~np.isnan(top))
                    top[better], at[better], n[better] = mean[better], o, last - first
                where = np.ix_(q, t)
                best[where], offset[where], overlap[where] = top, at, n
    return best, offset, overlap


def code_points(texts: list[str]) -> np.ndarray:
    """The code points of the texts, one text after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def spelled_texts(points: np.ndarray) -> pa.Array:
    """The text of each row of code points."""
    n, width = points.shape
    if n and points.max() < 128:
        ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
        return pa.StringArray.from_buffers(n, ends, pa.py_buffer(points.astype(np.uint8).tobytes()))
    return pa.array(["".join(map(chr, row)) for row in points.tolist()], pa.string())


def first_words(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Record, place from 0 and text of the first of each different word of ``width`` letters in each text."""
    points = code_points(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    many = np.maximum(sizes - width + 1, 0)
    record = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many)
    starts = at + np.repeat(np.cumsum(sizes) - sizes, many)
    symbols, codes = np.unique(points, return_inverse=True)
    longest = int(sizes.max(initial=0)) + 1
    if len(symbols) ** width * len(texts) * longest < 1 << 62:
        ids, bound = np.zeros(len(starts), np.int64), len(symbols) ** width
        for j in range(width):
            ids = ids * len(symbols) + codes[starts + j]
    else:
        different, ids = np.unique(points[starts[:, None] + np.arange(width)], axis=0, return_inverse=True)
        ids, bound = ids.ravel(), len(different)
    found = np.sort((record * bound + ids) * longest + at)
    word = found // longest
    found = found[np.concatenate([[True], word[1:] != word[:-1]])[: len(found)]]
    record, at = found // longest // bound if len(found) else found, found % longest
    return record, at, spelled_texts(points[(np.cumsum(sizes) - sizes)[record][:, None] + at[:, None] + np.arange(width)])


BYTE_BITS = 7  # a letter of ASCII


class WordSums:
    """For each (group, word) the records and marked records that hold the word, added up over batches of ASCII texts.

    A place is one number (group, word, record), so that one sort of a batch's places brings equal words together and shows
    which of them a record has more than once.
    """

    def __init__(self, width: int) -> None:
        self.width, self.bits = width, BYTE_BITS * width
        self.groups: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, raw: np.ndarray, ends: np.ndarray, groups: list[tuple], which: np.ndarray, marked: np.ndarray) -> bool:
        """Take the texts of a batch, of which ``which`` is the group; False, and nothing is done, if numbers can't hold its words."""
        n, width = len(which), self.width
        low = n.bit_length()
        if low + self.bits + max(len(groups), 1).bit_length() > 62 or raw.max(initial=0) > 127:
            return False
        places = max(len(raw) - width + 1, 0)
        if not places:
            return True
        inside = np.ones(places, bool)
        for j in range(1, width):
            last = ends[1:] - j
            inside[last[(last >= 0) & (last < places)]] = False
        keys = raw[:places].astype(np.int64)
        for j in range(1, width):
            keys <<= BYTE_BITS
            keys |= raw[j : j + places]
        keys <<= low
        keys |= np.repeat(which.astype(np.int64) << (low + self.bits) | np.arange(n), np.diff(ends))[:places]
        keys = np.sort(keys[inside])
        if not len(keys):
            return True
        fresh = np.empty(len(keys), bool)
        fresh[0] = True
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        keys = keys[fresh]
        cell = keys >> low
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        in_marked = np.add.reduceat(marked.astype(np.int64)[keys & ((1 << low) - 1)], first)
        number = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        cell_of = cell[first]
        cell_of = number[cell_of >> self.bits] << self.bits | cell_of & ((1 << self.bits) - 1)
        self.parts.append((cell_of, np.diff(np.append(first, len(cell))), in_marked))
        self.size += len(first)
        return True

    def merge(self) -> None:
        """Add up what batches have in common."""
        if len(self.parts) < 2:
            return
        cell, *sums = map(np.concatenate, zip(*self.parts, strict=True))
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.parts = [(cell[first], *(np.add.reduceat(x[order], first) for x in sums))]
        self.size = len(first)

    def taken(self):
        """Lists of groups with the number of the group, word, records and marked records of each cell, portion by portion; nothing is held after that."""
        self.merge()
        groups, parts = list(self.groups), self.parts
        self.groups, self.parts, self.size = {}, [], 0
        shift = BYTE_BITS * np.arange(self.width - 1, -1, -1)
        for cell, n, in_marked in parts:
            for a in range(0, len(cell), 1 << 16):
                some = cell[a : a + (1 << 16)]
                words = spelled_texts((some[:, None] >> shift & ((1 << BYTE_BITS) - 1)).astype(np.uint8))
                yield groups, some >> self.bits, words, n[a : a + (1 << 16)], in_marked[a : a + (1 << 16)]


def word_places(points: np.ndarray, ends: np.ndarray, words: list[str], width: int, flank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the word, text and place of each of ``words`` in texts of letters ``points`` that end at ``ends[1:]``, if ``flank`` letters on both sides are there."""
    none, found = np.zeros(0, np.int64), []
    for k, word in enumerate(words):
        letters = code_points([word])
        if len(letters) != width:
            continue
        at = np.flatnonzero(points[: max(len(points) - width + 1, 0)] == letters[0])
        for j in range(1, width):
            at = at[points[at + j] == letters[j]]
        text = np.searchsorted(ends, at, "right") - 1
        inside = (at - flank >= ends[text]) & (at + width + flank <= ends[text + 1])
        found.append((np.full(int(inside.sum()), k), text[inside], at[inside]))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (none, none, none)


CODE_BITS = 5  # a capital letter


def word_totals(texts: list[str], states: list[str], group: np.ndarray, width: int) -> tuple[np.ndarray, ...] | None:
    """Group, word, letters of ``states`` under it, number and sum of places (from 1) of the first of each word of ``width`` letters in a text.

    Words come as numbers, ``CODE_BITS`` a letter, each (group, word, letters) once. None if that takes more than capital letters.
    """
    points, under = code_points(texts), code_points(states)
    both = np.concatenate([points, under])
    if not len(both) or both.min() < 65 or both.max() > 90 or CODE_BITS * width > 30:
        return None
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    many = np.maximum(sizes - width + 1, 0)
    record = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many)
    starts = at + np.repeat(np.cumsum(sizes) - sizes, many)
    tables = [np.flatnonzero(np.bincount(x, minlength=91)) for x in (points, under)]
    longest, (letters, marks) = int(sizes.max(initial=0)) + 1, tables
    words, unders = len(letters) ** width, len(marks) ** width
    if max(words * len(texts), (int(group.max(initial=0)) + 1) * words * unders) * longest >= 1 << 62:
        return None

    def numbers(x, table, where):
        rank = np.zeros(91, np.int64)
        rank[table] = np.arange(len(table))
        x, out = rank[x], np.zeros(len(where), np.int64)
        for j in range(width):
            out = out * len(table) + x[where + j]
        return out

    def spread(ids, table):
        out = np.zeros(len(ids), np.int64)
        for j in range(width):
            ids, digit = np.divmod(ids, len(table))
            out |= (table[digit] - 65) << (CODE_BITS * j)
        return out

    found = np.sort((record * words + numbers(points, letters, starts)) * longest + at)
    word = found // longest
    fresh = np.concatenate([[True], word[1:] != word[:-1]])[: len(found)]
    at, word = (found - word * longest)[fresh], word[fresh]
    record = word // words
    mark = numbers(under, marks, (np.cumsum(sizes) - sizes)[record] + at)
    found = np.sort(((group[record] * words + (word - record * words)) * unders + mark) * longest + at)
    cell = found // longest
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
    n = np.diff(np.append(first, len(cell)))
    places = np.add.reduceat(found - cell * longest + 1, first) if len(first) else n
    cell = cell[first]
    of, mark = cell // unders // words, spread(cell % unders, marks)
    return of, spread(cell // unders % words, letters), mark, n, places


def spelled_numbers(numbers: np.ndarray, width: int) -> pa.Array:
    """The words that :func:`word_totals` numbers."""
    shift = CODE_BITS * np.arange(width - 1, -1, -1)
    return spelled_texts((numbers[:, None] >> shift & ((1 << CODE_BITS) - 1)) + 65)


def group_numbers(batch: pa.RecordBatch, by: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The different values of the columns ``by``, and which of them each row has."""
    if not by:
        return [()], np.zeros(batch.num_rows, np.int64)
    table = pa.Table.from_batches([batch.select(by)]).append_column("_row", pa.array(np.arange(batch.num_rows)))
    groups = table.group_by(by, use_threads=False).aggregate([("_row", "list")])
    rows = groups.column("_row_list").combine_chunks()
    which = np.empty(batch.num_rows, np.int64)
    which[rows.flatten().to_numpy()] = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
    return list(zip(*(groups.column(c).to_pylist() for c in by), strict=True)), which


def word_counts(texts: list, group: np.ndarray, groups: int, width: int, letters: str) -> np.ndarray:
    """Occurrences of every word over ``letters`` in the texts of each group, the first letter changing fastest; a null has none."""
    place = np.full(256, -1, np.int64)
    place[[ord(c) for c in letters]] = np.arange(len(letters))
    known = [t or "" for t in texts]
    # A letter that no word has ends each text, so that no word reaches into the next.
    codes = place[np.minimum(code_points([t + "\x00" for t in known]), 255)]
    n, many = max(len(codes) - width + 1, 0), len(letters) ** width
    cell, whole = np.repeat(group, [len(t) + 1 for t in known])[:n] * many, np.ones(n, bool)
    for j in range(width):
        cell += codes[j : j + n] * len(letters) ** j
        whole &= codes[j : j + n] >= 0
    return np.bincount(cell[whole], minlength=groups * many).reshape(groups, many)
