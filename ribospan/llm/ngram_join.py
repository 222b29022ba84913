"""Jaccard join of word n-gram sets, size-aware: subsets for light sets, inverted lists for heavy ones.

A document's set holds the hashes of its distinct shingles. Two sets link when ``100 * common >=
85 * union``. A set of ``n`` shingles then shares at least ``ceil(0.85 n)`` with any partner, so
in one order of all shingles the first ``n - ceil(0.85 n) + c`` of two linked sets share ``c``
of them. Frequent shingles come last in that order, by a table of counts over all documents.

* Light sets (``n`` up to a boundary) emit every ``c``-subset of that prefix as a key; two linked
  light sets share a key.
* Heavy sets are found through inverted lists: they, and the light sets that are large enough to
  be a partner, emit the single shingles of the prefix for ``c = 1``.

A key comes with the size of its set and the shingles that the set has before the end of the key and outside it:
if the key is the first that two sets share, neither shares those. A list keeps the sets for which it has a
partner that this leaves enough shingles in common with, so of the many keys of near copies only the first few go on.

The boundary is the size at which the subsets of all smaller sets and the lists of all larger ones
cost least together: rows that are emitted, plus the comparisons that the lists will need. List
lengths are estimated for each class of sizes from a second table of counts over all documents.

Sets that share a key are compared by parity bitmaps, of a size that grows with the set: the bits in
which two differ are no more than the shingles in which they differ, so nothing is lost. A list gives
links that connect what may link, not all its pairs. The components of these links hold every link;
each gets its sets once, and the links among them are verified on the shingles themselves, again only
as many as connect it. Lists above ``block`` sets, and components above ``block_shingles`` shingles,
are cut into blocks whose pairs are a task's work.

Equal sets are one row from the start. Edge cases: a null text and one without words have an
empty set, which links with nothing; with fewer words than a shingle has, the whole sequence is
the one shingle; sets below six shingles link with equal ones only; null ids belong to the
component of their set, whose id is the smallest that is not null; repeated rows keep a row each;
very long texts are hashed in pieces and keep 8 bytes a shingle; an empty table gives an empty
result; extra columns are left out. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.llm.components import connected_components
from ribospan.llm.hamming import _block_pairs, spanning_links
from ribospan.session import materialize

WORDS = 4
LEAST, OF = 85, 100
CELL_BITS = 15
LOW_MASK = np.uint64((1 << (64 - CELL_BITS)) - 1)
CELL_SHIFT = np.uint64(64 - CELL_BITS)
SMALL_SKETCH = 1 << 11
LEAST_PARITY, EXACT_PARITY = 256, 4096  # bits
FIRST_LINKING = 6  # below, no two different sets reach the threshold
SHORT_LIST = 64
WHOLE_LIST = 1 << 16
BLOCK = 1 << 16
BLOCK_SHINGLES = 1 << 21
PIECE = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_M1, _M2, _33 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
#: A random number for each byte, none for white space, A-Z as a-z; and the base of the word polynomials.
_BYTES = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BYTES[_IS_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        _POWERS[:] = [
            np.cumprod(np.where(np.arange(size) > 0, np.uint64(base), np.uint64(1)), dtype=np.uint64)
            for base in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _33)) * _M1
    x = (x ^ (x >> _33)) * _M2
    return x ^ (x >> _33)


def piece_words(piece: bytes) -> np.ndarray:
    """Hashes of the words of a piece of text, A-Z as a-z: a polynomial of each word's bytes, from running sums."""
    raw = np.frombuffer(piece, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, piece by piece."""
    if len(text) <= PIECE:
        return piece_words(text)
    parts, start = [], 0
    while start < len(text):
        cut = _SPACE.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = cut.start() if cut else len(text)
        parts.append(piece_words(text[start:end]))
        start = end
    return np.concatenate(parts)


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * (_MULTIPLIERS[k % 4] + np.uint64(2 * (k // 4)))
    found = np.sort(mixed(total))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def least_common(n: int) -> int:
    """Shingles a set of ``n`` shares at least with any partner."""
    return -(-LEAST * n // OF)


def prefix_length(n: int, subset: int = 1) -> int:
    return n - least_common(n) + subset


def most_different(total: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return total - 2 * -(-LEAST * total // (LEAST + OF))


def parity_bits(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` shingles."""
    bits = LEAST_PARITY
    while 2 * bits < 3 * n:
        bits *= 2
    return bits


def parity(shingles: np.ndarray, bits: int | None = None) -> bytes:
    """Bits that an odd number of shingles fall on."""
    bits = bits or parity_bits(len(shingles))
    hits = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((hits & 1).astype(np.uint8)).tobytes()


def set_id(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def size_class(n: int) -> int:
    """Half octaves of set sizes."""
    return int(2 * np.log2(n))


def in_order(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles renumbered so that the frequent cells come last, sorted."""
    high = ranks[(shingles >> CELL_SHIFT).astype(np.int64)]
    return np.sort((high << CELL_SHIFT) | (shingles & LOW_MASK))


def _texts(docs: DataFrame, *carried) -> DataFrame:
    return docs.select(*carried, F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("bytes"))


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _counts(kind: int, n: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(used), kind, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used].astype(np.int64))],
        names=["class", "cell", "n"],
    )


def measured(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, tid, n, sid, bits`` of each row, and ``cell, hits`` of the table of shingle counts."""
    schema = "doc_id long, tid long, n long, sid long, bits binary, cell int, hits long"
    names = ["doc_id", "tid", "n", "sid", "bits", "cell", "hits"]

    def run(found):
        hits = np.zeros(1 << CELL_BITS, np.int64)
        for batch in found:
            n, sid, bits, held, held_size = [], [], [], [], 0
            for text in batch.column("bytes").to_pylist():
                one = shingle_set(text, size)
                n.append(len(one))
                sid.append(set_id(one))
                bits.append(parity(one))
                held.append(one)
                held_size += len(one)
                if held_size > 1 << 20:
                    hits += np.bincount((np.concatenate(held) >> CELL_SHIFT).astype(np.int64), minlength=len(hits))
                    held, held_size = [], 0
            if held:
                hits += np.bincount((np.concatenate(held) >> CELL_SHIFT).astype(np.int64), minlength=len(hits))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tid"), pa.array(n, pa.int64()), _signed(sid), pa.array(bits, pa.binary()),
                 none.cast(pa.int32()), none.cast(pa.int64())], names=names,
            )
        used = np.flatnonzero(hits)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), pa.array(hits[used])], names=names
        )

    rows = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"))
    return rows.mapInArrow(run, schema)


def frequency_ranks(cells: DataFrame) -> np.ndarray:
    """Rank of each cell of the count table, the least frequent first; a fixed number of cells."""
    found = cells.groupBy("cell").agg(F.sum("hits").alias("hits")).toArrow()
    hits = np.zeros(1 << CELL_BITS, np.int64)
    hits[found.column("cell").to_numpy()] = found.column("hits").to_numpy()
    ranks = np.empty(len(hits), np.uint64)
    ranks[np.argsort(hits, kind="stable")] = np.arange(len(hits), dtype=np.uint64)
    return ranks


def class_counts(docs: DataFrame, ranks: np.ndarray, size: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each class of sizes the number of sets and a table of counts of their prefix shingles."""

    def run(found):
        tables = {}
        for batch in found:
            for text in batch.column(0).to_pylist():
                one = shingle_set(text, size)
                if len(one) < FIRST_LINKING:
                    continue
                table = tables.setdefault(size_class(len(one)), np.zeros(SMALL_SKETCH + 1, np.int64))
                head = in_order(one, ranks)[: prefix_length(len(one))]
                table[:-1] += np.bincount((mixed(head) & np.uint64(SMALL_SKETCH - 1)).astype(np.int64), minlength=SMALL_SKETCH)
                table[-1] += 1
        for kind, table in tables.items():
            yield _counts(kind, table)

    found = _texts(docs).mapInArrow(run, "class int, cell int, n long").groupBy("class", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (found.column(c).to_numpy() for c in ("class", "cell", "n"))
    out = {}
    for k in np.unique(kind).tolist():
        table = np.zeros(SMALL_SKETCH + 1, np.int64)
        table[cell[kind == k]] = n[kind == k]
        out[k] = (int(table[-1]), table[:-1])
    return out


def boundary(classes: dict[int, tuple[int, np.ndarray]], subset: int, per_compare: float = 0.1) -> int:
    """The largest size whose sets emit subsets, chosen so that subsets and lists cost least together."""
    if not classes:
        return 0
    everything = sum(table for _, table in classes.values()).astype(float)
    total = everything.sum()
    light, heavy, edges = [], [], sorted(classes)
    for k in edges:
        sets, table = classes[k]
        size = max(FIRST_LINKING, int(2 ** ((k + 0.5) / 2)))
        entries = float(table.sum())
        # Mean length of the lists of this class: pairs in equal cells, less those that meet by chance.
        met = (float((table * everything).sum()) - entries * total / SMALL_SKETCH) / (1 - 1 / SMALL_SKETCH)
        light.append(sets * comb(prefix_length(size, subset), subset))
        heavy.append(entries + per_compare * max(0.0, met))
    costs = []
    for cut in range(len(edges) + 1):
        # The class below the cut is indexed too, as far as it can be a heavy set's partner.
        partners = heavy[cut - 1] if 0 < cut < len(edges) else 0.0
        costs.append(sum(light[:cut]) + sum(heavy[cut:]) + 0.5 * partners)
    cut = int(np.argmin(costs))
    return 0 if not cut else int(np.ceil(2 ** ((edges[cut - 1] + 1) / 2))) - 1


def set_keys(ordered: np.ndarray, light: int, subset: int, picks: dict) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set: subsets of its prefix if it is light, shingles of its prefix if lists of heavy sets may need it.

    With each key the shingles before its last one that are not in it.
    """
    n, out, skipped = len(ordered), [], []
    if n < FIRST_LINKING:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if n <= light:
        length = prefix_length(n, subset)
        if length not in picks:
            picks[length] = np.array(list(combinations(range(length), subset)), np.int64)
        chosen = ordered[:length][picks[length]]
        total = np.full(len(chosen), 0x51ED270B, np.uint64)
        for k in range(subset):
            total += mixed(chosen[:, k] + np.uint64(k)) * _MULTIPLIERS[k % 4]
        out.append(mixed(total))
        skipped.append(picks[length][:, -1] - (subset - 1))
    if n > light or n >= least_common(light + 1):
        out.append(mixed(ordered[: prefix_length(n)]))
        skipped.append(np.arange(len(out[-1])))
    return np.concatenate(out), np.concatenate(skipped)


def keyed_sets(docs: DataFrame, ranks: np.ndarray, light: int, size: int, subset: int) -> DataFrame:
    """``key, sid, room`` of all sets, ``room`` as in :func:`rooms`; a task emits equal sets once."""

    def run(found):
        seen, picks = set(), {}
        for batch in found:
            keys, sids, room = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text in batch.column(0).to_pylist():
                one = shingle_set(text, size)
                if len(one) < FIRST_LINKING:
                    continue
                sid = set_id(one)
                if sid in seen:
                    continue
                seen.add(sid)
                own, skipped = set_keys(in_order(one, ranks), light, subset, picks)
                keys.append(own)
                sids.append(np.full(len(own), sid, np.uint64))
                room.append(rooms(len(one), skipped))
            columns = [_signed(np.concatenate(keys)), _signed(np.concatenate(sids)), pa.array(np.concatenate(room))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "sid", "room"])

    return _texts(docs).mapInArrow(run, "key long, sid long, room long")


def rooms(n: int, skipped: np.ndarray) -> np.ndarray:
    """Size of a set and, for each key, the shingles it may still share, as one number."""
    return (np.asarray(n, np.int64) << 32) | (n - skipped)


def with_partner(listed: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Whether a row's list (numbers in ascending order) has another row that may link with it if the list's key is their first.

    Rows of one size are a group, of which the one with most room decides what others can find in it. A
    group learns the least room that has a partner, in its own or another group of a size near enough.
    """
    if not len(room):
        return np.empty(0, bool)
    order = np.lexsort((room, listed))
    where, n, left = listed[order], room[order] >> 32, room[order] & 0xFFFFFFFF
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (n[1:] != n[:-1])]))
    last = np.append(first[1:], len(n)) - 1
    group = np.repeat(np.arange(len(first)), last - first + 1)
    needed = lambda n, m: -(-LEAST * (n + m) // (LEAST + OF))
    where, n, best = where[first], n[first], left[last]
    two = (last > first) & (left[np.maximum(last - 1, first)] >= needed(n, n))
    least = np.where(two, needed(n, n), np.iinfo(np.int64).max)
    a, step = np.arange(len(first)), 0
    while len(a):
        step += 1
        a = a[a + step < len(first)]
        a = a[(where[a] == where[a + step]) & (OF * n[a] >= LEAST * n[a + step])]
        common = needed(n[a], n[a + step])
        hit = np.minimum(best[a], best[a + step]) >= common
        for side in (a[hit], a[hit] + step):
            least[side] = np.minimum(least[side], common[hit])
    out = np.empty(len(order), bool)
    out[order] = left >= least[group]
    return out


def shared_keys(keyed: DataFrame) -> DataFrame:
    """``key, sid`` of keys that two sets or more have, of the sets that a key may link with another.

    Lists of up to ``WHOLE_LIST`` rows are looked at whole, longer ones go on as they are. Short lists get a hash of their members as key, so that keys with the same members become
    one key; rows of one key may then come repeatedly.
    """

    def lists(key, sid, room, seen):
        """Rows of whole lists of two members or more; short ones renamed, those seen before left out."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.flatnonzero(np.repeat(np.diff(np.append(starts, len(key))) > 1, np.diff(np.append(starts, len(key)))))
        key, sid, room = key[shared], sid[shared], room[shared]
        linking = with_partner(np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]), room)
        key, sid = key[linking], sid[linking]
        if not len(key):
            return pa.RecordBatch.from_arrays([_signed(key), _signed(sid)], names=["key", "sid"])
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        name = key[starts].copy()
        rename = sizes <= SHORT_LIST
        members = np.add.reduceat(mixed(sid), starts)
        name[rename] = mixed(members[rename] + sizes[rename].astype(np.uint64))
        keep = sizes > 1
        renamed = np.flatnonzero(rename & keep)
        if len(renamed):
            fresh = np.fromiter((x not in seen for x in name[renamed].tolist()), bool, len(renamed))
            _, first = np.unique(name[renamed], return_index=True)
            once = np.zeros(len(renamed), bool)
            once[first] = True
            keep[renamed[~(fresh & once)]] = False
            if len(seen) > 500_000:
                seen.clear()
            seen.update(name[renamed[fresh & once]].tolist())
        rows = np.repeat(keep, sizes)
        return pa.RecordBatch.from_arrays([_signed(np.repeat(name, sizes)[rows]), _signed(sid[rows])], names=["key", "sid"])

    def run(found):
        seen: set = set()
        key, sid, room, long_key = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), None
        for batch in found:
            key = np.concatenate([key, batch.column(0).to_numpy().view(np.uint64)])
            sid = np.concatenate([sid, batch.column(1).to_numpy().view(np.uint64)])
            room = np.concatenate([room, batch.column(2).to_numpy()])
            if not len(key):
                continue
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
            key, sid, room = key[fresh], sid[fresh], room[fresh]
            end = int(np.searchsorted(_rank(key), _rank(key)[-1])) if len(key) else 0
            if long_key is not None:  # the rest of a long list whose first rows are out
                rest = int((key == long_key).argmin()) if (key != long_key).any() else len(key)
                if rest > 1:  # its first row here is out already
                    yield pa.RecordBatch.from_arrays([_signed(key[1:rest]), _signed(sid[1:rest])], names=["key", "sid"])
                if rest == len(key):
                    key, sid, room = key[-1:], sid[-1:], room[-1:]
                    continue
                key, sid, room, end, long_key = key[rest:], sid[rest:], room[rest:], end - rest, None
            if end:
                yield lists(key[:end], sid[:end], room[:end], seen)
            key, sid, room = key[end:], sid[end:], room[end:]
            if len(key) > WHOLE_LIST:
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(sid)], names=["key", "sid"])
                long_key, key, sid, room = key[-1], key[-1:], sid[-1:], room[-1:]
        if len(key) and long_key is None:
            yield lists(key, sid, room, seen)

    return keyed.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(run, "key long, sid long")


def _rank(key: np.ndarray) -> np.ndarray:
    """Keys as the signed numbers by which they are sorted."""
    return key.view(np.int64)


def may_link(key, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``n, native, bitmap`` can link: sizes fit, bitmaps differ little, not both bitmaps are folded."""
    n, m = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
    fits = (OF * np.minimum(n, m) >= LEAST * np.maximum(n, m)) & ((a[:, 1] | b[:, 1]) > 0)
    differ = np.bitwise_count(a[:, 2:] ^ b[:, 2:]).sum(axis=1, dtype=np.int64)
    return fits & (differ <= most_different(n + m))


def at_levels(shared: DataFrame, marks: DataFrame) -> DataFrame:
    """``key, sid, n, native, bits``: lists of sets whose bitmaps have one size.

    A set is in the list of its own size, and with its bitmap folded once in that of half the
    size, if a partner can have that: sizes of partners differ too little to be further apart.
    """
    bits = F.octet_length("bits") * 8
    lower = F.floor(bits / 3)  # the largest set whose bitmap has half the bits
    levels = F.when(
        (bits > LEAST_PARITY) & (OF * lower >= LEAST * F.col("n")), F.array(F.struct(bits.alias("level"), F.lit(True).alias("native")), F.struct((bits / 2).cast("int").alias("level"), F.lit(False).alias("native")))
    ).otherwise(F.array(F.struct(bits.alias("level"), F.lit(True).alias("native"))))
    rows = shared.join(marks, "sid").select("key", "sid", "n", "bits", F.inline(levels))
    return rows.select(F.xxhash64("key", "level").alias("key"), "sid", "n", F.col("native").cast("long").alias("native"), "bits")


def _comparable(rows: pa.Table) -> np.ndarray:
    """``n, native, bitmap`` of rows of one list."""
    native = rows.column("native").to_numpy()
    words = [np.frombuffer(x, np.uint64) for x in rows.column("bits").to_pylist()]
    words = [w if own else w[: len(w) // 2] ^ w[len(w) // 2 :] for w, own in zip(words, native.tolist(), strict=True)]
    return np.column_stack([rows.column("n").to_numpy().astype(np.uint64), native.astype(np.uint64), np.stack(words)])


def _whole_runs(found, names: list[str], most: int):
    """Tables of rows that are equal in ``names``, from batches sorted by them, without repeated ``sid``.

    A run of more than ``most`` rows comes in pieces, each marked as one.
    """
    held, open_run, cut = [], None, False

    def run():
        table = pa.Table.from_batches(held).combine_chunks()
        sid = table.column("sid").to_numpy()
        fresh = np.concatenate([[True], sid[1:] != sid[:-1]])
        return table if fresh.all() else table.filter(pa.array(fresh))

    for batch in found:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(keys[:, start].tolist())
            if key != open_run:
                if held:
                    yield run(), cut
                held, open_run, cut = [], key, False
            held.append(batch.slice(start, end - start))
            if sum(b.num_rows for b in held) > most:
                cut = True
                yield run(), True
                held = []
    if held:
        yield run(), cut


def candidates(entries: DataFrame, block: int) -> DataFrame:
    """``a, b``: links that connect all sets of a list that may link."""
    columns = ["sid", "n", "native", "bits"]
    schema = "a long, b long, key long, n long, native long, bits binary"
    names = ["a", "b", "key", "n", "native", "bits"]

    def pairs(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, pa.nulls(len(a), pa.binary())], names=names)

    def walk(found):
        seen, out_a, out_b = set(), [], []
        for rows, cut in _whole_runs(found, ["key"], block):
            if cut:
                none = pa.nulls(rows.num_rows, pa.int64())
                left = [rows.column("sid"), none, *(rows.column(c) for c in ("key", "n", "native", "bits"))]
                yield from pa.Table.from_arrays(left, names=names).to_batches()
                continue
            if rows.num_rows < 2:
                continue
            i, j = spanning_links(0, _comparable(rows), may_link)
            sid = rows.column("sid").to_numpy()
            for a, b in zip(sid[i].tolist(), sid[j].tolist(), strict=True):
                if (a, b) not in seen:
                    seen.add((a, b))
                    out_a.append(a)
                    out_b.append(b)
            if len(seen) > 500_000:
                seen.clear()
            if len(out_a) > 10_000:
                yield pairs(out_a, out_b)
                out_a, out_b = [], []
        yield pairs(out_a, out_b)

    found = materialize(entries.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(walk, schema))
    direct = found.where(F.col("key").isNull()).select("a", "b")
    large = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("sid"), "n", "native", "bits").dropDuplicates(["key", "sid"])
    blocks = _block_pairs(large, columns, block)
    if blocks is None:
        return direct.distinct()

    def compare(group: pa.Table) -> pa.Table:
        words, sid = _comparable(group), group.column("sid").to_numpy()
        if group.column("block_a")[0].as_py() < group.column("block_b")[0].as_py():
            side = group.column("block").to_numpy() == group.column("block_b")[0].as_py()
            words = np.column_stack([words, side.astype(np.uint64)])
            i, j = spanning_links(0, words, lambda key, a, b: (a[:, -1] != b[:, -1]) & may_link(key, a[:, :-1], b[:, :-1]))
        else:
            i, j = spanning_links(0, words, may_link)
        return pa.table({"a": sid[i], "b": sid[j]})

    met = blocks.groupBy("key", "block_a", "block_b").applyInArrow(compare, "a long, b long")
    return direct.unionByName(met).distinct()


def fetched_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``sid, shingles`` of the sets in ``wanted(sid)``, from one text of each."""
    one_text = rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("tid").alias("tid")).select("tid")

    def run(found):
        seen = set()
        for batch in found:
            sids, sets = [], []
            for text in batch.column(0).to_pylist():
                one = shingle_set(text, size)
                sid = set_id(one)
                if sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    sets.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([_signed(sids), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    texts = _texts(docs, F.xxhash64("text").alias("tid")).join(one_text, "tid").select("bytes")
    found = texts.mapInArrow(run, "sid long, shingles binary")
    return found.groupBy("sid").agg(F.first("shingles").alias("shingles"))


def exact_links(sets: list[np.ndarray], side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as row numbers) that connect all linked sets, or those on two sides, verified on the shingles."""
    n = np.fromiter(map(len, sets), np.uint64, len(sets))
    bits = np.stack([np.frombuffer(parity(x, EXACT_PARITY), np.uint64) for x in sets])
    own = np.zeros(len(sets), np.uint64) if side is None else side.astype(np.uint64)
    words = np.column_stack([n, np.ones(len(sets), np.uint64), bits, own, np.arange(len(sets), dtype=np.uint64)])

    def test(key, a, b):
        hit = may_link(key, a[:, :-2], b[:, :-2])
        if side is not None:
            hit &= a[:, -2] != b[:, -2]
        for k in np.flatnonzero(hit):
            one, other = sets[int(a[k, -1])], sets[int(b[k, -1])]
            common = len(np.intersect1d(one, other, assume_unique=True))
            hit[k] = OF * common >= LEAST * (len(one) + len(other) - common)
        return hit

    return spanning_links(0, words, test)


def verified_links(sets: DataFrame, roots: DataFrame, rows: DataFrame, block_shingles: int) -> DataFrame:
    """``a, b``: links between ``sets(sid, shingles)`` that connect what is linked in each of the components ``roots(node, root)``."""
    sizes = rows.groupBy("sid").agg(F.first("n").alias("n")).join(roots.withColumnRenamed("node", "sid"), "sid")
    blocks = materialize(sizes.groupBy("root").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks")))
    placed = materialize(roots.withColumnRenamed("node", "sid").join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks"))))
    members = placed.join(sets, "sid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["root", "block_a", "block_b"]
    members = members.select("root", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "sid", "shingles")

    def walk(found):
        for group, _ in _whole_runs(found, keys, 1 << 62):
            if group.num_rows < 2:
                continue
            sid, block = group.column("sid").to_numpy(), group.column("block").to_numpy()
            two = group.column("block_a")[0].as_py() < group.column("block_b")[0].as_py()
            shingles = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            i, j = exact_links(shingles, block == group.column("block_b")[0].as_py() if two else None)
            yield pa.RecordBatch.from_arrays([pa.array(sid[i]), pa.array(sid[j])], names=["a", "b"])

    return members.repartition(*keys).sortWithinPartitions(*keys, "sid").mapInArrow(walk, "a long, b long")


def join_by_ngrams(
    docs: DataFrame, *, size: int = WORDS, subset: int = 2, light: int | None = None, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    ``light`` overrides the boundary that the costs choose.
    """
    both = materialize(measured(docs, size))
    rows = both.where(F.col("cell").isNull()).drop("cell", "hits")
    ranks = frequency_ranks(both.where(F.col("cell").isNotNull()).select("cell", "hits"))
    if light is None:
        light = boundary(class_counts(docs, ranks, size), subset)
    shared = materialize(shared_keys(keyed_sets(docs, ranks, light, size, subset)))
    marks = rows.where(F.col("n") >= FIRST_LINKING).groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    near = connected_components(candidates(at_levels(shared, marks), block))
    sets = fetched_sets(docs, rows, near.select(F.col("node").alias("sid")), size)
    roots = connected_components(verified_links(sets, near, rows, block_shingles))
    least = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    least = least.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = materialize(least)
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    components = materialize(least.join(component, "root").select("sid", "component_id"))
    filled = rows.where("n > 0").join(components, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id,
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
items AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.r AS a, b.r AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n + m - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS r, min(sets.doc_id) AS m FROM reach JOIN sets ON sets.r = reach.b GROUP BY reach.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, least(sets.doc_id, m) AS component_id
FROM sets LEFT JOIN least ON least.r = sets.r
"""
