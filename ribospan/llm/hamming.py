"""Close fingerprints from rows that share a key: links that connect them, every link, or their counts.

Rows are ``(key, words)`` with distinct fingerprints in a key. They are dealt out and sorted by
key; a task walks through its keys and compares the fingerprints of each inside the task. Keys
with more than ``block`` fingerprints are not compared there: they come out as they are and are
cut into blocks, and a task compares one pair of blocks, so no task ever holds more than two
blocks of a key.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.session import materialize

BLOCK = 4096
SMALL = 64
CHUNK = 1 << 18

#: ``test(key, a, b)`` of arrays of equal length (words in columns): whether the two are linked
#: and this key is the one that answers for the pair.
PairTest = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def spanning_links(key: int, words: np.ndarray, test: PairTest) -> tuple[np.ndarray, np.ndarray]:
    """Links (as row numbers) that connect what ``test`` connects; at most one a row."""
    left, right = [], []
    waiting = np.arange(len(words))
    keys = np.full(len(words), key)
    while len(waiting):
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            k = front.pop()
            hit = test(keys[: len(waiting)], np.broadcast_to(words[k], (len(waiting), words.shape[1])), words[waiting])
            found, waiting = waiting[hit], waiting[~hit]
            left += [k] * len(found)
            right += found.tolist()
            front += found.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def every_link(
    key: int, words: np.ndarray, test: PairTest, side: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links (as row numbers) in chunks, each once; with ``side`` only those from a False to a True row."""
    first = np.arange(len(words)) if side is None else np.flatnonzero(~side)
    second = first if side is None else np.flatnonzero(side)
    facing, keys = words[second], np.full(len(second), key)
    left, right, held = [], [], 0
    for k, row in enumerate(first):
        start = k + 1 if side is None else 0
        rest = facing[start:]
        found = second[start:][test(keys[start:], np.broadcast_to(words[row], rest.shape), rest)]
        left.append(np.full(len(found), row))
        right.append(found)
        held += len(found)
        if held > CHUNK:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def link_counts(key: int, words: np.ndarray, test: PairTest, side: np.ndarray | None = None) -> np.ndarray:
    """Number of links of each row, of those :func:`every_link` gives."""
    n = np.zeros(len(words), np.int64)
    for i, j in every_link(key, words, test, side):
        n += np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
    return n


def small_run_pairs(key: np.ndarray, words: np.ndarray, test: PairTest) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside runs of equal keys, all runs at once, one distance in the run after another."""
    left, right = [], []
    here, step = np.arange(len(key)), 0
    while len(here):
        step += 1
        here = here[here + step < len(key)]
        here = here[key[here] == key[here + step]]
        hit = here[test(key[here], words[here], words[here + step])]
        left.append(hit)
        right.append(hit + step)
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns], axis=1)


def _emit(columns: list[str], a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    """A link (a, b), or with ``key`` a row that is left for the blocks."""
    n = len(a)
    arrays = [pa.array(np.ascontiguousarray(a[:, i]).view(np.int64)) for i in range(a.shape[1])]
    arrays += [pa.array(np.ascontiguousarray(b[:, i]).view(np.int64)) for i in range(a.shape[1])]
    arrays.append(pa.array(key) if key is not None else pa.nulls(n, pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, names=[f"a_{c}" for c in columns] + [f"b_{c}" for c in columns] + ["key"])


def _emit_counts(columns: list[str], words: np.ndarray, n: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    """The linked rows with their number of links, or with ``key`` rows that are left for the blocks."""
    if key is None:
        words, n = words[n > 0], n[n > 0]
    arrays = [pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(len(columns))]
    arrays += [pa.array(n), pa.array(key) if key is not None else pa.nulls(len(n), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*columns, "n", "key"])


def _runs(found, columns: list[str], block: int):
    """``key, words, starts, sizes, hot`` of whole runs of equal keys; a hot run has rows for the blocks."""
    rest_key, rest = np.empty(0, np.int64), np.empty((0, len(columns)), np.uint64)
    begun = None  # the key whose first rows are left for the blocks already, so its last ones are too
    for batch in _then_none(found):
        large = False
        if batch is None:
            key, words, complete = rest_key, rest, len(rest_key)
        else:
            key = np.concatenate([rest_key, batch.column("key").to_numpy()])
            words = np.concatenate([rest, _matrix(batch, columns)])
            complete = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if len(key) - complete > block:  # a key that is still open and too large already
                large, complete = True, len(key)
        if not complete:
            rest_key, rest = key, words
            continue
        now, fp = key[:complete], words[:complete]
        rest_key, rest = key[complete:], words[complete:]
        starts = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        sizes = np.diff(np.append(starts, len(now)))
        yield now, fp, starts, sizes, (sizes > block) | (now[starts] == begun if begun is not None else False)
        if large:
            begun = key[-1]


def _sorted_by_key(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.select("key", *columns).repartition("key").sortWithinPartitions("key")


def _block_pairs(large: DataFrame, columns: list[str], block: int) -> DataFrame | None:
    """``key, block_a, block_b, block, columns``: the rows left for the blocks with each pair of blocks they take part in."""
    counts = materialize(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    if not counts.head(1):
        return None
    rows = large.join(counts, "key").withColumn("block", F.pmod(F.xxhash64(*columns), F.col("blocks")))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", *columns
    )


def _block_pair(group: pa.Table, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Key, words and, unless a block meets itself, which rows are of the higher block."""
    words = np.stack([group.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
    low, high = group.column("block_a")[0].as_py(), group.column("block_b")[0].as_py()
    return group.column("key")[0].as_py(), words, group.column("block").to_numpy() == high if low < high else None


def links(keyed: DataFrame, columns: list[str], test: PairTest, block: int = BLOCK, every: bool = False) -> DataFrame:
    """Links between fingerprints that share a key: ``a_<c>, b_<c>`` for the columns of a fingerprint.

    With ``every`` these are all linked pairs, each once. Without, in groups above ``SMALL`` they
    are enough of them to connect what is connected, and some may come repeatedly.
    """
    ends = [f"a_{c}" for c in columns] + [f"b_{c}" for c in columns]
    schema = ", ".join(f"{c} long" for c in ends) + ", key long"

    def linked(key, words, side):
        if every:
            yield from every_link(key, words, test, side)
        else:
            yield spanning_links(key, words, test)

    def walk(found):
        for now, fp, starts, sizes, hot in _runs(found, columns, block):
            small = np.repeat((sizes <= min(SMALL, block)) & ~hot, sizes)
            i, j = small_run_pairs(now[small], fp[small], test)
            if len(i):
                yield _emit(columns, fp[small][i], fp[small][j])
            for s, n in zip(starts[(sizes > SMALL) & ~hot].tolist(), sizes[(sizes > SMALL) & ~hot].tolist(), strict=True):
                for i, j in linked(int(now[s]), fp[s : s + n], None):
                    if len(i):
                        yield _emit(columns, fp[s + i], fp[s + j])
            left = np.repeat(hot, sizes)
            if left.any():
                yield _emit(columns, fp[left], fp[left], now[left])

    found = materialize(_sorted_by_key(keyed, columns).mapInArrow(walk, schema))
    direct = found.where(F.col("key").isNull()).select(*ends)
    large = found.where(F.col("key").isNotNull()).select("key", *[F.col(f"a_{c}").alias(c) for c in columns])
    pairs = _block_pairs(large, columns, block)
    if pairs is None:
        return direct

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, side = _block_pair(pa.Table.from_batches(batches), columns)
        for i, j in linked(key, words, side):
            yield _emit(columns, words[i], words[j])

    return direct.unionByName(pairs.groupBy("key", "block_a", "block_b").applyInArrow(compare, schema).select(*ends))


def counts_of_links(keyed: DataFrame, columns: list[str], test: PairTest, block: int = BLOCK) -> DataFrame:
    """``columns, n``: the number of links of each linked fingerprint, exact in groups of any size.

    A pair is counted in the task that compares it and never emitted.
    """
    schema = ", ".join(f"{c} long" for c in (*columns, "n", "key"))

    def walk(found):
        for now, fp, starts, sizes, hot in _runs(found, columns, block):
            n = np.zeros(len(now), np.int64)
            small = np.flatnonzero(np.repeat((sizes <= min(SMALL, block)) & ~hot, sizes))
            i, j = small_run_pairs(now[small], fp[small], test)
            n[small] = np.bincount(i, minlength=len(small)) + np.bincount(j, minlength=len(small))
            for s, size in zip(starts[(sizes > SMALL) & ~hot].tolist(), sizes[(sizes > SMALL) & ~hot].tolist(), strict=True):
                n[s : s + size] = link_counts(int(now[s]), fp[s : s + size], test)
            yield _emit_counts(columns, fp, n)
            left = np.repeat(hot, sizes)
            if left.any():
                yield _emit_counts(columns, fp[left], n[left], now[left])

    found = materialize(_sorted_by_key(keyed, columns).mapInArrow(walk, schema))
    direct = found.where(F.col("key").isNull()).select(*columns, "n")
    pairs = _block_pairs(found.where(F.col("key").isNotNull()).select("key", *columns), columns, block)

    def compare(group: pa.Table) -> pa.Table:
        key, words, side = _block_pair(group, columns)
        return pa.Table.from_batches([_emit_counts(columns, words, link_counts(key, words, test, side))])

    if pairs is not None:
        direct = direct.unionByName(pairs.groupBy("key", "block_a", "block_b").applyInArrow(compare, schema).select(*columns, "n"))
    return direct.groupBy(*columns).agg(F.sum("n").alias("n"))


def _then_none(found):
    yield from found
    yield None
