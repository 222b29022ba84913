import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ribospan.llm import fingerprints, hamming, simhash
from ribospan.llm.components import connected_components

DOCS = "doc_id long, text string, source string"


def mark_by_force(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(marks):
    group = list(range(len(marks)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                group[top(i)] = top(j)
    return [top(k) for k in range(len(marks))]


def near_rows():
    rng, rows = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(400)]
        for _ in range(6):
            edited = list(words)
            edited[rng.randrange(400)] = "changed"
            rows.append((len(rows), " ".join(edited), "s"))
    rows += [(90, None, "s"), (91, "", None), (92, " \t\n", "s"), (93, "ONE two", "s"), (94, "one Two", "s"), (95, "É é x y", "s")]
    return [*rows, rows[7], rows[7], (None, rows[0][1], "s"), (None, "alone without any id here", "s"), (96, "word " * 50000, "s")]


def test_components_against_brute_force(spark):
    rows = near_rows()
    marks = [mark_by_force(t) for _, t, _ in rows]
    group, least = groups_by_force(marks), {}
    for (doc_id, *_), g in zip(rows, group, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    want = sorted(str((i, f"{m:016x}", least.get(g))) for (i, *_), m, g in zip(rows, marks, group, strict=True))
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(df).collect()) == want
    assert len(set(group)) < len(rows) - 20  # near copies are among them
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    group = groups_by_force([mark_by_force(t) for _, t, _ in rows])
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(3))).collect()
    by_group = {}
    for (doc_id, *_), g in zip(rows, group, strict=True):
        by_group.setdefault(g, set()).add(10**9 if doc_id is None else doc_id)
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in kept) == sorted(min(v) for v in by_group.values())
    assert kept[0].key == 3


def test_links_of_large_groups_connect_the_same(spark, monkeypatch):
    rng = random.Random(8)
    center = rng.getrandbits(64)
    marks = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    marks = sorted(marks | {rng.getrandbits(64) for _ in range(50)})
    want = groups_by_force(marks)
    rows = [(int(np.uint64(m).view(np.int64)),) for m in marks]
    df = spark.createDataFrame(rows, "fp long")
    keyed = df.select("fp", F.explode(simhash.variant_keys()).alias("key"))
    for block in (4096, 40):  # in place, and cut into pairs of blocks
        found = hamming.links(keyed, ["fp"], simhash.answers, block).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
        pairs = {(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in found.collect()}
        assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in pairs)
        root = {r.node: r.root for r in connected_components(found).collect()}
        got = [root.get(r[0], r[0]) for r in rows]
        assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert connected_components(links.limit(0)).count() == 0


def test_fingerprints_against_one_by_one(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 300))) + "é" * (k % 3), "s") for k in range(70)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "tiny", "s"), (203, rows[0][1], "s"), (204, rows[0][1], "s"), (205, "x y z " * 20000, "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("low", F.lit("clash"))
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df, part_bytes=9000).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: -r[0])
    mark = lambda t: fingerprints.fingerprint(t.encode())
    for here, follows in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, after, r = here[1] or "", follows[1] or "", got[here[0]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mark(text).hex(), mark(edited).hex())
        assert r.near_edited == pytest.approx(fingerprints.likeness(mark(text), mark(edited)))
        assert r.near_next == pytest.approx(fingerprints.likeness(mark(text), mark(after)))
    # Document 0 is left out: a third of its edited text is one phrase over and over, which outvotes the rest.
    long = [got[i] for i, t, _ in rows[1:70] if len(t.split()) > 100]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.98 * len(long)


def test_report_counts_links_and_takes_odd_rows(spark):
    rows = [(1, "a b c d e f g", "s"), (2, "A b c d e f g", "s"), (None, "x", "s"), (None, None, "s"), (1, "a b c d e f g", "s")]
    got = fingerprints.fingerprint_report(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and {r.n_links for r in got} == {0}
    assert fingerprints.fingerprint_report(spark.createDataFrame([], DOCS)).count() == 0
    assert fingerprints.fingerprint_report(spark.createDataFrame(rows[:1], DOCS)).first().near_next == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    rng, marks = random.Random(7), []
    for _ in range(60):
        m = rng.getrandbits(128)
        marks += [m, m ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 5)))]
    halves = [tuple(int(np.uint64(h).view(np.int64)) for h in (m >> 64, m & (2**64 - 1))) for m in marks]
    found = fingerprints.within_radius(spark.createDataFrame(halves, "high long, low long")).collect()
    got = {frozenset([(r.a_high, r.a_low), (r.b_high, r.b_low)]) for r in found}
    want = {frozenset([halves[i], halves[j]]) for i in range(120) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3}
    assert got == want and len(found) == len(got)


def test_links_are_counted_exactly_in_large_groups(spark):
    rng = np.random.default_rng(9)
    for size in (100, 5000):  # one key of each size: in place, and cut into pairs of blocks
        center, marks = rng.integers(0, 1 << 32, 4, np.uint64), set()
        while len(marks) < size:
            parts = center.copy()
            for b in rng.choice(96, 2, replace=False):
                parts[1 + b // 32] ^= np.uint64(1 << int(b % 32))
            parts[3] ^= np.uint64(rng.integers(0, 4))
            marks.add(tuple(int(p) for p in parts))
        high = np.array([(a << 32) | b for a, b, _, _ in marks], np.uint64)
        low = np.array([(c << 32) | d for _, _, c, d in marks], np.uint64)
        want = {}
        for h, l in zip(high, low, strict=True):
            near = np.bitwise_count(high ^ h) + np.bitwise_count(low ^ l) <= 3
            want[int(h.view(np.int64)), int(l.view(np.int64))] = int(near.sum()) - 1
        df = spark.createDataFrame(list(want), "high long, low long")
        got = {(r.high, r.low): r.n for r in fingerprints.count_within_radius(df.unionByName(df)).collect()}
        assert got == {k: n for k, n in want.items() if n} and sum(got.values()) > 2 * size  # more than a forest
        if size == 100:
            pairs = fingerprints.within_radius(df).collect()
            assert len(pairs) == len({frozenset([(r.a_high, r.a_low), (r.b_high, r.b_low)]) for r in pairs}) == sum(want.values()) / 2


def test_two_large_keys_that_follow_each_other_keep_their_links(spark):
    def in_a_row(key, a, b):
        return np.maximum(a, b)[:, 0] - np.minimum(a, b)[:, 0] == 1

    # 100 rows of each key, in batches of 90: the second batch ends key 1 and has over 40 rows of key 2, still open.
    keyed = spark.createDataFrame([(key, 1000 * key + k) for key in (1, 2) for k in range(100)], "key long, fp long")
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "90", "spark.sql.shuffle.partitions": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = hamming.links(keyed, ["fp"], in_a_row, 40).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
        pairs = [(r.a, r.b) for r in found.collect()]
        counts = {r.fp: r.n for r in hamming.counts_of_links(keyed, ["fp"], in_a_row, 40).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {tuple(sorted(p)) for p in pairs} == {(1000 * key + k, 1000 * key + k + 1) for key in (1, 2) for k in range(99)}
    assert counts == {1000 * key + k: 1 if k in (0, 99) else 2 for key in (1, 2) for k in range(100)}
