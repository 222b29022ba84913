import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribospan.llm import ngram_join

DOCS = "doc_id long, text string"


def set_by_force(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set())


def components_by_force(rows):
    sets, group = [set_by_force(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if common and 100 * common >= 85 * union:
                group[top(i)] = top(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[k]:
            least[top(k)] = min(least.get(top(k), doc_id), doc_id)
    return sorted(str((i, len(sets[k]), least.get(top(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def rows_near_the_threshold():
    rng, rows = random.Random(3), []
    common = " ".join(f"license{k}" for k in range(30))
    for size in (6, 9, 10, 14, 25, 40, 80, 200, 600):
        words = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for _ in range(8):
            edited = list(words)
            for _ in range(rng.randrange(1, max(2, size // 20))):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
            rows.append((len(rows), " ".join(edited)))
        rows.append((len(rows), " ".join(words[: int(size * 0.86)])))
        rows.append((len(rows), f"{common} {' '.join(words)}"))
    # A chain: each links with the next, the ends don't.
    chain = [f"c{k}" for k in range(160)]
    rows += [(1000 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(8)]
    # Shortest sets that may link with a different one, and one below.
    rows += [(2000, "a b c d e f g h i"), (2001, "a b c d e f g h i j"), (2002, "p q r s t u v w"), (2003, "p q r s t u v w x")]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "One two"), (3004, "one TWO"), (3005, "two one"), (3006, "É é x y z")]
    rows += [rows[3], rows[3], (None, rows[0][1]), (None, "alone without any id here"), (None, None), (3007, "word " * 30000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"light": 0}, {"light": 20}, {"light": 100, "subset": 3}, {"light": 20, "block": 3, "block_shingles": 300}])
def test_components_against_brute_force(spark, options):
    rows = rows_near_the_threshold()
    df = spark.createDataFrame(rows, DOCS).withColumn("sid", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    assert sorted(str(tuple(r)) for r in ngram_join.join_by_ngrams(df, **options).collect()) == components_by_force(rows)


def test_large_group_of_near_copies_in_small_batches(spark):
    rng, rows = random.Random(8), []
    words = [f"w{k}" for k in range(120)]
    for k in range(150):
        edited = list(words)
        for _ in range(2):
            edited[rng.randrange(120)] = f"own{k}"
        rows.append((k, " ".join(edited)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = ngram_join.join_by_ngrams(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(tuple(r)) for r in found) == components_by_force(rows)


def test_empty_table(spark):
    found = ngram_join.join_by_ngrams(spark.createDataFrame([], DOCS))
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and not found.collect()


def test_bitmaps_never_part_what_links():
    rng = np.random.default_rng(1)
    for n in (6, 40, 300, 3000):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.concatenate([one[int(n * 0.15 / 2) :], rng.integers(0, 1 << 63, int(n * 0.15 / 2) // 2, dtype=np.uint64)])
        common, union = len(np.intersect1d(one, other)), len(np.union1d(one, other))
        bits = min(ngram_join.parity_bits(len(one)), ngram_join.parity_bits(len(other)))
        differ = sum((x ^ y).bit_count() for x, y in zip(ngram_join.parity(one, bits), ngram_join.parity(other, bits), strict=True))
        wide = np.frombuffer(ngram_join.parity(one, 2 * bits), np.uint64)
        assert ((wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]) == np.frombuffer(ngram_join.parity(one, bits), np.uint64)).all()
        assert 100 * common >= 85 * union
        assert differ <= ngram_join.most_different(np.array([len(one) + len(other)]))[0]


def test_boundary_follows_the_costs():
    flat, peaked = np.full(ngram_join.SMALL_SKETCH, 10), np.zeros(ngram_join.SMALL_SKETCH, np.int64)
    peaked[0] = flat.sum()
    assert ngram_join.boundary({}, 2) == 0
    few = ngram_join.boundary({k: (100, flat) for k in range(5, 20)}, 2)
    many = ngram_join.boundary({k: (100, peaked) for k in range(5, 20)}, 2)
    assert few < many  # long lists make subsets worth more


def test_hashes_tell_words_apart_as_text_does():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "ab", "ba", "b", "A", "aB", "é", "É"]) + rng.choice(["", "\t", "\n "]) for _ in range(6)) for _ in range(3000)]
    of = lambda t: ngram_join.set_id(ngram_join.shingle_set(t.encode()))
    assert len({of(t) for t in texts}) == len({frozenset(set_by_force(t)) for t in texts})


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = b"some words of a longer text\tthat is\ncut " * 50
    whole = ngram_join.shingle_set(text)
    monkeypatch.setattr(ngram_join, "PIECE", 17)
    assert (ngram_join.shingle_set(text) == whole).all()


def test_lists_keep_only_sets_that_a_key_may_link(spark):
    """Near copies share hundreds of keys each; only the first few that two may have in common go on."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        at = rng.randrange(80)
        rows.append((i, " ".join([*words[:at], f"own{i}", *words[at + 1 :]])))
    docs = spark.createDataFrame(rows, DOCS)
    ranks = ngram_join.frequency_ranks(ngram_join.measured(docs, 4).where("cell IS NOT NULL").select("cell", "hits"))
    shared = ngram_join.shared_keys(ngram_join.keyed_sets(docs, ranks, 200, 4, 2))
    assert shared.count() <= 20 * len(rows)
    found = ngram_join.join_by_ngrams(docs, light=200).collect()
    assert sorted(str(tuple(r)) for r in found) == components_by_force(rows)


def test_partners_by_size_and_room():
    rng = np.random.default_rng(8)
    listed = np.sort(rng.integers(0, 60, 400))
    n = rng.integers(6, 40, 400)
    left = n - rng.integers(0, 5, 400)
    got = ngram_join.with_partner(listed, ngram_join.rooms(n, n - left))
    for i in range(400):
        others = [j for j in range(400) if j != i and listed[j] == listed[i]]
        fits = [185 * min(left[i], left[j]) >= 85 * (n[i] + n[j]) and 100 * min(n[i], n[j]) >= 85 * max(n[i], n[j]) for j in others]
        assert got[i] == any(fits)
