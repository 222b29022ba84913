import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ribospan.llm import prefix_trie
from ribospan.llm.prefix_trie import LEAST_ID, Skeleton

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return sum(1 for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w)


def nodes_by_force(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append((c, len(built) == d))
    below = {}
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)

    def subtree(node):
        inner = [subtree(x) for x in below.get(node, [])]
        own = (len(members[node]) - 1) * words(node[-1][1]) if node else 0
        return sum(a for a, _ in inner) or 1, own + sum(b for _, b in inner)

    out = []
    for node, found in members.items():
        leaves, saved = subtree(node)
        ends = ",".join(str(c) for c in sorted(c for c, last in found if last))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in found), len(node), parent, len(found), len(below.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations():
    rng, rows = random.Random(4), []
    starts = [("system", "be kind"), ("system", "be brief"), ("user", "hello  there\n you")]
    for c in range(260):
        turns = [rng.choice(starts)]
        for k in range(rng.randrange(1, 7)):
            turns.append((["user", "assistant"][k % 2], f"choice {rng.randrange(2)} of a turn" if k < 3 else f"own {c} {k}"))
        if 80 <= c < 170:  # many equal conversations
            turns = [("user", "one question"), ("assistant", "one answer"), ("user", "thanks")][: 1 + c % 3]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rows += [(c, None, "user", None) for c in (3, 300, 301)] + [(302, 5, None, ""), (302, 5, None, ""), (303, 1, "system", "be kind"), (None, 1, "user", "x")]
    rows += [(-7, 1, "user", "negative id"), (400, 2, "b", "tied"), (400, 2, "a", "tied"), (305, 1, "user", "word " * 20000)]
    return [*rows, rows[0]]


@pytest.mark.parametrize("options", [{}, {"turns_a_shard": 5, "sample_a_shard": 100}, {"turns_a_shard": 20, "sample_a_shard": 50, "skeleton_depth": 1}, {"most_shards": 1}])
def test_nodes_against_brute_force(spark, options):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("depth", F.lit(1))
    found = prefix_trie.prefix_trie(df, **options).collect()
    assert sorted(str(tuple(r)) for r in found) == nodes_by_force(rows)


def test_sql_against_brute_force():
    rows = conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, con.execute(prefix_trie.ORACLE).fetchall())) == nodes_by_force(rows)


def test_small_batches_and_empty_table(spark):
    assert not prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect()
    rows = conversations()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), turns_a_shard=30, sample_a_shard=40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(tuple(r)) for r in found) == nodes_by_force(rows)


def test_equal_paths_are_parted_by_their_ids():
    path = b"a" * 16
    skeleton = Skeleton([(path, 10), (path, 20), (path + b"b" * 32, 3)], 2)
    assert [skeleton.shard(path, c) for c in (9, 10, 19, 20)] == [0, 1, 1, 2]
    assert len(skeleton.parents) == 3 and skeleton.split_ends == {1}  # the third is cut to two turns
    assert skeleton.splitters[2] == (path + b"b" * 16, LEAST_ID) and skeleton.shard(path + b"b" * 16, 0) == 3
