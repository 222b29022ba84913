"""Trie of conversation prefixes: sorted shards, and a skeleton of the splitters that part them.

A conversation is a path of turns, 16 bytes (a digest of role and text) a turn. Paths are parted by
splitters, a bounded sample of paths, into shards of about equal work, ties by conversation id, so
that many equal conversations are parted as well. All nodes whose members may lie in several
shards are prefixes of a splitter: the trie of the splitters, the skeleton, is broadcast (at most
``most_shards`` paths of ``skeleton_depth`` turns). Each shard is sorted and walked with a stack of
open nodes; it finishes every other node on its own and gives partial aggregates of the skeleton
nodes it meets. Those are added up, and a last pass over the skeleton alone, children
before parents, completes them.

A digest of the conversations that end at a node reads their ids in order. Only where a splitter is
the whole path of a node do these ids come from several shards; they are then sorted
and streamed through one task, as such a digest asks for.

Edge cases: turns are ordered by turn (null first), equal turns by their digest; null roles and
texts are empty; rows without a conversation id take no part; repeated rows are turns
of their own; very long texts are digested whole; a shard needs memory for its open nodes and their
closed children, a conversation 20 bytes a turn; an empty table has no node; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.llm.mixing import n_words
from ribospan.session import materialize

STEP = 16
LEAST_ID = -(1 << 63)
LOCAL, PARTIAL, ENDS = 0, 1, 2
NO_ENDS = hashlib.sha256().hexdigest()
COLUMNS = ["kind", "skeleton", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends_sha256"]
SCHEMA = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'int' if c == 'kind' else 'long'}" for c in COLUMNS)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE_SCHEMA = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)


class Skeleton:
    """The sorted splitters ``(path, conv_id)`` and the trie of their paths; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]], depth: int) -> None:
        cut = {(p, c) if len(p) <= depth * STEP else (p[: depth * STEP], LEAST_ID) for p, c in splitters}
        self.splitters = sorted(cut)
        self.parents, self.depths, self.children = [-1], [0], {}
        self.split_ends = set()  # nodes with ends in several shards
        for path, conv_id in self.splitters:
            node = 0
            for k in range(0, len(path), STEP):
                key = (node, path[k : k + STEP])
                if key not in self.children:
                    self.children[key] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                node = self.children[key]
            if conv_id != LEAST_ID:
                self.split_ends.add(node)

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


@dataclass
class OpenNode:
    """A node on the current path. ``skeleton`` is its number there, or -1."""

    skeleton: int
    depth: int
    words: int
    least: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: object = None
    closed: list = field(default_factory=list)  # finished children that lack their parent's id

    def add_end(self, conv_id: int) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(str(conv_id).encode())
        else:
            self.ends.update(f",{conv_id}".encode())


class ShardWalk:
    """Nodes of conversations that come sorted by path and id; rows gather in ``out``."""

    def __init__(self, skeleton: Skeleton) -> None:
        self.skeleton, self.out = skeleton, []
        self.begin()

    def begin(self) -> None:
        self.path, self.stack = b"", [OpenNode(0, 0, 0)]

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        same, most = 0, min(len(path), len(self.path))
        if path[:most] == self.path[:most]:
            same = most
        else:
            while path[same : same + STEP] == self.path[same : same + STEP]:
                same += STEP
        while len(self.stack) > same // STEP + 1:
            self.close()
        for k in range(same, len(path), STEP):
            above = self.stack[-1]
            number = self.skeleton.children.get((above.skeleton, path[k : k + STEP]), -1) if above.skeleton >= 0 else -1
            self.stack.append(OpenNode(number, k // STEP + 1, words[k // STEP]))
        self.path = path
        top = self.stack[-1]
        top.n_convs += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        if top.skeleton in self.skeleton.split_ends:
            self.out.append((ENDS, top.skeleton, conv_id, *[None] * (len(COLUMNS) - 3)))
        else:
            top.add_end(conv_id)

    def close(self) -> None:
        node = self.stack.pop()
        ends = node.ends.hexdigest() if node.ends else None
        if node.skeleton >= 0:
            self.out += [(LOCAL, node.skeleton, *row) for row in node.closed]
            self.out.append((PARTIAL, node.skeleton, node.least, node.depth, None, node.n_convs, node.n_children, node.n_leaves, node.saved, node.words, ends))
        else:
            self.out += [(LOCAL, None, *row[:2], node.least, *row[3:]) for row in node.closed]
            node.saved += (node.n_convs - 1) * node.words
            node.n_leaves += not node.n_children
        if not self.stack:
            return
        above = self.stack[-1]
        above.n_convs += node.n_convs
        above.least = node.least if above.least is None else min(above.least, node.least)
        if node.skeleton < 0:
            above.n_children += 1
            above.n_leaves += node.n_leaves
            above.saved += node.saved
            above.closed.append((node.least, node.depth, None, node.n_convs, node.n_children, node.n_leaves, node.saved, None, ends or NO_ENDS))

    def end(self) -> None:
        """Close what is open, if any conversation came."""
        if self.stack[0].n_convs or len(self.stack) > 1:
            while self.stack:
                self.close()


def _batch(rows: list[tuple], schema: list[str], text: str = "ends_sha256") -> pa.RecordBatch:
    kinds = [pa.string() if c == text else pa.int32() if c == "kind" else pa.int64() for c in schema]
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema)


def paths_of(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as ``(digest, words)``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("placed"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        n_words(text).cast("int").alias("words"),
    ).where("conv_id IS NOT NULL")
    inside = F.array_sort(F.collect_list(F.struct("placed", "turn", "digest", "words")))
    return rows.groupBy("conv_id").agg(F.transform(inside, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(originals: DataFrame, *, family: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that begin with turns of the first of their family.

    Conversation ``c`` takes the first ``h = crc32(c) % heads`` turns of ``c - c % family`` (``%`` as in SQL, with
    the sign of ``c``) in place of its own.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = originals.select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, heads - 1).alias("head"))
    own = originals.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    joined = own.join(first, "first_id", "left")
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def splitters_of(paths: DataFrame, turns_a_shard: int, most_shards: int, sample_a_shard: int) -> list[tuple[bytes, int]]:
    """Splitters into shards of about equal work, from a sample of ``sample_a_shard`` paths a shard."""
    work = F.octet_length("path") / STEP + 1
    total = paths.agg(F.count(F.lit(1)).alias("n"), F.sum(work).alias("work")).first()
    if not total["n"]:
        return []
    least = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(most_shards, max(least, -(-int(total["work"]) // turns_a_shard)))
    rate = min(1.0, shards * sample_a_shard / total["n"])
    sample = paths.where(F.pmod(F.xxhash64(F.lit(7), "conv_id"), F.lit(1 << 31)) <= int(rate * (1 << 31)))
    found = sorted((bytes(r["path"]), r["conv_id"]) for r in sample.select("path", "conv_id").collect())
    ends, cum = [], 0.0
    for path, _ in found:
        cum += len(path) / STEP + 1
        ends.append(cum)
    places = [bisect_right(ends, cum * k / shards) for k in range(1, shards)]
    return [found[k] for k in sorted(set(places)) if 0 < k < len(found)]


def trie_nodes(
    paths: DataFrame, *, turns_a_shard: int = 200_000, most_shards: int = 4096, sample_a_shard: int = 16, skeleton_depth: int = 256
) -> DataFrame:
    """Every node of the trie of ``paths(conv_id, path, words)``, with the aggregates of its members and its subtree."""
    spark = paths.sparkSession
    skeleton = Skeleton(splitters_of(paths, turns_a_shard, most_shards, sample_a_shard), skeleton_depth)
    shared = spark.sparkContext.broadcast(skeleton)

    def part(found):
        known = shared.value
        for batch in found:
            ids, routes = batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()
            shards = [known.shard(p, c) for p, c in zip(routes, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

    def walk(found):
        walker, here = ShardWalk(shared.value), None
        for batch in found:
            for shard, conv_id, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != here:
                    walker.end()
                    walker.begin()
                    here = shard
                walker.add(conv_id, path, words)
            yield _batch(walker.out, COLUMNS)
            walker.out = []
        walker.end()
        yield _batch(walker.out, COLUMNS)

    parted = paths.select("conv_id", "path", "words").mapInArrow(part, "shard long, conv_id long, path binary, words array<int>")
    parted = parted.repartition(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    rows = materialize(parted.mapInArrow(walk, SCHEMA))

    def digest(found):
        here, ends = None, None
        for batch in found:
            out = []
            for number, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != here:
                    if ends:
                        out.append((here, ends.hexdigest()))
                    here, ends = number, hashlib.sha256(str(conv_id).encode())
                else:
                    ends.update(f",{conv_id}".encode())
            yield _batch(out, ["skeleton", "ends_sha256"])
        if ends:
            yield _batch([(here, ends.hexdigest())], ["skeleton", "ends_sha256"])

    split = rows.where(F.col("kind") == ENDS).select("skeleton", "conv_id").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
    split = split.mapInArrow(digest, "skeleton long, ends_sha256 string")
    partial = rows.where(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("words").alias("words"), F.max("ends_sha256").alias("ends_here"),
    )
    partial = partial.join(split, "skeleton", "left").withColumn("ends", F.coalesce("ends_sha256", "ends_here", F.lit(NO_ENDS)))

    def complete(found):
        known, at = shared.value, {}
        for batch in found:
            at.update((r["skeleton"], r) for r in batch.to_pylist())
        for number in sorted(at, reverse=True):
            r = at[number]
            r["n_leaves"] += not r["n_children"]
            r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
            if number:
                above = at[known.parents[number]]
                above["n_children"] += 1
                above["n_leaves"] += r["n_leaves"]
                above["saved_tokens"] += r["saved_tokens"]
        out = [
            (k, r["conv_id"], known.depths[k], at[known.parents[k]]["conv_id"] if k else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"])
            for k, r in at.items()
        ]
        yield _batch(out, ["skeleton", *NODE])

    done = materialize(partial.repartition(1).mapInArrow(complete, f"skeleton long, {NODE_SCHEMA}"))
    above = F.broadcast(done.select("skeleton", F.col("conv_id").alias("above")))  # as many rows as the skeleton has nodes
    local = rows.where(F.col("kind") == LOCAL).join(above, "skeleton", "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*NODE).unionByName(done.select(*NODE))


def prefix_trie(turns: DataFrame, **options) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations of ``turns(conv_id, turn, role, text)``."""
    originals = materialize(paths_of(turns))
    conversations = rebuilt(originals)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    paths = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    return trie_nodes(materialize(paths), **options)


#: crc32 of an ASCII text in DuckDB: the table comes from its rule, the text is folded byte by byte.
CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc_sql(text: str, table: str = "crc_table") -> str:
    """The unsigned crc32 of the ASCII SQL expression ``text``; ``table`` holds :data:`CRC_TABLE`."""
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), "
        f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"
    )


ORACLE = rf"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table),
turns AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
originals AS (
  SELECT conv_id, list(g ORDER BY turn NULLS FIRST, g) AS gs, list(w ORDER BY turn NULLS FIRST, g) AS ws FROM turns GROUP BY conv_id),
heads AS (SELECT *, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM originals, crc),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.gs, [])[1:o.h], o.gs[o.h + 1:]) AS gs, list_concat(coalesce(b.ws, [])[1:o.h], o.ws[o.h + 1:]) AS ws
  FROM heads o LEFT JOIN originals b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (SELECT conv_id, gs, ws, unnest(range(0, len(gs) + 1)) AS depth FROM rebuilt),
members AS (SELECT conv_id, depth, array_to_string(gs[1:depth], '') AS node, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w, len(gs) = depth AS ends FROM prefixes),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(array_to_string(list(conv_id ORDER BY conv_id) FILTER (ends), ','), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
families AS (SELECT node[1:32 * (depth - 1)] AS parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN families ON families.parent = nodes.node),
lines AS (SELECT node, depth, (n_convs - 1) * w AS saved, n_children = 0 AS leaf, unnest(range(0, depth + 1)) AS k FROM known),
subtrees AS (SELECT node[1:32 * k] AS node, k AS depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM lines GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM known k JOIN subtrees s ON s.node = k.node AND s.depth = k.depth
LEFT JOIN known p ON k.depth > 0 AND p.depth = k.depth - 1 AND p.node = k.node[1:32 * (k.depth - 1)]
"""
