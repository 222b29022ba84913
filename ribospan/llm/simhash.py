"""SimHash near-duplicates of word shingles, found by deletion-variant signatures.

A fingerprint has 64 bits; two are linked at ``RADIUS`` = 3 or fewer differing bits. Cut into two
segments of 32 bits, one segment of a linked pair differs in at most one bit. So each segment is
indexed 32 times, each time with one bit as a wildcard: linked fingerprints are equal in at least
one of these 64 keys, and an equality join and a count of the differing bits find them all.
Equal fingerprints are one row of the join, and a pair is looked at under one of its keys only.

Edge cases: a null text is an empty one; a text without words has fingerprint zero and is linked
like any other; fewer words than a shingle has give one shingle; null ids belong to the component
of their fingerprint, whose id is the smallest that is not null; repeated rows keep a row each;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.llm.components import connected_components
from ribospan.llm.hamming import links
from ribospan.session import materialize

RADIUS = 3
SEGMENT = 32


def shingle_bytes(text: bytes, size: int) -> list[bytes]:
    """Shingles of ``size`` words of a text, A-Z lower-cased, words as bytes joined by a space."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: len(words) - size + 1].tolist()
    return [line[i:j] for i, j in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of the hashes (rows of big-endian bytes), as bytes."""
    if not len(hashes):
        return np.zeros(hashes.shape[1], np.uint8)
    votes = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes))


def fingerprints(docs: DataFrame, shingle: int = 3, *carried: str) -> DataFrame:
    """``carried, fp`` (the 64 bits as a signed long) of every row of ``docs(text, carried)``; longs are carried."""

    def run(found):
        import xxhash

        one = xxhash.xxh64_intdigest
        for batch in found:
            out = []
            for text in batch.column(0).to_pylist():
                parts = shingle_bytes(text, shingle)
                hashes = np.fromiter((one(p, 42) for p in parts), np.uint64, len(parts))
                out.append(majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)))
            fp = np.concatenate(out or [np.empty(0, np.uint8)]).view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*carried, "fp"])

    rows = docs.select(
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), *[F.col(c).cast("long").alias(c) for c in carried]
    )
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*carried, "fp")))


def variant_keys(fp: str = "fp"):
    """The 64 keys: segment and wildcard bit above, the segment without that bit below."""
    high, low = F.shiftrightunsigned(F.col(fp), SEGMENT), F.col(fp).bitwiseAND(F.lit((1 << SEGMENT) - 1))
    return F.array(*[
        F.lit((s * SEGMENT + p) << SEGMENT).bitwiseOR(part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) & ~(1 << p))))
        for s, part in enumerate((high, low))
        for p in range(SEGMENT)
    ])


def answers(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs within the radius whose first agreeing segment and wildcard bit are this key's."""
    differ = a[:, 0] ^ b[:, 0]
    number = key.astype(np.uint64) >> np.uint64(SEGMENT)
    low = number >= SEGMENT
    high_part, low_part = differ >> np.uint64(SEGMENT), differ & np.uint64((1 << SEGMENT) - 1)
    part = np.where(low, low_part, high_part)
    place = number & np.uint64(SEGMENT - 1)
    mine = np.where(part == 0, place == 0, part == np.uint64(1) << place)
    first = ~low | (np.bitwise_count(high_part) > 1)
    return mine & first & (np.bitwise_count(differ) <= RADIUS)


def linked_roots(rows: DataFrame) -> DataFrame:
    """``fp, root`` of every distinct ``fp`` of ``rows``: the same root for all that links connect."""
    distinct = materialize(rows.select("fp").distinct())
    keyed = distinct.select("fp", F.explode(variant_keys()).alias("key"))
    found = links(keyed, ["fp"], answers).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    roots = connected_components(found).withColumnRenamed("node", "fp")
    return materialize(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``."""
    rows = materialize(fingerprints(docs, shingle, "doc_id"))
    roots = linked_roots(rows)
    # One row a fingerprint before roots are met, so copies do not gather under one root.
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    components = materialize(roots.join(component, "root").select("fp", "component_id"))
    return rows.join(components, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; all columns kept."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    doc_id = F.col("row").getField("doc_id").cast("long")
    rows = rows.select("row", F.xxhash64(doc_id, F.col("row").getField("text")).alias("key"))
    marks = fingerprints(
        rows.select("key", F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id"), F.col("row").getField("text").alias("text")),
        shingle, "key", "id",
    )
    marks = materialize(marks)
    roots = linked_roots(marks)
    first = marks.groupBy("fp").agg(F.min(F.struct("id", "key")).alias("first"))
    copies = marks.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    chosen = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.key")
    chosen = materialize(chosen.join(copies, "key"))
    kept = rows.join(chosen.hint("shuffle_hash"), "key")
    single = kept.where("copies = 1").select("row")
    repeated = kept.where("copies > 1").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


