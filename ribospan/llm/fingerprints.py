"""Document fingerprints: SimHash over weighted terms, searched through permuted block tables.

Terms are shingles of five words, weighted by how often they occur; each votes with its 128-bit
hash on every bit, and a bit is set where the votes for it win. Short texts have few shingles, so
there the votes are shared with character 4-grams: all of them at no words, none from
``SHORT_WORDS`` = 40 words on. The likeness of two fingerprints
is the cosine of their term vectors as the differing bits estimate it, ``cos(pi * d / 128)``, and
0 beyond a right angle.

For the search the fingerprint is cut into four blocks and stored in four tables, each with
another block in front. Fingerprints within ``RADIUS`` = 3 bits agree in at least one block, so
they meet in one of the tables; every meeting is verified over all bits.

Edge cases: a null text is an empty one; a text without words has fingerprint zero; fewer than
five words give one shingle; null ids come last in the order of documents and have no smaller
next; rows with equal ids are ordered by a hash of their text; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribospan.llm.hamming import BLOCK, counts_of_links, links
from ribospan.llm.simhash import shingle_bytes
from ribospan.session import materialize

BITS = 128
RADIUS = 3
TERM_WORDS = 5
SHORT_WORDS = 40


def _share(parts: list[bytes]) -> np.ndarray:
    """Share of the terms' votes for each bit."""
    import xxhash

    raw = b"".join([xxhash.xxh3_128_digest(p) for p in parts])
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1).mean(axis=0)


def fingerprint(text: bytes) -> bytes:
    """The 16 bytes of a text's fingerprint."""
    parts = shingle_bytes(text, TERM_WORDS)
    if not parts:
        return bytes(BITS // 8)
    votes, n = _share(parts), len(parts) + TERM_WORDS - 1
    if n < SHORT_WORDS:
        line = b" ".join(text.lower().split())
        grams = [line[i : i + 4] for i in range(max(1, len(line) - 3))]
        votes = (n * votes + (SHORT_WORDS - n) * _share(grams)) / SHORT_WORDS
    return np.packbits(votes > 0.5).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * differ / BITS))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, high, low`` (the two halves as signed longs) of every row of ``docs(doc_id, text)``."""

    def run(found):
        for batch in found:
            raw = b"".join([fingerprint(t) for t in batch.column(1).to_pylist()])
            halves = np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "high", "low"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, high long, low long")


def block_keys():
    """The front block of each table, with the table's number above it."""
    mask = F.lit((1 << 32) - 1)
    blocks = [F.shiftrightunsigned("high", 32), F.col("high").bitwiseAND(mask), F.shiftrightunsigned("low", 32), F.col("low").bitwiseAND(mask)]
    return F.array(*[b.bitwiseOR(F.lit(t << 32)) for t, b in enumerate(blocks)])


def meets_first(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs within the radius that meet in this key's table and in none before it."""
    differ = a ^ b
    mask, shift = np.uint64((1 << 32) - 1), np.uint64(32)
    blocks = np.stack([differ[:, 0] >> shift, differ[:, 0] & mask, differ[:, 1] >> shift, differ[:, 1] & mask], axis=1)
    return (np.argmax(blocks == 0, axis=1) == key >> 32) & (np.bitwise_count(differ).sum(axis=1) <= RADIUS)


def within_radius(fps: DataFrame) -> DataFrame:
    """``a_high, a_low, b_high, b_low``: all pairs of distinct fingerprints of ``fps(high, low)`` within the radius."""
    return links(_keyed(fps), ["high", "low"], meets_first, every=True)


def count_within_radius(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``high, low, n``: how many other distinct fingerprints of ``fps(high, low)`` lie within the radius, where any do."""
    return counts_of_links(_keyed(fps), ["high", "low"], meets_first, block)


def _keyed(fps: DataFrame) -> DataFrame:
    return fps.select("high", "low").distinct().select("high", "low", F.explode(block_keys()).alias("key"))


def compare_with_next(docs: DataFrame, part_bytes: int = 24 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited form, and what they have in common.

    The edited text has the last third of its code points replaced by the first as many of the
    next document, in descending order of ids (after the last: the first). Texts are dealt out
    once, by ranges of ids, and compared in order; the last document of a range meets the first
    one of the next range in a second step that has a row a range.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    parts = max(1, -(-(total or 0) // part_bytes))

    def walk(found):
        from pyspark import TaskContext

        out, held, first = [], None, None
        for batch in found:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = (doc_id, text, fingerprint(text.encode()))
                if held is None:
                    first = row
                else:
                    out.append((*_compared(*held, *row[1:]), None, None, None))
                held = row
            if out:
                yield _batch(out, WALKED)
                out = []
        if held is not None:
            yield _batch([(held[0], *[None] * (len(COMPARED) - 1), TaskContext.get().partitionId(), held[1], first[1])], WALKED)

    def close(found):
        for batch in found:
            out = []
            for doc_id, text, follows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out.append(_compared(doc_id, text, fingerprint(text.encode()), follows, fingerprint(follows.encode())))
            yield _batch(out, COMPARED)

    walked = materialize(
        rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("doc_id", "text")
        .mapInArrow(walk, SCHEMA + ", part int, last_text string, first_text string")
    )
    edges = walked.where(F.col("part").isNotNull()).select("doc_id", "part", "last_text", "first_text")
    in_order = Window.orderBy("part")
    following = edges.select(
        "part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order)).alias("next_part")
    )
    met = (
        edges.select("doc_id", "part", "last_text")
        .join(following, "part")
        .join(edges.select(F.col("part").alias("next_part"), "first_text"), "next_part")
        .select("doc_id", "last_text", "first_text")
    )
    inside = walked.where(F.col("part").isNull()).select(*COMPARED.names)
    return inside.unionByName(met.mapInArrow(close, SCHEMA))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
COMPARED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


WALKED = pa.schema([*COMPARED, ("part", pa.int32()), ("last_text", pa.string()), ("first_text", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _compared(doc_id: int | None, text: str, mark: bytes, follows: str, follows_mark: bytes) -> tuple:
    cut = len(text) // 3
    edited = (text[: len(text) - cut] + follows[:cut]).encode()
    edited_mark = fingerprint(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark.hex(), edited_mark.hex(),
        likeness(mark, edited_mark), likeness(mark, follows_mark),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """``compare_with_next`` with ``n_links``: the number of other fingerprints within the radius."""
    compared = materialize(compare_with_next(docs))
    half = [F.conv(F.substring("fingerprint", i, 16), 16, -10).cast("long").alias(c) for i, c in ((1, "high"), (17, "low"))]
    counts = count_within_radius(compared.select(*half))
    mark = F.lower(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0")))
    counts = counts.select(mark.alias("fingerprint"), "n")
    return compared.join(counts, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
    )
