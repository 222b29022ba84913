"""Token-ID output: length-delimited binary records with masked checksums and an offset index.

A shard is a file of records in ascending document order. A record is

    length of the payload   8 bytes, unsigned little-endian
    masked CRC-32 of those  4 bytes
    payload                 the ids, each in the vocabulary's width, little-endian
    masked CRC-32 of it     4 bytes

with ``masked(c) = rotate_right(c, 15) + 0xa282ead8 mod 2**32``, so that a checksum stored in
checksummed data does not upset either. The index (Parquet, one row a record) names shard, byte
offset, width and number of ids, so any reader can fetch records in any order.

Edge cases: a null text is an empty one (its record holds the end id alone); null ids sort first;
rows with equal ids are ordered by a hash of their text and each keeps its own record; an empty
table gives no shard and an empty index; extra columns are left out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.llm.tokens import batches, encoder
from ribospan.session import materialize, new_path

INDEX = "doc_id long, shard int, byte_offset long, width int, local_start long, n_tokens long"
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(read, where: str) -> bytes:
    """The payload at the reader's place; ``read(n)`` gives the next n bytes."""
    head = read(12)
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(zlib.crc32(head[:8])):
        raise ValueError(f"damaged record length in {where}")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(zlib.crc32(body[:size])):
        raise ValueError(f"damaged record in {where}")
    return body[:size]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.ids"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 0, shard_bytes: int = 24 << 20
) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards of ids in ascending ``doc_id`` and return the stored index.

    The only shuffle deals texts out by ranges of ``doc_id``, a range a shard of about
    ``shard_bytes`` of text. A task writes its shard under a name of its own attempt and renames
    it when complete, so a repeated task leaves the same file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))

    def write(found):
        from pyspark import TaskContext

        context, known = TaskContext.get(), encoder(tokenizer)
        shard, out, place, local = context.partitionId(), None, 0, 0
        end = np.array([end_id], known.dtype).tobytes()
        for batch in found:
            texts = batch.column(1).to_pylist()
            index: list[tuple[int, int]] = []
            if out is None and texts:
                store, base = _store(folder)
                store.create_dir(base, recursive=True)
                attempt = f"{base}/{shard_name(shard)}.{context.taskAttemptId()}"
                out = store.open_output_stream(attempt)
            for i, j in batches(texts):
                for ids in known.encode(texts[i:j]):
                    record = frame(ids + end)
                    out.write(record)
                    index.append((place, len(ids) // known.dtype.itemsize + 1))
                    place += len(record)
            offsets, counts = np.array(index, np.int64).reshape(-1, 2).T
            starts = local + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
            local += int(counts.sum())
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, shard, np.int32)), pa.array(offsets),
                 pa.array(np.full(n, known.dtype.itemsize, np.int32)), pa.array(starts.astype(np.int64)), pa.array(counts)],
                names=["doc_id", "shard", "byte_offset", "width", "local_start", "n_tokens"],
            )
        if out is not None:
            out.close()
            store.move(attempt, f"{base}/{shard_name(shard)}")

    index = (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
        .mapInArrow(write, INDEX)
    )
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def read_token_files(index: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Fetch the records that ``index`` names, checking both checksums.

    Returns ``doc_id, shard, local_start, n_tokens, ids_crc32`` (over unsigned 32-bit ids), with
    one open file a task. Rows are dealt out by ranges of shard and offset.
    """
    place = ["shard", "byte_offset"]
    dealt = index.repartitionByRange(parts, *place) if parts else index.repartitionByRange(*place)

    def read(found):
        handle, opened = None, None
        for batch in found:
            shards, offsets, widths = (batch.column(k).to_pylist() for k in ("shard", "byte_offset", "width"))
            counts, sums = [], []
            for shard, offset, width in zip(shards, offsets, widths, strict=True):
                if shard != opened:
                    if handle:
                        handle.close()
                    store, base = _store(folder)
                    handle, opened = store.open_input_file(f"{base}/{shard_name(shard)}"), shard
                handle.seek(offset)
                ids = np.frombuffer(unframe(handle.read, shard_name(shard)), f"<u{width}").astype("<u4")
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), batch.column("local_start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"],
            )
        if handle:
            handle.close()

    return dealt.sortWithinPartitions(*place).mapInArrow(
        read, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long"
    )


def token_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files, read them back and return a row a document with its place in the whole.

    The running sum over shards (a row each) is the only global one; inside a shard the index
    holds it already.
    """
    from pyspark.sql import Window

    folder = folder or new_path(docs.sparkSession, "tokens")
    index = write_token_files(docs, folder, tokenizer, **options)
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    bases = materialize(sizes.select("shard", before.alias("base")))
    parts = max(1, bases.count())
    rows = read_token_files(index, folder, parts).join(bases, "shard")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
