"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are cut into pieces of at most ``capacity`` tokens. Leaves of bounded size pack their
pieces best-fit, emit bins that are nearly full and hand the rest to their parent, which treats
each underfull bin as one item and packs best-fit again, up to a single root.

Edge cases: a null text is an empty one (a piece with the end id alone); repeated rows are packed
each for itself; null ids are kept; an empty table gives an empty result; extra columns are left
out; documents longer than ``capacity`` give full pieces, with the shorter one first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospan.llm.tokens import batches, encoder
from ribospan.session import materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
OPEN_ROW = PIECE + ", node long, bin long, offset long, closed boolean"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document of ``docs(doc_id, text)``, from the task that tokenizes it."""

    def cut(found):
        known = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in found:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, j in batches(texts):
                for doc_id, raw in zip(ids[i:j], known.encode(texts[i:j]), strict=True):
                    tokens = np.concatenate([np.frombuffer(raw, known.dtype).astype("<u4"), end])
                    size = len(tokens)
                    first = size - (size - 1) // capacity * capacity
                    for piece, stop in enumerate(range(first, size + 1, capacity)):
                        start = 0 if piece == 0 else stop - capacity
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(tokens[start:stop].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, each into the fullest bin that takes it.

    The gaps in use are the bits of one integer, so the smallest gap that is large enough is
    found without a search.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, count = 0, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = used >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            target = by_gap[gap].pop()
            if not by_gap[gap]:
                used &= ~(1 << gap)
        else:
            gap, target, count = capacity, count, count + 1
        bins[k], offsets[k] = target, capacity - gap
        if gap > size:
            by_gap[gap - size].append(target)
            used |= 1 << (gap - size)
    return bins, offsets


def _pack_node(rows: pd.DataFrame, level: int, nodes: int, capacity: int, slack: int) -> pd.DataFrame:
    """One best-fit round over the bins of a node; a piece without a bin is a bin of its own."""
    names, inverse = np.unique(rows["bin"].to_numpy(), return_inverse=True)
    length = rows["length"].to_numpy()
    sizes = np.bincount(inverse, weights=length, minlength=len(names)).astype(np.int64)
    bins, offsets = best_fit(sizes, capacity)
    fills = np.bincount(bins, weights=sizes).astype(np.int64)
    open_bin = fills < capacity - slack
    if nodes == 1:
        open_bin[:] = False
    # After best-fit a node has at most one bin that is no more than half full, and only such
    # bins can complete others. So of the open bins of one fill, those beyond the number of
    # nodes can never be of use; they are final.
    else:
        order = np.argsort(fills, kind="stable")
        rank = np.empty(len(fills), np.int64)
        rank[order] = np.arange(len(fills)) - np.searchsorted(fills[order], fills[order])
        open_bin &= rank < nodes
    node = int(rows["node"].iloc[0])
    rows = rows.copy()
    rows["offset"] += offsets[inverse]
    rows["bin"] = (level << 58) + (node << 24) + bins[inverse]
    rows["closed"] = ~open_bin[bins[inverse]]
    return rows


def _packer(level: int, nodes: int, capacity: int, slack: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_node(rows, level, nodes, capacity, slack)

    return run


def pack(
    pieces: DataFrame, capacity: int = 2048, *, leaf_items: int = 50_000, fan_in: int = 8, slack: int | None = None
) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to pieces (see ``PIECE``), gapless in each sequence.

    ``slack``: a bin short of that many tokens counts as full (default: capacity / 128).
    A leaf has about ``leaf_items`` pieces, a node the open bins of ``fan_in`` children.
    """
    if leaf_items >= 1 << 24:
        raise ValueError("leaf_items must be below 2**24")
    slack = capacity // 128 if slack is None else slack
    stored = materialize(pieces.select(*[c.split()[0] for c in PIECE.split(", ")], F.monotonically_increasing_id().alias("bin")))
    full = stored.where(F.col("length") >= capacity).select(
        *stored.columns[:-1], (-1 - F.col("bin")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = stored.where(F.col("length") < capacity)
    nodes = max(1, -(-rest.count() // leaf_items))
    rows = rest.select(
        *stored.columns[:-1], F.pmod("bin", F.lit(nodes)).cast("long").alias("node"), "bin",
        F.lit(0).cast("long").alias("offset"), F.lit(False).alias("closed"),
    )
    level, done = 0, []
    while True:
        level += 1
        packed = materialize(rows.groupBy("node").applyInPandas(_packer(level, nodes, capacity, slack), OPEN_ROW))
        done.append(packed.where("closed"))
        if nodes == 1:
            break
        nodes = -(-nodes // fan_in)
        rows = packed.where(~F.col("closed")).withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
    for part in done:
        full = full.unionByName(part.select(*stored.columns[:-1], F.col("bin").alias("sequence_id"), "offset"))
    return full


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer, capacity, end_id), capacity, **options)
