"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance: vectors are divided by a norm M and get one more
coordinate, ``sqrt(1 - |x|^2 / M^2)``; queries are divided by their own norm and get a 0. There is
an index for each range of norms, M halving from one to the next, so that a few very long vectors
do not move all others to one place; a query visits the same cells in each. A table hashes a point by ``floor((a . x + b) / w)`` for a few random Gaussian directions
``a``. A query visits, in each table, its own bucket and the buckets next to it in order of
estimated success: by the sum of squared distances to the cell walls that lie between.

A first visit to the home buckets gives every query a bound (the score of its last wanted
neighbour so far); the other buckets return only what reaches it. A query that has fewer than
``k`` others after that is compared with all points, in blocks. Candidates of all tables are
merged and ranked by their inner product in double precision on the original vectors. Wherever some
are cut off, those at the border are measured as in the end, one product added after another, and of equal
ones the smaller ids stay.

Equal vectors are one point of the index with its smallest ids, as many as an answer can hold.
Vectors of different length have no inner product: each length is an index of its own. Buckets larger than ``block`` points or queries are cut into blocks, and each pair of blocks is
one task's work; nothing is left out.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, as
rows or as queries, and so do null ids; fewer candidates than wanted (of the query's length) are all returned;
ties go to the smaller id among all that are visited; rows equal in id and vector count once; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribospan.session import materialize

FOUND = "query long, point long, first long, score double"
RANGE_BITS, MAX_RANGE = 52, 2047
MOVES = np.array(list(product(range(-3, 4), repeat=3)))
CELLS = 1 << 22


class Tables:
    """The random directions; the same in every task."""

    def __init__(self, dims: int, tables: int, width: float, probes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(tables, dims + 1, 3))
        self.shifts = rng.uniform(0, width, (tables, 3))
        self.width, self.probes = width, probes

    def cells(self, points: np.ndarray, table: int) -> np.ndarray:
        return (points @ self.directions[table] + self.shifts[table]) / self.width

    @staticmethod
    def bucket(table: int, cells: np.ndarray) -> np.ndarray:
        return (table << 48) + ((cells.astype(np.int64) + (1 << 15)) << np.array([32, 16, 0])).sum(axis=-1)

    def visits(self, queries: np.ndarray, table: int) -> np.ndarray:
        """Buckets of each query, a row a query, the likeliest first."""
        place = self.cells(queries, table)
        home = np.floor(place)
        inside = place - home
        steps = np.arange(-3, 4)[:, None, None]
        walls = np.where(steps > 0, steps - inside, np.where(steps < 0, inside - steps - 1, 0.0)) ** 2
        cost = sum(walls[MOVES[:, d] + 3, :, d] for d in range(3)).T
        best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        return self.bucket(table, home[:, None, :] + MOVES[best])


def norm_range(x: np.ndarray, largest: float) -> np.ndarray:
    """How often the largest norm can be halved and still be no less than each row's."""
    top = np.abs(x).max(axis=1)
    with np.errstate(all="ignore"):
        norm = top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))
        halvings = np.floor(np.log2(largest) - np.log2(norm))
    return np.clip(np.nan_to_num(halvings, nan=0.0, posinf=MAX_RANGE), 0, MAX_RANGE).astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vec = F.col(vector_col).cast("array<double>")
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & ok)


def points_of(rows: DataFrame, most: int) -> DataFrame:
    """``point, vec, ids, first``: a row a distinct vector, with its ``most`` smallest ids and the first of them."""
    keyed = rows.select("id", "vec", F.xxhash64("vec").alias("h"))
    ranked = keyed.withColumn("k", F.dense_rank().over(Window.partitionBy("h").orderBy("id"))).where(F.col("k") <= most)
    return ranked.groupBy("h").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids")).select(
        F.col("h").alias("point"), "vec", "ids", F.element_at("ids", 1).alias("first")
    )


def _by_length(column: pa.Array):
    """``rows, matrix`` of the vectors of each length in a column of lists."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), n)


def _dealt(points: DataFrame, queries: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block pairs (``v``, ``q``) of their bucket."""
    place = ["bucket", "dims"]
    counts = points.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).join(
        queries.groupBy(*place).agg(F.count(F.lit(1)).alias("m")), place
    )
    counts = materialize(counts.select(*place, F.ceil(F.col("n") / block).alias("vs"), F.ceil(F.col("m") / block).alias("qs")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    left = queries.join(counts, place).withColumn("q", own("query", "qs")).withColumn("v", every("vs")).drop("vs", "qs")
    right = points.join(counts, place).withColumn("v", own("point", "vs")).withColumn("q", every("qs")).drop("vs", "qs")
    return left, right


def best_of(asked: np.ndarray, stored: np.ndarray, first: np.ndarray, bound: np.ndarray, wanted: int) -> tuple[np.ndarray, ...]:
    """``row, column, score`` of the ``wanted`` best of ``stored`` for each row of ``asked`` that reach its bound.

    Scores are sums in order of the components. Of equal scores the smaller ``first`` goes before.
    """
    rough = asked @ stored.T
    norms = np.linalg.norm(asked, axis=1) * np.linalg.norm(stored, axis=1).max()
    slack = 4 * stored.shape[1] * np.finfo(float).eps * norms
    cut = bound.copy()
    if rough.shape[1] > wanted:
        cut = np.maximum(cut, -np.partition(-rough, wanted - 1, axis=1)[:, wanted - 1])
    row, column = np.nonzero(rough >= (cut - slack)[:, None])
    score = np.empty(len(row))
    step = max(1, CELLS // max(1, stored.shape[1]))
    for k in range(0, len(row), step):
        product = asked[row[k : k + step]] * stored[column[k : k + step]]
        score[k : k + step] = np.add.accumulate(product, axis=1)[:, -1]
    order = np.lexsort((first[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (place < wanted) & (score >= bound[row])
    return row[keep], column[keep], score[keep]


def _visit(points: DataFrame, queries: DataFrame, wanted: int, block: int) -> DataFrame:
    """The best points of each query in each bucket it visits, of those that reach its bound."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
        if len(left) and len(right):
            asked, stored = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
            names, first, own, bound = right["point"].to_numpy(), right["first"].to_numpy(), left["query"].to_numpy(), left["bound"].to_numpy()
            for i in range(0, len(asked), 256):
                row, column, score = best_of(asked[i : i + 256], stored, first, bound[i : i + 256], wanted)
                out.append((own[i + row], names[column], first[column], score))
        q, p, f, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query": q, "point": p, "first": f, "score": s})

    left, right = _dealt(points, queries, block)
    keys = ["bucket", "dims", "v", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, FOUND)


def _best(found: DataFrame, wanted: int) -> DataFrame:
    merged = found.groupBy("query", "point").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))
    return merged.withColumn("k", rank).where(F.col("k") <= wanted)


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, tables: int = 6, width: float = 1.0, probes: int = 24,
    seed: int = 11, block: int = 8192,
) -> DataFrame:
    """The ``k`` nearest of ``vectors(id, vec)`` to each of ``queries(id, vec)``, their own ids apart.

    Returns ``query_id, rank, vec_id, score``. Both inputs come from :func:`usable`.
    """
    vectors, queries = materialize(vectors), materialize(queries)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    largest = vectors.agg(F.max(norm).alias("norm")).first()["norm"] or 1.0
    wanted = k + 1  # the query itself may be among them
    points = materialize(points_of(vectors, wanted))
    asked = materialize(queries.select("vec", F.xxhash64("vec").alias("query")).dropDuplicates(["query"]))
    kinds: dict = {}

    def index(dims: int) -> Tables:
        if dims not in kinds:
            kinds[dims] = Tables(dims, tables, width, probes, seed)
        return kinds[dims]

    def store(found):
        for batch in found:
            for rows, x in _by_length(batch.column("vec")):
                span, own = norm_range(x, largest), batch.take(pa.array(rows))
                y = x / np.ldexp(largest, -span)[:, None]
                y = np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1, keepdims=True)))])
                lsh = index(x.shape[1])
                dims = pa.array(np.full(len(rows), x.shape[1], np.int32))
                for t in range(tables):
                    bucket = lsh.bucket(t, np.floor(lsh.cells(y, t))) + (span << RANGE_BITS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), dims, own.column("point"), own.column("first"), own.column("vec")],
                        names=["bucket", "dims", "point", "first", "vec"],
                    )

    def probe(found):
        for batch in found:
            for rows, x in _by_length(batch.column("vec")):
                y = x / np.abs(x).max(axis=1, keepdims=True)
                y = np.hstack([y / np.linalg.norm(y, axis=1, keepdims=True), np.zeros((len(y), 1))])
                lsh, names = index(x.shape[1]), batch.column("query").take(pa.array(rows))
                for t, span in product(range(tables), spans):
                    bucket = lsh.visits(y, t) + (span << RANGE_BITS)
                    n = bucket.shape[1]
                    at = np.repeat(np.arange(len(y)), n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.ravel()), pa.array(np.full(len(at), x.shape[1], np.int32)),
                         pa.array(np.tile(np.arange(n, dtype=np.int32), len(y))), names.take(pa.array(at))],
                        names=["bucket", "dims", "visit", "query"],
                    )

    stored = points.select("point", "first", "vec").mapInArrow(store, "bucket long, dims int, point long, first long, vec array<double>")
    stored = materialize(stored)
    spans = [r[0] for r in stored.select(F.shiftrightunsigned("bucket", RANGE_BITS)).distinct().collect()]
    visits = materialize(asked.mapInArrow(probe, "bucket long, dims int, visit int, query long"))
    home = visits.where("visit = 0").join(asked, "query").withColumn("bound", F.lit(float("-inf")))
    first = materialize(_best(_visit(stored, home.drop("visit"), wanted, block), wanted))
    bounds = first.where(F.col("k") == wanted).select("query", F.col("score").alias("bound"))
    others = asked.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    others = visits.where("visit > 0").join(others, "query").drop("visit")
    found = first.drop("k").unionByName(_visit(stored, others, wanted, block))
    best = materialize(_best(found, wanted).drop("k"))
    # What has fewer others than wanted meets all points.
    held = best.join(points.select("point", F.size("ids").alias("n")), "point").groupBy("query").agg(F.sum("n").alias("n"))
    short = materialize(asked.join(held, "query", "left").where(F.coalesce("n", F.lit(0)) <= k).select("query", "vec"))
    if short.head(1):
        whole, dims = F.lit(0).cast("long").alias("bucket"), F.size("vec").alias("dims")
        everything = points.select(whole, dims, "point", "first", "vec")
        rest = _visit(everything, short.select(whole, dims, "query", "vec", F.lit(float("-inf")).alias("bound")), wanted, block)
        best = materialize(_best(best.unionByName(rest), wanted))
    best = best.select("query", "point")
    # Exact measure, one order of summation for every pair; then each query without itself.
    dot = F.aggregate(F.zip_with("q_vec", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = best.join(points, "point").join(asked.withColumnRenamed("vec", "q_vec"), "query")
    scored = materialize(scored.select("query", dot.alias("score"), "ids"))
    answers = queries.select(F.col("id").alias("query_id"), F.xxhash64("vec").alias("query")).distinct().join(scored, "query")
    answers = answers.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20, **options) -> DataFrame:
    """Neighbours of the rows of ``vectors(vec_id, embedding)`` whose id ``every`` divides, among all rows."""
    rows = usable(vectors, "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("id") % every == 0), **options)
