"""Train, validate and transfer one linear k-mer model per dataset, all in one fit.

Models are rows of a table ``(dataset_id, w array, b)``. A step of the fit is one pass over the
records: each one meets its dataset's row; loss, gradient and curvature are sums by dataset, formed in
the tasks before they move. Neither names nor coefficients pass through the driver, and the number of
datasets has no bound. Newton steps, halved while they do not lower the loss, go on until every
dataset's gradient is small enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospan.functions import scores as SC
from ribospan.functions import sequence as S
from ribospan.functions.special import word_numbers
from ribospan.operators.metrics import binary_metrics
from ribospan.operators.splits import stratified_split3
from ribospan.plans.variant_scoring import kmer_logit
from ribospan.session import materialize


def kmer_counts(seq: str | Column, k: int) -> Column:
    """Occurrences of every k-mer of :func:`normalize_rna`, in the order of :func:`vocabulary_kmers`."""
    return word_numbers(S.RNA, k, {"T": "U", "N": "A"})(seq)


def counted(df: DataFrame, k: int) -> DataFrame:
    """``df`` with :func:`kmer_counts` of ``seq`` as ``_counts``, unless it has that column."""
    return df if "_counts" in df.columns else df.withColumn("_counts", kmer_counts("seq", k))


def labelled_counts(train: DataFrame, k: int) -> DataFrame:
    """Records ``(dataset_id, label, c)`` that a fit can use."""
    raw = counted(train, k).select("dataset_id", F.col("label").cast("double").alias("label"), F.col("_counts").alias("c"))
    raw = raw.where(F.col("label").isNotNull() & F.col("dataset_id").isNotNull())
    return raw if "_counts" in train.columns else materialize(raw)


def count_scales(raw: DataFrame, k: int) -> DataFrame:
    """Each dataset's number of records and the mean and deviation of its counts."""
    cells = range(4**k)
    each = lambda f: F.array(*[f(F.col("c")[i]) for i in cells])
    scales = raw.groupBy("dataset_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"), each(F.avg).alias("mean"), each(F.stddev_pop).alias("raw_sd")
    )
    # A k-mer that never varies says nothing: its deviation counts as 1 and its x is 0.
    sd = F.transform("raw_sd", lambda d: F.when(d > 1e-9, d).otherwise(F.lit(1.0)))
    return materialize(scales.select("dataset_id", "n", "mean", sd.alias("sd")))


def standardised(raw: DataFrame, scales: DataFrame) -> DataFrame:
    """Records ``(dataset_id, label, x)`` with counts as deviations."""
    centred = F.zip_with("c", "mean", lambda x, m: x - m)
    x = F.zip_with(centred, "sd", lambda d, sd: d / sd)
    return materialize(raw.join(scales, "dataset_id").select("dataset_id", "label", x.alias("x")))


def count_blocks(raw: DataFrame, k: int, most_cells: int = 1 << 15) -> DataFrame:
    """``dataset_id, labels, counts``: records of a dataset, up to ``most_cells`` counts a row.

    Every step of a fit reads all records; a model then meets blocks instead of single records. Labels are
    bytes of doubles, counts are bytes of the smallest unsigned integers that hold those of the block.
    """
    most = max(1, most_cells // 4**k)

    def pack(found):
        held: dict = {}  # of each dataset the records of less than a block
        waiting = 0

        def block(name: str, parts: list):
            label, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            for a in range(0, len(label), most):
                part = c[a : a + most]
                yield name, label[a : a + most].tobytes(), part.astype(np.min_scalar_type(int(part.max()))).tobytes()

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["dataset_id", "labels", "counts"])

        for batch in found:
            if not batch.num_rows:
                continue
            which = batch.column("dataset_id").dictionary_encode()
            names, which = which.dictionary.to_pylist(), which.indices.to_numpy()
            label = batch.column("label").to_numpy()
            c = batch.column("c").flatten().to_numpy().reshape(len(label), -1)
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(names) + 1))
            full = []
            for i, name in enumerate(names):
                mine = order[cuts[i] : cuts[i + 1]]
                parts = held.setdefault(name, [])
                parts.append((label[mine], c[mine]))
                waiting += len(mine)
                size = sum(len(p[0]) for p in parts)
                if size >= most:
                    full += block(name, held.pop(name))
                    waiting -= size
            if full:
                yield batch_of(full)
            if waiting > 64 * most:
                yield batch_of([row for name, parts in held.items() for row in block(name, parts)])
                held, waiting = {}, 0
        yield batch_of([row for name, parts in held.items() for row in block(name, parts)])

    return materialize(raw.select("dataset_id", "label", "c").mapInArrow(pack, "dataset_id string, labels binary, counts binary"))


def gradient_step(
    rows: DataFrame, models: DataFrame, k: int, positive_weight: float, rate: float, reg: float
) -> DataFrame:
    """``models(dataset_id, w, b)`` after one step down the weighted mean log loss plus ``reg / 2 |w|^2``."""
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.col("b"), lambda acc, v: acc + v)
    share = F.when(F.col("label") == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))
    off = rows.join(models, "dataset_id").select(
        "dataset_id", "x", share.alias("s"), (share * (1 / (1 + F.exp(-dot)) - F.col("label"))).alias("off")
    )
    slope = off.groupBy("dataset_id").agg(
        F.array(*[F.sum(F.col("off") * F.col("x")[i]) for i in range(4**k)]).alias("g"),
        F.sum("off").alias("g_b"), F.sum("s").alias("total"),
    )
    move = lambda w, g: w - F.lit(rate) * (g / F.col("total") + F.lit(reg) * w)
    return models.join(slope, "dataset_id").select(
        "dataset_id", F.zip_with("w", "g", move).alias("w"), (F.col("b") - F.lit(rate) * F.col("g_b") / F.col("total")).alias("b")
    )


def newton_sums(blocks: DataFrame, models: DataFrame, scales: DataFrame, k: int, positive_weight: float, most_held: int = 500) -> DataFrame:
    """``dataset_id, cell, value``: the sums that a Newton step needs, at each dataset's weights.

    ``blocks`` are :func:`count_blocks`. With d weights, the bias last, cells from 0 are the d x d curvature, then d of
    the gradient, the loss and the total weight. Tasks add up their records of up to ``most_held`` datasets before they
    pass sums on.
    """
    d = 4**k + 1
    # Two joins with stored tables: of their own join Spark would not know that it is small.
    joined = blocks.join(models.select("dataset_id", F.concat("w", F.array("b")).alias("w")), "dataset_id")
    joined = joined.join(scales.select("dataset_id", "mean", "sd"), "dataset_id")

    def flush(held: dict) -> pa.RecordBatch:
        names = [n for n in held for _ in range(d * d + d + 2)]
        cells = np.tile(np.arange(d * d + d + 2, dtype=np.int32), len(held))
        values = np.concatenate([np.concatenate([h.ravel(), g, [loss, total]]) for h, g, loss, total in held.values()] or [np.empty(0)])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cells), pa.array(values)], names=["dataset_id", "cell", "value"])

    def run(found):
        held: dict = {}
        for batch in found:
            for name, labels, counts, *model in zip(*(batch.column(c) for c in ("dataset_id", "labels", "counts", "w", "mean", "sd")), strict=True):
                name, label = name.as_py(), np.frombuffer(labels.as_buffer())
                w, mean, sd = (m.values.to_numpy() for m in model)
                c = np.frombuffer(counts.as_buffer(), f"u{counts.as_buffer().size // (len(label) * (d - 1))}")
                x = np.ones((len(label), d))
                x[:, :-1] = (c.reshape(len(label), -1) - mean) / sd
                z = x @ w
                s = np.where(label == 1, positive_weight, 1.0)
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = s * (np.logaddexp(0.0, z) - label * z)
                sums = ((x * (s * p * (1 - p))[:, None]).T @ x, x.T @ (s * (p - label)), loss.sum(), s.sum())
                held[name] = tuple(a + b for a, b in zip(held[name], sums, strict=True)) if name in held else sums
                if len(held) > most_held:
                    yield flush(held)
                    held = {}
        yield flush(held)

    sums = joined.select("dataset_id", "labels", "counts", "w", "mean", "sd").mapInArrow(run, "dataset_id string, cell int, value double")
    return sums.groupBy("dataset_id", "cell").agg(F.sum("value").alias("value"))


MODEL = "dataset_id string, w array<double>, b double, base array<double>, step array<double>, rate double, loss double, gradient_norm double, done boolean"
_ARRAYS, _NUMBERS = ("w", "base", "step"), ("b", "rate", "loss", "gradient_norm")


def newton_step(models: DataFrame, sums: DataFrame, k: int, reg: float, tolerance: float) -> DataFrame:
    """``models`` moved by one step; ``sums`` comes from :func:`newton_sums` at their weights.

    A model whose loss rose goes half the way back to where it came from. ``gradient_norm``
    is the largest slope at the weights the model came with; below ``tolerance`` it is done and stays.
    """
    d = 4**k + 1
    kinds = {"dataset_id": pa.string(), "done": pa.bool_()} | {c: pa.list_(pa.float64()) for c in _ARRAYS} | {c: pa.float64() for c in _NUMBERS}

    def move(model: pa.Table, cells: pa.Table) -> pa.Table:
        schema = pa.schema([(c, kinds[c]) for c in model.column_names])
        if not model.num_rows or not cells.num_rows:
            return pa.Table.from_pylist(model.to_pylist(), schema=schema)
        row = model.to_pylist()[0]
        v = np.zeros(d * d + d + 2)
        v[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
        total = v[-1]
        w = np.array([*row["w"], row["b"]])
        ridge = np.full(d, reg)
        ridge[-1] = 0.0
        loss = v[-2] / total + (ridge * w * w).sum() / 2
        slope = v[d * d : d * d + d] / total + ridge * w
        row["gradient_norm"] = float(np.abs(slope).max())
        if row["gradient_norm"] < tolerance:
            row["done"] = True
        elif row["loss"] is not None and loss > row["loss"] and row["rate"] > 1e-6:
            row["rate"] /= 2
            w = np.array(row["base"]) + row["rate"] * np.array(row["step"])
        else:
            curvature = v[: d * d].reshape(d, d) / total + np.diag(ridge + 1e-12)
            step = -np.linalg.solve(curvature, slope)
            row |= {"base": w.tolist(), "step": step.tolist(), "rate": 1.0, "loss": float(loss)}
            w = w + step
        row |= {"w": w[:-1].tolist(), "b": float(w[-1])}
        return pa.Table.from_pylist([row], schema=schema)

    moved = models.groupBy("dataset_id").cogroup(sums.groupBy("dataset_id")).applyInArrow(move, MODEL)
    return moved


def split_records(df: DataFrame, seed: int = 42) -> DataFrame:
    return stratified_split3(df, ["dataset_id", "label"], "rec_id", seed)


def fit_kmer_models(
    train: DataFrame, k: int = 2, positive_weight: float = 2.0, max_iter: int = 50,
    reg: float = 1e-4, rate: float = 1.0, method: str = "newton", tolerance: float = 1e-8,
) -> DataFrame:
    """Model table ``(model_id, bias, weights, gradient_norm)`` with one row per dataset, fitted from zero.

    Records have ``seq``, or its counts in ``_counts`` (:func:`counted`).

    ``newton`` steps until every dataset's largest slope (of the loss in standardised counts) is below
    ``tolerance``, ``max_iter`` steps at most; ``gradient`` takes ``max_iter`` steps of ``rate`` down the
    slope and leaves ``gradient_norm`` null.
    """
    raw = labelled_counts(train, k)
    scales = count_scales(raw, k)
    zeros = F.array_repeat(F.lit(0.0), 4**k)
    models = scales.select("dataset_id", zeros.alias("w"), F.lit(0.0).alias("b"))
    if method == "newton":
        extra = {"base": "array<double>", "step": "array<double>", "rate": "double", "loss": "double", "gradient_norm": "double"}
        models = models.select("*", *[F.lit(None).cast(t).alias(c) for c, t in extra.items()], F.lit(False).alias("done"))
        blocks = count_blocks(raw, k)
        for _ in range(max_iter):
            still = models.where(~F.col("done"))
            if not still.head(1):
                break
            models = materialize(newton_step(models, newton_sums(blocks, still, scales, k, positive_weight), k, reg, tolerance))
    else:
        rows = standardised(raw, scales)
        for _ in range(max_iter):
            models = materialize(gradient_step(rows, models, k, positive_weight, rate, reg))
        models = models.withColumn("gradient_norm", F.lit(None).cast("double"))
    # Back to weights of plain counts.
    plain = models.join(scales, "dataset_id").withColumn("v", F.zip_with("w", "sd", lambda w, d: w / d))
    shift = F.aggregate(F.zip_with("v", "mean", lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(g) for g in S.vocabulary_kmers(k)])
    return plain.select(
        F.col("dataset_id").alias("model_id"), (F.col("b") - shift).alias("bias"), F.map_from_arrays(names, "v").alias("weights"), "gradient_norm"
    )


def predict(df: DataFrame, models: DataFrame, k: int = 2, model_id: str = "dataset_id") -> DataFrame:
    """Logit and probability of each record under the model it names; records without one drop out."""
    # A record's k-mers are counted once, before it meets its model; the logit is a product of two arrays.
    names = S.vocabulary_kmers(k)
    weight = lambda g: F.when(F.map_contains_key("weights", g), F.element_at("weights", g).cast("double")).otherwise(F.lit(0.0))
    listed = F.when(F.col("weights").isNotNull(), F.array(*[weight(g) for g in names]))
    other = F.map_filter("weights", lambda g, _w: (F.length(g) == k) & ~g.isin(names))  # words of other letters
    named = counted(df, k).withColumn("model_id", F.col(model_id))
    scored = named.join(models.withColumns({"_listed": listed, "_other": other}), "model_id")
    terms = F.zip_with("_counts", "_listed", lambda n, w: n * w)
    logit = F.aggregate(terms, F.col("bias").cast("double"), lambda a, x: a + x)
    if "seq" in df.columns:
        others = kmer_logit(S.normalize_rna("seq"), k, F.col("_other"), logit)
    else:
        others = F.raise_error(F.lit("words of other letters need the texts in seq"))
    logit = F.when(F.size("_other") > 0, others).otherwise(logit)
    return scored.withColumn("logit", logit).withColumn(
        "prob", 1 / (1 + F.exp(-F.col("logit")))
    ).drop("weights", "bias", "gradient_norm", "_counts", "_listed", "_other")


def train_and_validate(df: DataFrame, k: int = 2, seed: int = 42, **fit) -> tuple[DataFrame, DataFrame]:
    """Models fitted on the train part and metrics per (dataset, split) on the other two."""
    # A text is read once, for its counts; split, fit and scores start from these.
    records = materialize(counted(df, k).select("dataset_id", "rec_id", "label", "_counts"))
    parts = split_records(records, seed)
    models = materialize(fit_kmer_models(parts.where(F.col("split") == "train"), k, **fit))
    held_out = predict(parts.where(F.col("split") != "train"), models, k)
    return models, binary_metrics(materialize(held_out.select("dataset_id", "split", "label", "prob")), ["dataset_id", "split"])


def transfer(df: DataFrame, models: DataFrame, k: int = 2) -> DataFrame:
    """Metrics of each dataset under the model of its other cell line."""
    named = df.withColumn("other_model", SC.transfer_model_name("dataset_id"))
    scored = predict(named.where(F.col("other_model").isNotNull()), models, k, "other_model")
    # The metrics read the scores several times.
    return binary_metrics(materialize(scored.select("dataset_id", "model_id", "label", "prob")), ["dataset_id", "model_id"])
