"""A split without sorting, slices without lambdas and a fit on blocks of records."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribospan.functions import sequence as S
from ribospan.operators import ordered as O
from ribospan.operators import splits as SP
from ribospan.plans import training as TR


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def expected_split(df, by, seed, test, valid, own_rows):
    """Every row of an id takes all ranks of its id; rows without a key have ranks that nobody takes."""
    groups, rows = defaultdict(list), df.withColumn("_h", F.xxhash64(F.lit(seed), "rec_id")).collect()
    for r in rows:
        groups[tuple(r[c] for c in by)].append((r["_h"], r["rec_id"] is not None, r["rec_id"] or 0))
    found = defaultdict(list)
    for g, keys in groups.items():
        n_test, n_valid = int(len(keys) * test), int(len(keys) * valid)
        for rank, (_, there, rec) in enumerate(sorted(keys)):
            part = "test" if rank < n_test else "valid" if rank < n_test + n_valid else "train"
            found[(*g, rec if there else None)].append(part)
    if not own_rows:
        return Counter((*key, part) for key, parts in found.items() for part in parts)
    keyed = [((*(r[c] for c in by), r["rec_id"]), r["x"]) for r in rows]
    return Counter((*key, x, part) for key, x in keyed if None not in key for part in found[key])


def test_split_of_repeated_and_missing_ids(spark):
    rng = random.Random(5)
    some = lambda p, v: None if rng.random() < p else v
    rows = [(some(0.05, rng.choice("ab")), some(0.05, rng.randrange(2)), some(0.03, rng.randrange(150)), rng.random()) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, label int, rec_id long, x double")
    out = SP.stratified_split3(df, ["g", "label"], seed=3)
    assert out.columns == ["g", "label", "rec_id", "x", "split"]
    assert Counter(map(tuple, out.collect())) == expected_split(df, ["g", "label"], 3, 0.15, 0.15, True)
    keys = SP.stratified_split3(df.drop("x"), ["g", "label"], seed=3)
    assert Counter(map(tuple, keys.collect())) == expected_split(df, ["g", "label"], 3, 0.15, 0.15, False)


@pytest.mark.parametrize(("test", "valid"), [(0.0, 0.0), (1.0, 0.0), (0.5, 0.5), (0.15, 0.15)])
def test_split_ends_anywhere(spark, test, valid):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("rec_id"), (F.col("id") * 0.5).alias("x"))
    out = SP.stratified_split3(df, ["g"], test_frac=test, valid_frac=valid)
    assert Counter(map(tuple, out.collect())) == expected_split(df, ["g"], 42, test, valid, True)
    assert not SP.stratified_split3(df.where("false"), ["g"]).collect()


def test_split_neither_sorts_nor_moves_the_rows(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").alias("rec_id"), F.lit("text").alias("x"))
    plan = plan_of(SP.stratified_split3(df, ["g"]))
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan


def test_slices_are_the_number_of_cuts_up_to_a_key(spark):
    rows = [(g, i) for g in ("a", "b", None) for i in range(-400, 400)]
    df = spark.createDataFrame(rows, "g string, i int")
    sliced = O.with_slice(df, ["g"], ["i"])
    assert "lambdafunction" not in plan_of(sliced)
    got = sorted(((r["g"] is not None, r["g"] or "", r["i"]), r["_slice"]) for r in sliced.collect())
    n_cuts = O._fanout(df) ** 2 - 1
    hashed = df.withColumn("_u", F.pmod(F.xxhash64("g", "i"), F.lit(1 << 31))).collect()
    cuts = {(r["g"] is not None, r["g"] or "", r["i"]) for r in hashed if r["_u"] < n_cuts * 2**31 / len(rows)}
    most, seen = 2 ** (n_cuts.bit_length() + 1) - 1, 0
    for key, number in got:
        seen += key in cuts
        assert number == min(seen, most)
    assert seen > 3


def test_newton_sums_of_blocks_equal_those_of_records(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["d1", "d2", None]), rng.choice([0, 1, 1, None]), "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 30, 400])))) for _ in range(400)]
    rows.append(("alone", 1, "A" * 70_000))  # its counts need wider integers
    df = spark.createDataFrame(rows, "dataset_id string, label int, seq string").repartition(3)
    raw = TR.labelled_counts(df, 1)
    blocks, scales = TR.count_blocks(raw, 1, most_cells=80), TR.count_scales(raw, 1)
    many = Counter(d for d, y, _ in rows if d and y is not None)
    for r in blocks.collect():
        records = len(r["labels"]) // 8
        width = len(r["counts"]) // (records * 4)
        assert records <= 20 and (width == 4 if r["dataset_id"] == "alone" else width in (1, 2))
        many[r["dataset_id"]] -= records
    assert not any(many.values()) and blocks.count() < 100
    w = {"d1": [0.3, -0.2, 0.1, 0.5], "d2": [0.0, 1.0, 0.0, -1.0], "alone": [0.1] * 4}
    models = spark.createDataFrame([(d, v, 0.25) for d, v in w.items()], "dataset_id string, w array<double>, b double")
    got = defaultdict(dict)
    for r in TR.newton_sums(blocks, models, scales, 1, 2.0).collect():
        got[r["dataset_id"]][r["cell"]] = r["value"]
    scale = {r["dataset_id"]: r for r in scales.collect()}
    for d, v in w.items():
        mine = [(y, t.replace("T", "U").replace("N", "A")) for e, y, t in rows if e == d and y is not None]
        c = np.array([[t.count(g) for g in S.vocabulary_kmers(1)] for _, t in mine], float)
        x = np.column_stack([(c - scale[d]["mean"]) / scale[d]["sd"], np.ones(len(c))])
        y = np.array([y for y, _ in mine], float)
        z, s = x @ np.array([*v, 0.25]), np.where(y == 1, 2.0, 1.0)
        p = 1 / (1 + np.exp(-z))
        want = np.concatenate([(x.T * (s * p * (1 - p)) @ x).ravel(), x.T @ (s * (p - y)), [(s * (np.logaddexp(0, z) - y * z)).sum(), s.sum()]])
        assert [got[d][i] for i in range(len(want))] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9)


def test_fit_and_scores_start_from_counts(spark):
    rng = random.Random(9)
    rows = [("d", i, i % 2, "".join(rng.choices("ACGU" + "GC" * (i % 2) + "é", k=30))) for i in range(200)]
    df = spark.createDataFrame(rows, "dataset_id string, rec_id long, label int, seq string")
    known = TR.counted(df, 2).drop("seq")
    assert TR.counted(known, 2) is known
    assert "translate" not in plan_of(TR.counted(df, 2))
    for method, steps in (("newton", 20), ("gradient", 3)):
        a, b = (TR.fit_kmer_models(t, 2, method=method, max_iter=steps).collect()[0] for t in (df, known))
        assert a["bias"] == pytest.approx(b["bias"]) and a["weights"] == pytest.approx(b["weights"])
    models = TR.fit_kmer_models(df, 2)
    logits = [{r["rec_id"]: r["logit"] for r in TR.predict(t, models).collect()} for t in (df, known)]
    assert logits[0] == pytest.approx(logits[1]) and len(logits[0]) == 200
    other = spark.createDataFrame([("d", 0.0, {"RR": 1.0})], "model_id string, bias double, weights map<string,double>")
    assert TR.predict(df, other).count() == 200
    with pytest.raises(Exception, match="need the texts"):
        TR.predict(known, other).collect()
