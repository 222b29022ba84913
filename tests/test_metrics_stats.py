import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribospan.functions.special import hypergeom_upper, rank_sum_exact, regularized_beta
from ribospan.operators import metrics as M
from ribospan.operators import stats as ST


def brute(rows):
    """Metrics from sorted thresholds, one at a time."""
    pos = sum(y for y, _ in rows)
    neg = len(rows) - pos
    auc = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z) / (pos * neg)
    pts = [(0.0, 1.0)]
    for t in sorted({p for _, p in rows}, reverse=True):
        tp = sum(y for y, p in rows if p >= t)
        pts.append((tp / pos, tp / sum(p >= t for _, p in rows)))
    prc = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    ap = sum((b[0] - a[0]) * b[1] for a, b in zip(pts, pts[1:]))
    return auc, prc, ap


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(1)
    rows = [("a", int(rng.random() < 0.4), round(rng.random(), 2), i % 3) for i in range(300)]
    rows += [("b", int(rng.random() < 0.7), round(rng.random(), 1), i % 3) for i in range(50)]
    return rows, spark.createDataFrame(rows, "dataset_id string, label int, prob double, batch int")


def test_binary_metrics(preds):
    rows, df = preds
    got = {r["dataset_id"]: r for r in M.binary_metrics(df.repartition(5), ["dataset_id"]).collect()}
    ap = {r["dataset_id"]: r["average_precision"] for r in M.average_precision(df, ["dataset_id"]).collect()}
    for d in "ab":
        mine = [(y, p) for g, y, p, _ in rows if g == d]
        auc, prc, step = brute(mine)
        assert got[d]["auc"] == pytest.approx(auc)
        assert got[d]["prc"] == pytest.approx(prc)
        assert ap[d] == pytest.approx(step)
        assert got[d]["tp"] == sum(y and p > 0.5 for y, p in mine)
        assert got[d]["acc"] == pytest.approx(np.mean([round(p) == y for y, p in mine]))


def test_half_rounds_down_and_single_class(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("x", 1, 0.9)], "dataset_id string, label int, prob double")
    r = M.binary_metrics(df, ["dataset_id"]).collect()[0]
    assert (r["acc"], r["fn"], r["tp"], r["auc"], r["mcc"]) == (0.5, 1, 1, None, 0.0)


def test_batch_average_is_not_pooled(preds):
    _, df = preds
    avg = M.batch_averaged_metrics(df, ["dataset_id"], "batch").collect()
    pooled = {r["dataset_id"]: r for r in M.binary_metrics(df, ["dataset_id"]).collect()}
    for r in avg:
        assert r["tp"] == pooled[r["dataset_id"]]["tp"]
        assert r["auc"] != pytest.approx(pooled[r["dataset_id"]]["auc"], abs=1e-9)


def test_categorical(spark):
    rows = [([1, 0, 0], [0.7, 0.2, 0.1]), ([0, 1, 0], [0.6, 0.3, 0.1]), ([0, 0, 1], [0.1, 0.1, 0.8])]
    df = spark.createDataFrame(rows, "label array<int>, pred array<double>")
    out = {r["class"]: r for r in M.categorical_metrics(df, []).collect()}
    assert out[0]["acc"] == pytest.approx(2 / 3)
    assert (out[0]["auc"], out[2]["auc"]) == (1.0, 1.0)


def test_regression(spark):
    xs = [(1.0, 2.1), (2.0, 3.9), (3.0, 6.2), (4.0, 7.8)]
    df = spark.createDataFrame([("d", y, x) for x, y in xs], "dataset_id string, y double, x double")
    r = M.regression_metrics(df, ["dataset_id"], "y", "x").collect()[0]
    x, y = np.array(xs).T
    slope = (x @ y) / (x @ x)
    assert r["slope"] == pytest.approx(slope)
    assert r["r_squared"] == pytest.approx(1 - ((y - slope * x) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    both = M.pearson_spearman(df, [], "x", "y").collect()[0]
    assert both["spearman"] == pytest.approx(1.0)


def test_hypergeom_against_enumeration():
    for total, marked, drawn in [(10, 4, 3), (50, 20, 25), (12, 12, 5), (9, 0, 4)]:
        mass = [
            math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
            if drawn - k <= total - marked else 0.0
            for k in range(drawn + 1)
        ]
        for x in range(drawn + 2):
            assert hypergeom_upper(x, total, marked, drawn) == pytest.approx(sum(mass[x:]), abs=1e-12)


def test_hypergeom_large_counts_stay_finite():
    p = hypergeom_upper(501_000, 10_000_000, 5_000_000, 1_000_000)
    assert 0 < p < 0.05


def test_rank_sum_exact_against_enumeration():
    n1, n2 = 3, 4
    ws = [sum(c) - n1 * (n1 - 1) / 2 - 0 for c in itertools.combinations(range(n1 + n2), n1)]
    for w in range(n1 * n2 + 1):
        low = np.mean([x <= w for x in ws])
        high = np.mean([x >= w for x in ws])
        want = min(1.0, 2 * (high if w > n1 * n2 / 2 else low))
        assert rank_sum_exact(w, n1, n2) == pytest.approx(want)


def test_rank_sum_normal_with_ties(spark):
    rows = [("a", float(i % 10)) for i in range(80)] + [("b", float(i % 12)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = ST.rank_sum_test(df, [], "g", "v", [("a", "b")]).collect()[0]
    a, b = [v for g, v in rows if g == "a"], [v for g, v in rows if g == "b"]
    w = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["w"] == pytest.approx(w) and (r["n1"], r["n2"]) == (80, 90)
    n = 170
    ties = sum(c**3 - c for c in (sum(v == k for _, v in rows) for k in range(12)))
    sd = math.sqrt(80 * 90 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (abs(w - 3600) - 0.5) / sd
    assert r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_beta_and_t():
    assert regularized_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert regularized_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)


def test_pearson_test(spark):
    rng = random.Random(5)
    rows = [("g", x, 0.3 * x + rng.random()) for x in (rng.random() for _ in range(30))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    r = ST.pearson_test(df, ["g"], "x", "y").collect()[0]
    assert r["r"] == pytest.approx(np.corrcoef([x for _, x, _ in rows], [y for _, _, y in rows])[0, 1])
    t = r["r"] * math.sqrt(28 / (1 - r["r"] ** 2))
    grid = np.linspace(0, abs(t), 200001)
    dens = math.exp(math.lgamma(14.5) - math.lgamma(14)) / math.sqrt(28 * math.pi) * (1 + grid**2 / 28) ** -14.5
    assert r["p"] == pytest.approx(1 - 2 * np.trapezoid(dens, grid), abs=1e-6)


def test_bh(spark):
    ps = [0.01, 0.02, 0.02, 0.03, 0.9, 1.0]
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate(ps)], "g string, i int, p double")
    adj = [r["p_adj"] for r in ST.bh_adjust(df, ["g"]).orderBy("i").collect()]
    assert adj == pytest.approx([0.04, 0.04, 0.04, 0.045, 1.0, 1.0])
    assert adj == sorted(adj)


def test_bonferroni_and_tiny_p(spark, one):
    assert one(ST.log2_scientific(F.lit("1.6e-400"))) == pytest.approx(math.log2(1.6) - 400 * math.log2(10))
    assert one(ST.log2_scientific(F.lit("0,25"))) == -2.0
    rows = [("g", i, p) for i, p in enumerate(["1e-300", "0.5", "1e-9", "1e-8"], 1)]
    df = spark.createDataFrame(rows, "g string, rank int, p string").withColumn("l", ST.log2_scientific("p"))
    kept = ST.bonferroni_keep(df, ["g"], "l", "rank", 3).collect()
    assert sorted(r["rank"] for r in kept) == [1, 3]


def test_qq_points_expand_repeats(spark, monkeypatch):
    monkeypatch.setattr(ST, "QQ_CHUNK", 3)
    df = spark.createDataFrame([(0.1,)] * 8 + [(0.5,)] * 3, "p double")
    out = ST.qq_points(df, []).orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(1, 12))
    assert [r["p"] for r in out] == [0.1] * 8 + [0.5] * 3
    assert out[0]["expected"] == pytest.approx(-math.log10(0.5 / 11))


def test_iqr_filter(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [*range(10), 100]], "g string, v double")
    assert ST.iqr_filter(df, ["g"], "v").count() == 10


def test_best_epoch_first_tie_and_stop(spark):
    aucs = [0.5, 0.7, 0.7, 0.6, 0.6, 0.9]
    df = spark.createDataFrame([("r", i, a) for i, a in enumerate(aucs, 1)], "run string, epoch int, auc double")
    r = ST.best_epoch(df).collect()[0]
    assert (r["best_epoch"], r["best_auc"]) == (6, 0.9)
    stopped = ST.best_epoch(df, patience=2).collect()[0]
    assert (stopped["best_epoch"], stopped["last_epoch"]) == (2, 5)


def test_areas_with_billions_of_rows(spark):
    big = 4_000_000_000
    # Half of the positives above all negatives, half below: the area is one half.
    rows = [(0.9, big, 0, 0, 0, 2 * big, 2 * big), (0.5, 0, 2 * big, big, 0, 2 * big, 2 * big), (0.1, big, 0, big, 2 * big, 2 * big, 2 * big)]
    names = ["score", "pos", "neg", "pos_before", "neg_before", "pos_total", "neg_total"]
    curve = M._curve(spark.createDataFrame(rows, names), [])
    areas = {k: v.alias(k) for k, v in M._area_columns().items()}
    got = curve.agg(*areas.values()).first()
    assert got["roc_auc"] == pytest.approx(0.5) and got["average_precision"] == pytest.approx(0.75)


def test_tails_of_many_rows_are_those_of_each_row():
    from ribospan.functions.special import hypergeom_uppers

    rng = random.Random(3)
    rows = [(0, 0, 0, 0), (1, 5, 0, 3), (3, 5, 5, 3), (2, 5, 5, 3), (4, 5, 4, 4), (501_000, 10_000_000, 5_000_000, 1_000_000)]
    for _ in range(3000):
        total = rng.choice([1, 7, 60, 5000, 300_000])
        marked, drawn = rng.randint(0, total), rng.randint(0, total)
        middle = marked * drawn // total
        rows.append((max(0, middle + rng.randint(-40, 40)), total, marked, drawn))
    got = hypergeom_uppers(*np.array(rows, np.int64).T)
    for p, row in zip(got.tolist(), rows, strict=True):
        assert p == pytest.approx(hypergeom_upper(*row), rel=1e-9, abs=1e-13)
    assert hypergeom_uppers(*np.zeros((4, 0), np.int64)).shape == (0,)
