import math

import pytest
from pyspark.sql import functions as F

from ribospan.operators import score_tables as T
from ribospan.plans import splice_profile as SP
from ribospan.plans import training as TR
from ribospan.plans.annotation import annotate_impacts
from ribospan.plans.ribosnitch import ribosnitch_dynamics


def test_last_pvalue_wins_and_missing_stays(spark):
    s = spark.createDataFrame([("rs1",), ("rs2",)], ["rsid"])
    p = spark.createDataFrame([("rs1", 0.1, 1), ("rs1", 0.2, 2)], ["rsid", "p_value", "line_no"])
    got = {r["rsid"]: r["p_value"] for r in T.attach_pvalue(s, p.repartition(3), "line_no").collect()}
    assert got == {"rs1": 0.2, "rs2": None}


def test_eqtl_fans_out_and_flags(spark):
    s = spark.createDataFrame([("rs1", "K562"), ("rs2", "HEK293T"), ("rs1", "other")], ["rsid", "cell"])
    e = spark.createDataFrame(
        [("Whole_Blood", "rs1", 1e-6), ("Whole_Blood", "rs1", 0.1), ("Liver", "rs2", 1e-9)], ["tissue", "rsid", "pval_nominal"]
    )
    out = T.attach_eqtl(s, e).collect()
    assert sorted((r["rsid"], r["is_significant_eqtl"]) for r in out) == [("rs1", False), ("rs1", True), ("rs2", False)]
    assert [r["log10_p"] for r in out if r["rsid"] == "rs2"] == [0.0]


@pytest.mark.parametrize("with_lead", [True, False])
def test_ld(spark, with_lead):
    gwas = spark.createDataFrame(
        [("1", 10, "a", 0.1, 1), ("1", 20, "b", 0.01, 2), ("1", 20, "b", 0.5, 3), ("2", 10, "c", 0.1, 4), ("1", 99, "d", 0.1, 5)],
        "chr string, pos bigint, rsid string, p_value double, line_no bigint",
    )
    ld = [("p1", "1", 20, 0.3, 1), ("p2", "2", 10, 0.9, 2)] + ([("lead", "1", 10, 0.2, 3)] if with_lead else [])
    ld = spark.createDataFrame(ld, "rs_number string, chr string, pos bigint, r2 double, line_no bigint")
    got = {r["rsid"]: r for r in T.attach_ld(gwas, ld, "lead").collect()}
    if with_lead:
        assert set(got) == {"a", "b"}
        assert got["a"]["r2"] == 1.0 and got["b"]["p_value"] == 0.01 and got["b"]["ld_bin"] == "0.4"
    else:
        assert set(got) == {"b"}


def test_dynamic_counts(spark):
    rows = [
        ("v1", "A", "x", "x", "y", 1), ("v1", "A", "y", "q", "q", 2), ("v2", "A", "x", "x", "y", 3), ("v3", "B", "z", "x", "y", 4),
    ]
    df = spark.createDataFrame(rows, ["variant", "rbp", "cell", "cell1", "cell2", "line_no"])
    got = {r["rbp"]: (r["dynamic"], r["common"], r["odds_ratio"]) for r in T.dynamic_common_first(df, "line_no").collect()}
    assert got["A"][:2] == (1, 1) and got["B"][:2] == (0, 0)
    assert got["B"][2] == pytest.approx(math.log1p(0.5))
    pairs = {(r["cell_line_pair"], r["rbp"]): (r["dynamic"], r["common"]) for r in T.dynamic_common_pairs(df, ["x", "y", "z"]).collect()}
    assert pairs == {
        ("x_y", "A"): (1, 1), ("x_z", "A"): (2, 0), ("y_z", "A"): (1, 0), ("x_z", "B"): (1, 0), ("y_z", "B"): (1, 0),
    }
    scored = df.withColumn("score", F.lit(0.0))
    assert ribosnitch_dynamics(scored, ["x", "y"]).count() == 0
    assert ribosnitch_dynamics(scored, ["x", "y"], inclusive=True).count() == 3


def test_disease_impact_uses_first_before_score(spark):
    schema = "k string, tags array<string>, score double, line_no int"
    before = spark.createDataFrame([("a", ["Leigh_syndrome_x", "q"], 1.0, 1), ("a", ["Leigh_syndrome"], 9.0, 2)], schema)
    after = spark.createDataFrame(
        [("a", ["Leigh_syndrome"], 3.0, 1), ("a", ["Leigh_syndrome"], 0.5, 2), ("b", ["Leigh_syndrome"], 5.0, 3)], schema
    )
    r = T.disease_impact(before, after, ["Leigh_syndrome"], ["k"], "line_no").collect()[0]
    assert (r["positive_impact"], r["negative_impact"]) == (2.0, -0.5)


def test_tags_and_counts(spark, one):
    assert one(T.disease_tags(F.lit("v [a b|c] [d]"), True)) == ["a_b", "c"]
    assert one(T.disease_tags(F.lit("v"))) is None
    df = spark.createDataFrame([(1, ["a", "a", "bad"]), (1, ["a"]), (2, ["a"])], "variant int, tags array<string>")
    assert [(r["disease"], r["n_variants"]) for r in T.disease_counts(df, ["bad"]).collect()] == [("a", 2)]


def test_keywords_once_per_row(spark):
    df = spark.createDataFrame(
        [("R", "Dilated_Cardiomyopathy|cardiomyopathy 2"), ("", "Cardiomyopathy"), (None, "Cardiomyopathy"), ("R", None)],
        "rbp_list string, diseases string",
    )
    out = T.tissue_keyword_counts(df, {"heart": ["Cardiomyopathy"], "brain": ["Autism"]}).collect()
    assert [(r["tissue"], r["n_variants"]) for r in out] == [("heart", 1)]


def test_topk_pivot_and_order(spark):
    counts = spark.createDataFrame([("g", x, n) for x, n in [("a", 5), ("b", 5), ("c", 1), ("d", 2)]], ["grp", "name", "n"])
    got = {r["name"]: r["n"] for r in T.topk_other(counts, ["grp"], "name", "n", 2).collect()}
    assert got == {"a": 5, "b": 5, "Other": 3}
    ranked = T.columns_by_total(counts, "name", "n").orderBy("place").collect()
    cols = [r["name"] for r in ranked]
    assert cols == ["a", "b", "d", "c"] and [r["total"] for r in ranked] == [5, 5, 2, 1]
    wide = T.pivot_matrix(counts, "grp", "name", "n", cols).collect()[0]
    assert wide["row_total"] == 13
    cells = counts.withColumn("cell", F.lit("x")).withColumnRenamed("name", "rbp")
    assert [r["rbp"] for r in T.order_rows_by_cells(cells, ["x"]).collect()] == ["a", "b", "d", "c"]


def test_presence_and_inventory(spark):
    df = spark.createDataFrame([("l1", "B"), ("l1", "A"), ("l2", "B")], ["locus", "cell"])
    got = {r["locus"]: (r["pattern"], r["n_cells"], r["group"]) for r in T.presence_pattern(df, ["A", "B"]).collect()}
    assert got == {"l1": ("A+B", 2, "sharing"), "l2": ("B", 1, "specific")}
    inv = T.motif_inventory(spark.createDataFrame([("r", "A", 3), ("r", "B", 1), ("s", "B", 2)], ["rbp", "cell", "n"]))
    assert T.shared_rbps(inv).count() == 2
    assert T.private_rbps(inv, "A").collect()[0]["in_split_cell"] == 0


def test_first_row_and_exclusion(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], ["k", "o", "v"])
    assert {(r["k"], r["v"]) for r in T.first_row(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "z")}
    assert [r["v"] for r in T.exclude_top(df, "k", [F.col("o")], 2).collect()] == ["z"]
    assert T.coerce_and_drop(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), ["v"]).count() == 1


def test_summary_of_whole_table(spark):
    df = spark.createDataFrame([("a", 1.0, -1.0), ("a", 2.0, 1.0), ("b", 3.0, 0.0)], ["rsid", "alt_score", "ref_score"])
    r = T.score_summary(df, []).collect()[0]
    assert (r["n_rows"], r["n_unique_rsid"], r["delta_median"]) == (3, 2, 2.0)
    assert r["sign_flip_rate"] == pytest.approx(1 / 3)


def test_annotation_joins_by_key_not_line(spark):
    cols = ["rsid", "gene", "score"]
    after = spark.createDataFrame([("r2", "g2", 2.0), ("r1", "g1", 1.0), ("r3", "g1", 5.0)], cols)
    before = spark.createDataFrame([("r1", 0.5), ("r2", 0.25)], ["rsid", "score"])
    symbols = spark.createDataFrame([("g1", "TP53")], ["gene", "gene_name"])
    p = spark.createDataFrame([("r1", 0.01, 1)], ["rsid", "p_value", "line_no"])
    got = {r["rsid"]: (r["delta_score"], r["gene_name"], r["p_value"]) for r in annotate_impacts(before, after, ["rsid"], symbols, p, "line_no").collect()}
    assert got == {"r1": (0.5, "TP53", 0.01), "r2": (1.75, "", None)}


def test_splice_profile(spark):
    d = "dataset_id string, motif string, distance double"
    three = spark.createDataFrame([("A", "AGG", 0.2), ("A", "AGG", 0.7), ("A", "AGGU", 1.0), ("B", "AGG", 1.0)], d)
    five = spark.createDataFrame([("A", "AGG", -3.0), ("A", "AGG", 99.0)], d)
    m = spark.createDataFrame([("A", "ZZ", 0), ("A", "AGG", 1), ("A", "AGGU", 2), ("B", "AGG", 0)], ["dataset_id", "motif", "o"])
    out = sorted((r["site"], r["bin_start"], r["n"], r["density"]) for r in SP.splice_profile(three, five, m, "o").collect())
    assert out == [("3ss", 0.0, 2, 1.0), ("5ss", -3.0, 1, 1.0)]


def test_training_learns_each_dataset_apart(spark):
    """Two datasets with opposite rules; one shared model could not fit both."""
    import random

    rng = random.Random(12)
    rows = []
    for d, good in (("X_K562", "GC"), ("X_HepG2", "AU")):
        for i in range(200):
            label = i % 2
            letters = good * 4 + "ACGU" if label else "ACGU" + ("AU" if good == "GC" else "GC") * 4
            rows.append((d, f"{d}{i}", label, "".join(rng.choice(letters) for _ in range(40))))
    df = spark.createDataFrame(rows, "dataset_id string, rec_id string, label int, seq string")
    models, metrics = TR.train_and_validate(df, k=1, max_iter=15)
    assert {r["model_id"] for r in models.collect()} == {"X_K562", "X_HepG2"}
    assert all(r["auc"] > 0.9 for r in metrics.collect()) and metrics.count() == 4
    moved = TR.transfer(df, models, k=1).collect()
    assert {(r["dataset_id"], r["model_id"]) for r in moved} == {("X_K562", "X_HepG2"), ("X_HepG2", "X_K562")}
    assert all(r["auc"] < 0.1 for r in moved)
