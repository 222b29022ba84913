import pytest
from pyspark.sql import functions as F

from ribospan.operators import variants as V
from ribospan.plans import variant_scoring as P
from ribospan.streaming import scoring as STR


def header(pos, ref, alt, strand="+", start=100):
    return f">v chr1:{start}-{start + 8}({strand})[utr]{{NA}} {pos}:{ref}>{alt} ENSG1[0.1]{{rs1}}"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("A_K562", header(102, "G", "A"), "ACGTACGT"),
        ("A_K562", header(102, "C", "T", "-"), "ACGTACGT"),
        ("A_K562", header(102, "T", "A"), "ACGTACGT"),
        ("A_K562", header(99, "A", "C"), "ACGTACGT"),
        ("A_K562", header(108, "A", "C"), "ACGTACGT"),
        ("A_K562", ">bad header", "ACGTACGT"),
    ]
    return spark.createDataFrame(rows, ["dataset_id", "header", "seq"])


def test_gwas_rules(records):
    out = V.apply_variant_gwas(records, "after").collect()
    assert [r["reject_reason"] for r in out] == [
        None, None, "ref_mismatch", "out_of_bounds", "out_of_bounds", "header",
    ]
    assert [r["scored_seq"] for r in out[:2]] == ["ACATACGT", "ACATACGT"]
    before = V.apply_variant_gwas(records, "before").collect()
    assert before[0]["scored_seq"] == "ACGTACGT" and before[2]["reject_reason"] == "ref_mismatch"


@pytest.mark.parametrize(
    "pos, ref, alt, idx, state, after",
    [
        (102, "G", "A", 2, "ref", "ACATACGT"),
        (103, "G", "A", 2, "ref", "ACATACGT"),
        (102, "A", "G", 2, "alt", "ACGTACGT"),
        (101, "G", "T", None, "none", "ACGTACGT"),
    ],
)
def test_catalog_rules(spark, pos, ref, alt, idx, state, after):
    df = spark.createDataFrame([(f"chr1:100-108(+) {pos}:{ref}>{alt} P in C", "ACGTACGT")], ["header", "seq"])
    r = V.apply_variant_catalog(df, "after").collect()[0]
    assert (r["found"]["idx0"], r["found"]["state"], r["scored_seq"]) == (idx, state, after)
    strict = V.apply_variant_catalog(df, "after", strict_ref_match=True).collect()[0]
    assert strict["reject_reason"] == ("ref_mismatch" if state == "none" else None)
    exact = V.apply_variant_catalog(df, "before", try_off_by_one=False).collect()[0]
    assert exact["scored_seq"] == "ACGTACGT"


def test_ribosnitch_expansion(spark):
    rows = [(header(102, "G", "A") + " K562 HepG2", "ACGTACGT"), (header(102, "G", "A") + " H9 H9", "ACGTACGT")]
    df = spark.createDataFrame(rows, ["header", "seq"])
    models = spark.createDataFrame(
        [("A_K562",), ("B_HepG2",), ("C_HepG2_K562",), ("D_HeLa",), ("K562",)], ["model_id"]
    )
    out = V.record_model_expand(V.apply_variant_ribosnitch(df, "after"), models).collect()
    assert sorted(r["model_id"] for r in out) == ["A_K562", "B_HepG2", "C_HepG2_K562"]
    both = spark.createDataFrame([(">x K562 HepG2_K562", "A")], ["header", "seq"])
    once = V.record_model_expand(V.apply_variant_ribosnitch(both, "before"), models).collect()
    assert sorted(r["model_id"] for r in once) == ["A_K562", "C_HepG2_K562"]


@pytest.fixture(scope="module")
def models(spark):
    return spark.createDataFrame(
        [("A_K562", 0.5, {"AC": 1.0, "CA": 10.0})], "model_id string, bias double, weights map<string,double>"
    )


def test_scores(records, models):
    out = P.score_gwas(records, models, "after", P.linear_scorer(2)).collect()
    # ACATACGT: AC twice, CA once.
    assert [r["score"] for r in out] == [12.5, 12.5]
    assert P.rejects(V.apply_variant_gwas(records), []).count() == 3


def test_missing_model_is_reported(records, spark):
    none = spark.createDataFrame([("B", 0.0, {"A": 1.0})], "model_id string, bias double, weights map<string,double>")
    assert P.score_gwas(records, none).count() == 0
    named = records.withColumn("model_id", F.col("dataset_id"))
    assert V.skipped_models(named, none).collect()[0]["n_skipped"] == 6


def test_stream_equals_batch(spark, records, models, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    records.repartition(3).write.parquet(src)
    stream = STR.read_record_stream(spark, src, records.schema, files_per_batch=1)
    q = STR.score_stream(stream, models, out, str(tmp_path / "cp"), scorer=P.linear_scorer(2))
    q.awaitTermination(120)
    cols = ["dataset_id", "header", "model_id", "score"]
    batch = P.score_gwas(records, models, scorer=P.linear_scorer(2)).select(*cols)
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == sorted(map(tuple, batch.collect()))


def test_kmer_logit_ignores_keys_of_another_length(spark):
    from ribospan.plans.variant_scoring import kmer_logit

    df = spark.createDataFrame([("AAAAAAAA", {"A": 1.0, "AA": 0.5, "AAAAA": 2.0})], "s string, w map<string,double>")
    for k, want in ((1, 9.0), (2, 4.5), (4, 1.0), (5, 9.0)):
        assert df.select(kmer_logit("s", k, F.col("w"), F.lit(1.0)).alias("x")).first()["x"] == want
