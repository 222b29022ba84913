import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ribospan.functions import sequence as S
from ribospan.operators import features as FE
from ribospan.operators import kmers as K

SEQ = "ACGUUGCAAC" * 10 + "G"


def dense(seq, length=101):
    """Plain Python statement of the 99 features."""
    table = FE.DINUCLEOTIDES
    m = [[0.0] * 99 for _ in range(length)]
    for i in range(length):
        if i < len(seq):
            m[i][0:3] = FE.CHEMISTRY[seq[i]]
            m[i][3] = round(seq[: i + 1].count(seq[i]) / (i + 1), 3)
        else:
            m[i][2] = 1.0
        if i + 1 < len(seq):
            m[i][4:15] = [x / 101 for x in table[seq[i : i + 2]]]
    offset = 15
    for k in (1, 2, 3):
        grams = [seq[i : i + k] for i in range(len(seq) - k + 1)]
        count = Counter(grams)
        vocab = {g: j for j, g in enumerate(S.vocabulary_kmers(k))}
        for i, g in enumerate(grams):
            m[i][offset + vocab[g]] = count[g] / 100
        offset += 4**k
    return m


@pytest.mark.parametrize("seq", [SEQ, "ACGUUGCA", "A" * 101, "ACCCA" * 20])
def test_encoded_features_match_definition(spark, seq):
    df = spark.createDataFrame([(1, seq)], ["rec_id", "seq"])
    got = [[0.0] * 99 for _ in range(101)]
    for r in FE.encode_features(df, ["rec_id"]).collect():
        got[r["pos"]][r["feature"]] = r["value"]
    for a, b in zip(got, dense(seq)):
        assert a == pytest.approx(b)


def test_density_rounds_like_python(spark):
    for seq in ("A" * 9 + "C" * 70 + "AC" * 11, "C" * 79 + "A" * 22, "GA" * 50 + "G"):
        df = spark.createDataFrame([(seq,)], ["seq"])
        got = df.select(FE.nucleotide_density("seq")).collect()[0][0]
        assert got == [round(seq[: i + 1].count(c) / (i + 1), 3) for i, c in enumerate(seq)]


def smooth(row, k):
    out, cover = [0.0] * len(row), [0] * len(row)
    for i in range(len(row) - k + 1):
        s = sum(row[i : i + k])
        for j in range(i, i + k):
            out[j] += s
            cover[j] += 1
    out = [o / max(c, 1) for o, c in zip(out, cover)]
    norm = math.sqrt(sum(x * x for x in out)) + 1e-12
    return [x / norm for x in out]


def test_importance_vector(spark):
    heads = [[[0.1, 0.7, 0.2], [9.0, 9.0, 9.0], [9.0, 9.0, 9.0]], [[0.3, 0.1, 0.6], [0.0] * 3, [0.0] * 3]]
    df = spark.createDataFrame([(heads,)], "a array<array<array<double>>>")
    got = df.select(FE.importance_vector("a", 2)).collect()[0][0]
    assert got == pytest.approx(smooth([0.4, 0.8, 0.8], 2))
    row = [float(i * 7 % 5) for i in range(9)]
    df = spark.createDataFrame([(row,)], "r array<double>")
    assert df.select(FE.smooth_scores("r", 4)).collect()[0][0] == pytest.approx(smooth(row, 4))
    short = df.select(FE.smooth_scores(F.slice("r", 1, 2), 4)).collect()[0][0]
    assert short == [0.0, 0.0]


def test_kmer_counts_filter_and_ties(spark):
    df = spark.createDataFrame([("d", "ACNACGT")], ["dataset_id", "seq"])
    kept = {r["kmer"]: r["n"] for r in K.kmer_counts(df, 2, ["dataset_id"]).collect()}
    assert kept == {"AC": 2, "CG": 1, "GT": 1}
    everything = K.kmer_counts(df, 2, ["dataset_id"], acgt_only=False)
    assert everything.count() == 5
    top = K.top_kmers(everything, ["dataset_id"], 2).orderBy("rank").collect()
    assert [r["kmer"] for r in top] == ["AC", "CG"]


def test_grid_is_complete(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "AAAA")], ["dataset_id", "seq"])
    grid = K.complete_grid(K.kmer_counts(df, 2, ["dataset_id"]), 2, ["dataset_id"])
    assert grid.count() == 32
    assert grid.where("dataset_id='b' and n > 0").count() == 1


def test_scale_and_winsorize(spark):
    rows = [(c, float(i)) for c in "ab" for i in range(101)]
    df = spark.createDataFrame(rows, "c string, v double")
    z = K.scale_columns(df, "c", "v")
    m = z.groupBy("c").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in m)
    w = K.winsorize(df, "v").agg(F.min("v"), F.max("v")).collect()[0]
    assert (w[0], w[1]) == pytest.approx((1.0, 99.0), abs=1.0)


def test_records_longer_than_the_padding_keep_all_positions(spark):
    df = spark.createDataFrame([(1, "ACGU" * 50)], ["rec_id", "seq"])
    last = {r["f"]: r["p"] for r in FE.encode_features(df, ["rec_id"]).groupBy((F.col("feature")).alias("f")).agg(F.max("pos").alias("p")).collect()}
    assert {last[f] for f in range(15)} == {199}
    short = spark.createDataFrame([(1, "AA")], ["rec_id", "seq"])
    row = short.select(FE.dinucleotide_features("seq", 4).alias("v")).first()["v"]
    assert len(row) == 4 and row[0][2] == pytest.approx(3.18 / 4)


def spelled(seq, states):
    """Plain statement of the 28 letters, odd inputs as the column expression took them."""
    out = ""
    for i, t in enumerate(states):
        at = ((S.RNA.find(seq[i]) if i < len(seq) else 0)) * 7 + S.STATES_7.find(t) + 1
        out += S.LETTERS_28[max(at, 1) - 1] if at >= 0 else S.LETTERS_28[at]
    return out


def test_alphabet_encoding_goes_through_a_batch_once(spark):
    from ribospan.plans.motif_prior import ALPHABETS, alphabet_rows

    pairs = [("ACGU", "BEHL"), ("AC", "TTTT"), ("ACGUA", "RM"), ("ANxU", "BEzT"), ("xN", "zB"), ("", ""), ("é", "B"), (None, "BE"), ("AC", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, seq string, states string")
    rows = alphabet_rows(df, ["id"], list(ALPHABETS))
    assert "transform(" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["alphabet"]): r["seq"] for r in rows.collect()}
    for i, (seq, states) in enumerate(pairs):
        full = "" if seq is None or states is None else spelled(seq, states)
        assert got[i, "seq_struct_28"] == full
        assert got[i, "seq_struct_8"] == full.translate(str.maketrans(S.LETTERS_28, S.LETTERS_8))


def test_encoded_features_do_not_depend_on_how_many_are_encoded_together(spark):
    texts = [SEQ, "ACGTNACGU", "", "A", "AC", "ACG", "AxC", "acg", None, "ACGU" * 40, SEQ, "GA" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id int, seq string").coalesce(1)
    rows = FE.encode_features(df, ["rec_id"])
    assert "transform(" not in rows._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, rows.collect()))
    assert found == sorted(map(tuple, FE.encode_features(df, ["rec_id"], most_cells=1).collect()))
    for i, text in enumerate(texts):
        got = {r[1:3]: r[3] for r in found if r[0] == i}
        if text in (None, "AxC", "acg"):
            assert not got
            continue
        rna = text.replace("T", "U").replace("N", "A")
        for p, row in enumerate(dense(rna, max(101, len(rna)))):
            for f, v in enumerate(row):
                assert got.get((p, f), 0.0) == pytest.approx(v)
