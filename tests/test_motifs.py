import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribospan.functions import sequence as S
from ribospan.operators import motifs as M
from ribospan.operators import structure as ST
from ribospan.plans import motif_discovery as MD
from ribospan.plans import motif_prior as MP


def regions(scores, min_len):
    mean, low = sum(scores) / len(scores), min(scores)
    out, start = [], None
    for i, x in enumerate([*scores, None]):
        on = x is not None and x > mean and x > low
        if on and start is None:
            start = i
        if not on and start is not None:
            if i - start >= min_len:
                out.append((start, i))
            start = None
    return out


def test_high_score_regions(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(rng.randint(1, 30))]) for i in range(60)]
    df = spark.createDataFrame(rows, "rec_id int, scores array<double>")
    got = {}
    for r in M.high_score_regions(df, ["rec_id"], min_len=2).collect():
        got.setdefault(r["rec_id"], []).append((r["start"], r["end"]))
    assert got == {i: regions(s, 2) for i, s in rows if regions(s, 2)}
    flat = spark.createDataFrame([(1, [1.0] * 5)], "rec_id int, scores array<double>")
    assert M.high_score_regions(flat, ["rec_id"], min_len=1).count() == 0


@pytest.mark.parametrize("span, width, want", [((5, 10), 8, (4, 12)), ((5, 10), 3, (6, 9)), ((0, 4), 4, (0, 4))])
def test_centered_window(one, span, width, want):
    w = one(M.centered_window(F.lit(span[0]), F.lit(span[1]), width))
    assert (w["start"], w["end"]) == want


def test_containment_counts_records_once(spark):
    rows = [("d", 1, "ACACAC", 1), ("d", 2, "TTTT", 0), ("d", 3, "GACG", 0), ("e", 4, "AC", 1)]
    df = spark.createDataFrame(rows, ["dataset_id", "rec_id", "seq", "label"])
    motifs = spark.createDataFrame([("d", "AC"), ("d", "ACAC"), ("d", "GGGGGGGG"), ("e", "AC")], ["dataset_id", "motif"])
    got = {(r[0], r[1]): (r[2], r[3]) for r in M.motif_containment(df, motifs, ["dataset_id"]).collect()}
    assert got == {("d", "AC"): (2, 1), ("d", "ACAC"): (1, 1), ("d", "GGGGGGGG"): (0, 0), ("e", "AC"): (1, 1)}
    multi = M.motif_containment(df, motifs, ["dataset_id"], allow_multi=True)
    assert {(r[0], r[1]): r[2] for r in multi.collect()}[("d", "AC")] == 4


def test_pwm_of_instances_and_meme_text(spark):
    from ribospan.sources.writers import meme_text

    df = spark.createDataFrame([("m", "TGAAGA"), ("m", "TGAAGA")], ["motif", "seq"])
    pwm = M.pwm_from_instances(df, ["motif"])
    assert pwm.count() == 24
    sums = pwm.groupBy("pos").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    text = meme_text(pwm, ["motif"]).collect()[0]["value"].splitlines()
    assert text[0] == "MEME version 5" and text[4] == "letter-probability matrix: alength= 4 w= 6"
    assert text[2] == "Background letter frequencies: A 0.25 C 0.25 G 0.25 U 0.25"
    assert text[5] == "0.00000000000000 0.00000000000000 0.00000000000000 1.00000000000000"
    assert M.pwm_entropy(pwm, ["motif"]).collect()[0]["entropy"] == 0.0


def test_unknown_symbols_count_in_the_denominator(spark):
    df = spark.createDataFrame([("m", "N"), ("m", "A")], ["motif", "seq"])
    p = {r["symbol"]: r["p"] for r in M.pwm_from_instances(df, ["motif"]).collect()}
    assert p == {"A": 0.5, "C": 0.0, "G": 0.0, "U": 0.0}


def test_scan_matches_definition(spark):
    rng = random.Random(4)
    matrix = [[rng.random() for _ in range(4)] for _ in range(3)]
    seqs = ["".join(rng.choice("ACGU") for _ in range(n)) for n in (2, 3, 4, 5, 30)] + ["ACGNUU"]
    cells = [("m", i, s, matrix[i][j]) for i in range(3) for j, s in enumerate("ACGU")]
    pwm = M.pwm_rows(spark.createDataFrame(cells, "motif string, pos int, symbol string, p double"), ["motif"])
    df = spark.createDataFrame([(i, s, "k") for i, s in enumerate(seqs)], ["rec_id", "seq", "k"])
    for n in (1, 2):
        got = M.pfm_scan(df, pwm.withColumn("k", F.lit("k")), ["rec_id"], ["k"], top_n=n)
        for r in got.collect():
            s = seqs[r["rec_id"]]
            w = [
                float(np.prod([matrix[j]["ACGU".index(s[i + j])] if s[i + j] in "ACGU" else 0 for j in range(3)]))
                for i in range(len(s) - 2)
            ]
            want = sum(sorted(w)[-n:]) if len(s) >= 3 + n - 1 else 0.0
            assert r["score"] == pytest.approx(want)


def best_alignment(a, b):
    cands = []
    for o in range(1 - len(b), len(a)):
        cands.append((sum(a[i] == b[i - o] for i in range(max(0, o), min(len(a), len(b) + o))), -o))
    score, neg = max(cands)
    return score, -neg


def test_alignment(one):
    for a, b in [("ACGTA", "CGT"), ("AAAA", "AA"), ("ACG", "TTT"), ("GATTACA", "TTAC")]:
        r = one(M.alignment(F.lit(a), F.lit(b)))
        assert (r["score"], r["offset"]) == best_alignment(a, b)


def greedy(motifs, min_len):
    kept, out = [], set()
    for m in sorted(motifs, key=len):
        hits = []
        for k in kept:
            s, o = best_alignment(m, k)
            if s >= max(min_len - 1, 0.5 * min(len(m), len(k))):
                hits.append((s, k, o))
        if not hits:
            kept.append(m)
            out.add((m, m, 0))
        else:
            top = max(h[0] for h in hits)
            out |= {(m, k, o) for s, k, o in hits if s == top}
    return out


def test_merge_equals_one_by_one_greedy(spark):
    rng = random.Random(11)
    motifs = list(dict.fromkeys("".join(rng.choice("ACGT") for _ in range(rng.randint(5, 8))) for _ in range(60)))
    rows = [("d", m, i) for i, m in enumerate(motifs)] + [("e", "ACGTA", 0)]
    df = spark.createDataFrame(rows, "dataset_id string, motif string, first_seen int")
    out = M.merge_similar_motifs(df, ["dataset_id"], min_len=5)
    got = {(r["motif"], r["target"], r["shift"]) for r in out.where("dataset_id='d'").collect()}
    assert got == greedy(motifs, 5)
    single = M.merge_similar_motifs(df, ["dataset_id"], min_len=5, all_ties=False)
    assert single.count() == len(rows)


def test_a_chain_is_decided_in_order(spark):
    """Each is similar to the one before only: every second one is kept, whatever the rounds."""
    rows = [("d", f"m{k:02d}", k) for k in range(9)]
    ranked = spark.createDataFrame(rows, "dataset_id string, m string, rank int").select("dataset_id", "rank")
    edges = ranked.where("rank > 0").select("dataset_id", "rank", (F.col("rank") - 1).alias("kept"))
    assert sorted(r["rank"] for r in M.first_independent(ranked, edges, ["dataset_id"]).collect()) == [0, 2, 4, 6, 8]


def test_similar_motifs_share_a_run():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 9)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randint(len(a), 11)))
        if best_alignment(a, b)[0] >= max(4, 0.5 * len(a)):
            q = M.shared_run(len(a), 5, None)
            assert any(a[k : k + q] in b for k in range(len(a) - q + 1))


def test_similarity_finds_the_shift(spark):
    rng = random.Random(8)
    base = [[rng.random() for _ in range(4)] for _ in range(8)]
    cells = lambda name, m: [(name, i, s, m[i][j]) for i in range(len(m)) for j, s in enumerate("ACGU")]
    schema = "motif string, pos int, symbol string, p double"
    rows = lambda c: M.pwm_rows(spark.createDataFrame(c, schema), ["motif"]).withColumn("rbp", F.lit("r"))
    other = [[rng.random() for _ in range(4)] for _ in range(7)]
    db = rows(cells("t", base[2:]) + cells("z", other)).select(
        "rbp", F.col("motif").alias("target"), F.col("cols").alias("target_cols")
    )
    best = M.best_match(M.motif_similarity(rows(cells("q", base)), db, ["rbp"], 5), ["motif"]).collect()[0]
    assert (best["target"], best["offset"], best["overlap"]) == ("t", 2, 6)
    assert best["similarity"] == pytest.approx(1.0)


def best_by_columns(q, t, min_overlap):
    """Mean column correlation of the best offset, one column after another."""
    def r(x, y):
        if None in x or None in y:
            return 0.0
        mx, my = sum(x) / 4, sum(y) / 4
        sx, sy = sum(a * a for a in x) - mx * mx * 4, sum(a * a for a in y) - my * my * 4
        return (sum(a * b for a, b in zip(x, y)) - mx * my * 4) / (sx * sy) ** 0.5 if sx > 1e-12 and sy > 1e-12 else 0.0

    found = []
    for o in range(1 - len(t), len(q)):
        at = range(max(0, o), min(len(q), len(t) + o))
        if len(at) >= min_overlap:
            found.append((sum(r(q[i], t[i - o]) for i in at) / len(at), -o, len(at)))
    return max(found, default=None)


def test_similarity_of_every_pair_however_it_is_dealt(spark):
    rng = random.Random(9)
    column = lambda: rng.choice([[0.25] * 4, [1.0, 0.0, 0.0, 0.0], [rng.random() for _ in range(4)], [0.5, None, 0.5, 0.0]])
    motifs = [("g" if i % 5 else "h", f"m{i:02d}", [column() for _ in range(rng.choice([0, 3, 5, 6, 8]))]) for i in range(40)]
    rows = [*motifs, ("g", "lost", None), (None, "apart", [[1.0, 0.0, 0.0, 0.0]] * 6), ("only", "one", [[1.0, 0.0, 0.0, 0.0]] * 6), motifs[7]]
    df = spark.createDataFrame(rows, "grp string, motif string, cols array<array<double>>")
    db = df.where("motif != 'one'").select("grp", F.col("motif").alias("target"), F.col("cols").alias("target_cols"))
    want = sorted(
        (a, q, t, s[0], -s[1], s[2]) for a, q, x in rows for b, t, y in rows
        if a is not None and a == b and t != "one" and x and y and (s := best_by_columns(x, y, 5))
    )
    for sizes in ({}, {"part_columns": 30, "group_rows": 4}):
        got = sorted(map(tuple, M.motif_similarity(df, db, ["grp"], 5, **sizes).collect()))
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_similarity_query_compares_motifs_of_any_leading_letters(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(12)
    regions = ["ddddd", "bdddd", "dbddd", "bbbbbbb", "dddddddd", "dbdbd", "bbddd"]
    texts = ["".join(rng.choice("aaaacc") if rng.random() < 0.8 else f"a{rng.choice(regions)}c" for _ in range(120)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "web", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, entry.queries()["motif_similarity"](spark, str(tmp_path)).select("motif", "target", "similarity").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["motif_similarity"]).fetchall())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    motifs = {"".join({"b": "C", "d": "T"}[c] for c in w[:5]) for w in regions}
    assert motifs <= {g[0] for g in got} and any(m[:2] != t[:2] for m, t, _ in got)


def annotate(s):
    """Stack-based statement of the seven states."""
    mate, stack = {}, []
    for i, c in enumerate(s):
        if c == "(":
            stack.append(i)
        elif c == ")":
            j = stack.pop()
            mate[i], mate[j] = j, i
    br = [i for i, c in enumerate(s) if c != "."]
    nxt = lambda i: min((j for j in br if j > i), default=None)
    prv = lambda i: max((j for j in br if j < i), default=None)
    out = []
    for i, c in enumerate(s):
        if c != ".":
            out.append("L" if c == "(" else "R")
            continue
        k, m = prv(i), nxt(i)
        if k is None or m is None:
            out.append("E")
        elif s[k] == "(" and s[m] == ")":
            out.append("H")
        elif s[k] == ")" and s[m] == "(":
            out.append("M" if any(j < k and mate[j] > m for j in br if s[j] == "(") else "E")
        elif mate[m] + 1 == mate[k]:
            out.append("B")
        elif s[m] == "(":
            n = nxt(mate[m])
            out.append("M" if n is not None and s[n] == "(" else "T")
        else:
            p = prv(mate[k])
            out.append("M" if p is not None and s[p] == ")" else "T")
    return "".join(out)


def random_fold(rng, depth):
    dots = lambda: "." * rng.choice([0, 0, 1, 3])
    if depth == 0:
        return "." * 3
    body = "".join(dots() + "(" + random_fold(rng, depth - 1) + ")" for _ in range(rng.choice([1, 1, 2, 3])))
    return body + dots()


def test_structure_states(spark):
    rng = random.Random(6)
    folds = ["...", "((..)).(...)", "(.(..))", "((.(...)).(...).)", ".((...)..).", "()"]
    folds += [dotted for dotted in (random_fold(rng, d) for d in (1, 2, 3, 4) for _ in range(12))]
    df = spark.createDataFrame(list(enumerate(folds)), ["rec_id", "structure"])
    got = {r["rec_id"]: r["states"] for r in ST.annotate_structure(df.repartition(4)).collect()}
    assert [got[i] for i in range(len(folds))] == [annotate(f) for f in folds]


def test_structure_at_motif_takes_first_occurrence(spark):
    recs = spark.createDataFrame(
        [("d", 1, "GGUGAAGAUGAAGA", "EELLLLLLHHHHHH"), ("d", 2, "AAAAAA", "EEEEEE")], ["dataset_id", "rec_id", "seq", "states"]
    )
    motifs = spark.createDataFrame([("d", "TGAAGA"), ("d", "TGAAG"), ("e", "AAAAAA")], ["dataset_id", "motif"])
    out = M.structure_at_motif(motifs, recs, ["dataset_id"]).collect()
    assert [(r["motif"], r["rec_id"], r["position"], r["states"]) for r in out] == [("UGAAGA", 1, 3, "LLLLLL")]


def test_profiles(spark):
    prof = lambda v: spark.createDataFrame([(1, v)], "rec_id int, profile array<double>")
    out = {
        r["structure_type"]: r["profile"]
        for r in ST.paired_probability(prof([0.1, 0.2]), prof([0.2, 0.1]), prof([0.0, 0.3]), prof([0.3, 0.1])).collect()
    }
    assert out["paired"] == pytest.approx([0.4, 0.3])
    df = spark.createDataFrame([("g", [1.0, float("nan")]), ("g", [3.0, 4.0])], "g string, profile array<double>")
    mean = {r["pos"]: r["mean_value"] for r in ST.mean_profile(df, ["g"], centre=1).collect()}
    assert mean == {-1: 2.0, 0: 4.0}
    z = prof([1.0, 3.0]).select(ST.zscore_row("profile")).collect()[0][0]
    assert z == [-1.0, 1.0]
    assert prof([2.0, 2.0]).select(ST.zscore_row("profile")).collect()[0][0] == [0.0, 0.0]


def test_discovery_end_to_end(spark):
    """A planted word in every positive is found, merged and re-centred."""
    rng = random.Random(9)
    word, rows = "GATTACA", []
    for i in range(120):
        seq = "".join(rng.choice("ACGT") for _ in range(60))
        scores = [0.1] * 60
        label = int(i < 60)
        if label:
            at = rng.randint(12, 40)
            seq = seq[:at] + word + seq[at + 7 :]
            scores[at : at + 7] = [1.0] * 7
        rows.append(("d", i, seq, label, scores))
    df = spark.createDataFrame(rows, "dataset_id string, rec_id int, seq string, label int, scores array<double>")
    out = MD.discover_motifs(df, min_len=5, width=24).collect()
    assert {r["motif"] for r in out} == {word} and len(out) == 60
    assert all(r["window"][8:15] == word and r["end"] - r["start"] == 24 for r in out)


def test_prior_features(spark):
    rng = random.Random(10)
    rows = []
    for i in range(80):
        seq = "".join(rng.choice("ACGU") for _ in range(40))
        if i < 40:
            seq = seq[:10] + "GGGGG" + seq[15:]
        rows.append(("d", i, int(i < 40), seq, "E" * 40))
    df = spark.createDataFrame(rows, "dataset_id string, rec_id int, label int, seq string, states string")
    f = MP.prior_features(df, ["seq_4", "struct_7"], width=5, max_motifs=2)
    names = sorted({r["feature"] for r in f.select("feature").distinct().collect()})
    assert "seq_4_GGGGG" in names
    wide = MP.feature_matrix(f, names)
    assert wide.count() == 80
    vectors, places = MP.feature_vectors(f)
    assert [r["feature"] for r in places.orderBy("place").collect()] == names
    cells = {(r["rec_id"], p): s for r in vectors.collect() for p, s in zip(r["places"], r["scores"], strict=True)}
    want = {(r["rec_id"], names.index(r["feature"])): r["score"] for r in f.collect() if r["score"]}
    assert cells == want and vectors.count() == 80
    means = {r["class"]: r["m"] for r in wide.groupBy("class").agg(F.avg("seq_4_GGGGG").alias("m")).collect()}
    assert means[1] == pytest.approx(1.0) and means[0] < 0.5


def test_alphabet_tables_agree():
    assert len(S.LETTERS_28) == len(S.LETTERS_16) == len(S.LETTERS_8) == 28
    assert set(MP.ALPHABETS["seq_struct_16"]) == set(S.LETTERS_16)


def test_word_counts_are_records_that_hold_a_word(spark):
    from ribospan.plans.motif_prior import word_counts

    texts = ["AAAAA", "AAAB", "ABAB", "", "AB", None, "αβαβα", "αβ|", "ABAB" * 20, "\U0001f600AB\U0001f600AB"]
    rows = [(["x", "y", None][i % 3], i % 2, [1, 0, None][(i // 2) % 3], t) for i, t in enumerate(texts * 4)]
    df = spark.createDataFrame(rows, "dataset_id string, alphabet int, label int, seq string").repartition(3)
    for width in (1, 2, 3, 40):
        want = {}
        for d, a, label, t in rows:
            for w in {t[i : i + width] for i in range(len(t) - width + 1)} if t else ():
                n, p = want.get((d, a, w), (0, 0))
                want[d, a, w] = n + 1, p + (label == 1)
        counts = word_counts(df, ["dataset_id", "alphabet"], width)
        assert "transform(" not in counts._jdf.queryExecution().executedPlan().toString()
        assert {(r["dataset_id"], r["alphabet"], r["motif"]): (r["n_with"], r["n_pos_with"]) for r in counts.collect()} == want


def test_first_places_of_words_and_weighted_instances(spark):
    from ribospan.functions.scans import first_words
    from ribospan.operators import motifs as MO

    texts = ["ACGACG", "", "AC", "ÄbÄbÄ", "AAAA" * 30]
    for width in (1, 2, 3, 50):
        record, at, words = first_words(texts, width)
        want = {(i, t[j : j + width]): t.find(t[j : j + width]) for i, t in enumerate(texts) for j in range(len(t) - width + 1)}
        assert dict(zip(zip(record.tolist(), words.to_pylist()), at.tolist())) == want and len(words) == len(want)
    recs = spark.createDataFrame([("d", 1, "ACGACG", "LLLRRR"), ("d", 2, "ACGU", "EE"), ("d", 3, "ACG", None), ("d", 4, None, "E"), (None, 5, "ACG", "EEE")], "dataset_id string, rec_id int, seq string, states string")
    motifs = spark.createDataFrame([("d", "ACG"), ("d", "CGT"), ("d", "TTT"), (None, "ACG")], "dataset_id string, motif string")
    hits = MO.structure_at_motif(motifs, recs, ["dataset_id"], width=3)
    assert "transform(" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[1:] for r in hits.collect()} == {("ACG", 1, 1, "LLL"), ("ACG", 2, 1, "EE"), ("CGU", 2, 2, "E"), ("ACG", 3, 1, None)}
    rows = spark.createDataFrame([("m", "LL"), ("m", "LL"), ("m", "LR"), ("m", None)], "motif string, states string")
    plain = MO.symbol_frequencies(rows, ["motif"], "states", "LR")
    counted = MO.symbol_frequencies(rows.groupBy("motif", "states").count(), ["motif"], "states", "LR", weight="count")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, counted.collect()))
    assert {tuple(r)[1:] for r in plain.collect()} == {(0, "L", 0.75), (0, "R", 0.0), (1, "L", 0.5), (1, "R", 0.25)}


def test_kmer_numbers_of_a_batch_and_logits_under_any_weights(spark):
    from ribospan.plans import training as TR

    texts = ["ACGU", "TTNN", "", "A", None, "AxCGAC", "GGGG", "RRA"]
    df = spark.createDataFrame([("m" if i != 6 else "n", t) for i, t in enumerate(texts)], "dataset_id string, seq string").coalesce(1)
    rna = [None if t is None else t.replace("T", "U").replace("N", "A") for t in texts]
    counts = df.select(TR.kmer_counts("seq", 2).alias("c"))
    assert "transform(" not in counts._jdf.queryExecution().executedPlan().toString()
    grams = lambda t: [t[i : i + 2] for i in range(len(t or "") - 1)]
    assert [r["c"] for r in counts.collect()] == [[float(grams(t).count(g)) for g in S.vocabulary_kmers(2)] for t in rna]
    weights = {"AC": 0.5, "GU": -1.0, "UU": 2.0, "RR": 4.0, "A": 9.0}
    models = spark.createDataFrame([("m", 0.25, weights), ("n", 1.0, None)], "model_id string, bias double, weights map<string,double>")
    got = {r["seq"]: r["logit"] for r in TR.predict(df, models).collect()}
    for t, r in zip(texts, rna):
        assert got[t] == (None if t == "GGGG" else pytest.approx(0.25 + sum(weights.get(g, 0.0) for g in grams(r))))


def test_instances_of_words_meet_them_without_a_shuffle(spark):
    from ribospan.plans.motif_prior import word_instances
    from ribospan.session import materialize

    by = ["dataset_id", "alphabet"]
    rows = spark.createDataFrame([("d", "x", "ACGUACG"), ("d", "y", "ACGU"), ("e", "x", "ACGACG"), ("d", "x", None)], "dataset_id string, alphabet string, seq string")
    words = materialize(spark.createDataFrame([("d", "x", "CG"), ("e", "x", "AC")], "dataset_id string, alphabet string, motif string"))
    found = word_instances(rows, words, by, 2, 1)
    assert sorted(map(tuple, found.collect())) == [("d", "x", "CG", "ACGU"), ("e", "x", "AC", "GACG")]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["seq"] for r in word_instances(rows, words, by, 2, 0).collect()) == ["AC", "AC", "CG", "CG"]


def test_states_at_motifs_are_summed_in_the_task(spark):
    """``totals`` gives what the single rows add up to, also for texts that no task can number."""
    rows = [(["x", "y"][i % 2], i, "ACGUACGUUU"[i % 3 :], "EELLLRRRTT"[i % 3 :]) for i in range(200)]
    rows += [("x", 900, "ACGUACG", None), ("x", 901, "acgACG", "LLLEEE"), ("y", 902, "ACGU", "EE"), ("x", 903, "AC", "EE"), (None, 904, "ACGU", "EEEE")]
    recs = spark.createDataFrame(rows, "dataset_id string, rec_id bigint, seq string, states string")
    motifs = spark.createDataFrame([(d, m) for d in "xy" for m in ("ACG", "CGT", "UUU", "GGG")], "dataset_id string, motif string")
    single = M.structure_at_motif(motifs, recs, ["dataset_id"], width=3).collect()
    want = {}
    for r in single:
        n, p = want.get((r["dataset_id"], r["motif"], r["states"]), (0, 0))
        want[r["dataset_id"], r["motif"], r["states"]] = (n + 1, p + r["position"])
    found = M.structure_at_motif(motifs, recs, ["dataset_id"], width=3, totals=True).collect()
    assert len(found) == len(want)
    assert {(r["dataset_id"], r["motif"], r["states"]): (r["n"], r["positions"]) for r in found} == want


def test_words_of_many_batches_are_added_up_before_they_leave():
    from ribospan.functions.scans import WordSums
    from ribospan.functions.special import text_bytes

    rng = random.Random(13)
    for width in (1, 3, 5):
        sums, want, taken = WordSums(width), {}, {}
        for part in range(6):
            texts = ["".join(rng.choice("ACGUab|") for _ in range(rng.choice([0, 1, 2, 4, 5, 9, 40]))) for _ in range(30)] + [None, "AAAAAAAA"]
            which, marked = np.array([rng.randint(0, 2) for _ in texts]), np.array([rng.random() < 0.5 for _ in texts])
            groups = [("x", part % 2), (None, 1), ("y", 0)]
            import pyarrow as pa

            assert sums.add(*text_bytes(pa.array(texts, pa.string())), groups, which, marked)
            for t, g, m in zip(texts, which, marked):
                for w in {t[i : i + width] for i in range(len(t) - width + 1)} if t else ():
                    n, p = want.get((groups[g], w), (0, 0))
                    want[groups[g], w] = n + 1, p + int(m)
            if part == 2:
                sums.merge()
                assert sums.size == len(want)
        for groups, which, words, n, in_marked in sums.taken():
            cells = zip([groups[k] for k in which], words.to_pylist(), zip(n.tolist(), in_marked.tolist(), strict=True), strict=True)
            for g, w, counts in cells:
                assert (g, w) not in taken
                taken[g, w] = counts
        assert taken == want and sums.size == 0 and not sums.groups
    assert not WordSums(5).add(*text_bytes(pa.array(["ACGÄA"])), [()], np.zeros(1, np.int64), np.ones(1, bool))
    assert not WordSums(9).add(*text_bytes(pa.array(["ACGUACGUAC"])), [()], np.zeros(1, np.int64), np.ones(1, bool))


def test_enriched_words_read_the_rows_once_and_count_all_records_of_a_group(spark, tmp_path):
    """Records shorter than a word belong to the population, those of a null group to none."""
    rows = [("d", i, int(i < 30), ("GGGGG" if i < 30 else "") + "ACGUU"[i % 5 :]) for i in range(90)]
    rows += [("d", 90 + i, 0, ["A", None, ""][i % 3]) for i in range(30)] + [(None, 1, 1, "GGGGG"), ("e", 1, None, "ACGUA")]
    schema = "dataset_id string, rec_id int, label int, seq string"
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, schema).mapInArrow(passed, schema)
    found = MP.enriched_words(df, ["dataset_id"], 5, None).collect()
    assert read.value == len(rows)
    best = {r["motif"]: r for r in found}
    assert {r["dataset_id"] for r in found} == {"d"} and (best["GGGGG"]["total"], best["GGGGG"]["positives"]) == (120, 30)
    assert best["GGGGG"]["n_with"] == best["GGGGG"]["n_pos_with"] == 30


def test_instances_are_found_without_a_row_for_each_gram(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["ÄCGÄCG", "ACG", "ACGACGACG"]
    rows = spark.createDataFrame([(["d", "e", None][i % 3], t) for i, t in enumerate(texts)], "dataset_id string, seq string")
    listed = [("d", "ACG"), ("d", "CGA"), ("d", "AC"), ("e", "GGG"), ("e", "GGG"), ("e", None), (None, "ACG"), ("f", "AAA"), ("d", "ÄCG")]
    words = spark.createDataFrame(listed, "dataset_id string, motif string")
    found = MP.word_instances(rows, words, ["dataset_id"], 3, 1)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted(
        (g, w, t[j - 1 : j + 4]) for i, t in enumerate(texts) for g, w in listed
        if g and g == ["d", "e", None][i % 3] for j in range(1, len(t) - 3) if t[j : j + 3] == w
    )
    assert sorted(map(tuple, found.collect())) == want and len(want) > 10


@pytest.mark.parametrize("n", [1, 2, 5])
def test_scan_prunes_nothing_that_counts(n):
    from ribospan.functions.scans import stacked_top_sums

    rng = random.Random(15 + n)
    letters = S.LETTERS_28
    texts = ["".join(rng.choice(letters[:6] + "z") for _ in range(rng.choice([0, 3, 7, 11, 30]))) for _ in range(40)]
    matrices = [[[rng.choice([0.0, 0.0, rng.random()]) if j < k else 0.0 for j in range(28)] for _ in range(w)] for w, k in ((1, 6), (3, 4), (7, 28), (7, 6), (4, 0))]
    got = stacked_top_sums([t.encode() for t in texts], matrices, letters, n)
    for t, row in zip(texts, got):
        for m, score in zip(matrices, row):
            each = [np.prod([m[j][letters.index(c)] if c in letters else 0.0 for j, c in enumerate(t[i : i + len(m)])]) for i in range(len(t) - len(m) + 1)]
            assert score == pytest.approx(sum(sorted(each)[-n:]) if len(each) >= n else 0.0, rel=1e-12)


def test_vectors_of_records_without_a_score_are_empty(spark):
    rows = [("d", 1, 1, "a", 0.0), ("d", 1, 1, "b", 2.0), ("d", 1, 1, "c", 1.0), ("d", 2, 0, "a", 0.0), ("d", 2, 0, "b", 0.0), ("e", 1, 1, "b", 3.0)]
    rows += [("d", None, None, "b", 4.0), ("d", None, None, "a", None), (None, 3, 1, "a", 5.0), ("e", 4, 0, None, 6.0), ("d", 1, 1, "b", 2.0)]
    features = spark.createDataFrame(rows, "dataset_id string, rec_id int, label int, feature string, score double")
    vectors, places = MP.feature_vectors(features)
    want = {("d", 1, 1): ([1, 1, 2], [2.0, 2.0, 1.0]), ("d", 2, 0): ([], []), ("e", 1, 1): ([1], [3.0]), ("d", None, None): ([1], [4.0])}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in vectors.collect()} == want and vectors.count() == len(want)
    assert [r["feature"] for r in places.where("dataset_id = 'd'").orderBy("place").collect()] == ["a", "b", "c"]
