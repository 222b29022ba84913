"""Steps that go over a batch of records at once give what the row-by-row definition gives."""

import pathlib
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.functions import sequence as S
from ribospan.functions.special import listed_words, track_sums, true_runs
from ribospan.operators import features as FE
from ribospan.operators import kmers as K
from ribospan.operators import motifs as M
from ribospan.sources import record_files as RF

TEXTS = ["ACGTN", "", None, "A\U0001f600CG", "TTTTUa", "GATTACA" * 20]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_are_cut_by_offsets(spark, tmp_path):
    texts = ["Ab, c\u00e9 \u00dfz! " * 40, None, "", "12 34", "x" * 202, "QqZz"]
    rows = [(k, t, "s", "l") for k, t in enumerate(texts)] + [(None, "abc", None, "l")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    w = X.windows(spark, str(tmp_path))
    assert "regexp" not in plan(w)
    got = sorted((str(r["doc_id"]), str(r["rec_id"]), r["seq"]) for r in w.collect())
    expected = []
    for doc, text, *_ in rows:
        letters = re.sub("[^A-Za-z]", "", text or "").lower().translate(str.maketrans(X.LETTERS, X.BASES))
        for k in range(0, len(letters), 101):
            expected.append((str(doc), str(None if doc is None else doc * X.WINDOW_ID_STEP + k // 101), letters[k : k + 101]))
    assert got == sorted(expected)


def test_kmers_are_counted_in_the_task(spark):
    rows = [(g, x, t) for g, x in (("a", 1), ("b", None), (None, 1)) for t in TEXTS]
    df = spark.createDataFrame(rows, "g string, x int, seq string")
    counts = K.kmer_counts(df, 3, ["g", "x"])
    assert "explode" not in plan(counts)
    expected = Counter()
    for g, x, t in rows:
        for k in range(len(t or "") - 2):
            if set(t[k : k + 3]) <= set("ACGT"):
                expected[g, x, t[k : k + 3]] += 1
    assert {(r["g"], r["x"], r["kmer"]): r["n"] for r in counts.collect()} == expected
    assert {r["kmer"]: r["n"] for r in K.kmer_counts(df, 3, []).collect()} == Counter(key[2] for key in expected.elements())


def test_one_hot_cells_are_emitted_by_batches(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "rec_id int, seq string")
    for max_len in (None, 9):
        cells = FE.one_hot_long(df, ["rec_id"], max_len)
        assert "MapInArrow" in plan(cells)
        expected = []
        for k, t in enumerate(TEXTS):
            left = 0 if max_len is None else (max_len - len(t or "")) // 2
            expected += [(k, i + left, c.replace("U", "T"), 1.0) for i, c in enumerate((t or "").upper()) if c in "ACGTU"]
        assert sorted(tuple(r) for r in cells.collect()) == sorted(expected)


def test_weighted_tracks_by_batches(spark):
    weights = [[0.5 * k for k in range(len(t or ""))] for t in TEXTS]
    df = spark.createDataFrame(list(zip(TEXTS, weights)), "seq string, weights array<double>")
    track = S.weighted_one_hot("seq", "weights", "T", 8)
    rows = df.select(track.alias("t"), track_sums(track).alias("s"))
    assert "ArrowEvalPython" in plan(rows)
    for t, w, r in zip(TEXTS, weights, rows.collect(), strict=True):
        if t is None:
            assert r["t"] == []
            continue
        hot = [x if c.upper() in "TU" else 0.0 for c, x in zip(t, w)]
        left = max(8 - len(t), 0) // 2
        assert r["t"] == [0.0] * left + hot + [0.0] * (max(8 - len(t), 0) - left)
        assert r["s"]["total"] == pytest.approx(sum(hot)) and r["s"]["present"] == sum(x > 0 for x in hot)


def test_token_ids_chemistry_and_density_by_batches(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "seq string")
    rows = df.select(
        S.tokenize_ids(S.kmers("seq", 1), 6).alias("t"), FE.chemistry_features("seq", 4).alias("c"), FE.nucleotide_density("seq").alias("d")
    )
    assert "ArrowEvalPython" in plan(rows)
    for t, r in zip(TEXTS, rows.collect(), strict=True):
        if t is None:
            assert r["t"]["input_ids"] == [2, 3, 0, 0, 0, 0] and r["c"] == [None] * 4 and r["d"] is None
            continue
        ids = [S.VOCABULARY.index(c) if c in S.VOCABULARY else 1 for c in t][:4]
        assert r["t"]["input_ids"] == ([2, *ids, 3] + [0] * 6)[:6]
        assert r["c"] == [FE.CHEMISTRY.get(c) for c in t] + [[0.0, 0.0, 1.0]] * (4 - len(t))
        assert r["d"] == [round(t[: i + 1].count(c) / (i + 1), 3) for i, c in enumerate(t)]


def test_density_of_many_letters(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(90))
    got = spark.createDataFrame([(text,), ("ab",)], "seq string").select(FE.nucleotide_density("seq").alias("d")).collect()
    assert got[0]["d"] == [round(text[: i + 1].count(c) / (i + 1), 3) for i, c in enumerate(text)]


def test_listed_words_by_batches(spark):
    texts = [*TEXTS, "|A|A||", "AAAA"]
    found = listed_words(["AA", "A|", "AT", "\U0001f600C"], 2)
    got = spark.createDataFrame([(t,) for t in texts], "seq string").select(found("seq").alias("n")).collect()
    for t, r in zip(texts, got, strict=True):
        pairs = Counter((t or "")[k : k + 2] for k in range(len(t or "") - 1))
        assert r["n"] == (None if t is None else [float(pairs[w]) for w in ("AA", "A|", "AT", "\U0001f600C")])


def test_regions_by_batches_are_those_of_the_expression(spark):
    masks = [[True, True, False, True], [], None, [True] * 5, [False, True, True], [True, None, True], [None, True, True, False, True, True]]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(masks)], "rec_id int, scores array<boolean>")
    expected = df.select("rec_id", F.inline(M.true_regions("scores", 2))).collect()
    rows = M.high_score_regions(df, ["rec_id"], min_len=2, condition=lambda m: m)
    assert "MapInArrow" in plan(rows)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected))
    record, start, end = true_runs(pa.array(masks, pa.list_(pa.bool_())), 2)
    assert sorted(zip(record.tolist(), start.tolist(), end.tolist())) == sorted(map(tuple, expected))


def test_tasks_of_record_files_grow_no_faster_than_bounded(tmp_path, monkeypatch):
    folder = pathlib.Path(tmp_path)
    for k in range(40):
        (folder / f"d{k}.fa").write_text("".join(f">r{k}_{i}\nACGU\n1,2,3,4\n" for i in range(30)))
    from pyspark.sql.types import StructType

    reader = RF.RecordReader({"path": str(folder), "splitbytes": "16"}, StructType().add("rec_id", "string"))
    total = sum(f.stat().st_size for f in folder.iterdir())
    tasks = reader.partitions()
    assert len(tasks) <= 2 * RF.GROWN_RANGES < total // 16
    got = [row[0] for task in tasks for row in reader.read(task)]
    assert sorted(got) == sorted(f"r{k}_{i}" for k in range(40) for i in range(30))
