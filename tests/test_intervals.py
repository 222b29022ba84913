import random

import pytest

from ribospan.operators import intervals as I


def brute(rows, cells, mode):
    out = {}
    for i, a in enumerate(cells):
        for b in cells[i + 1 :]:
            n = 0
            for r1 in rows:
                if r1[1] != a:
                    continue
                hits = sum(
                    r2[1] == b and r1[0] == r2[0] and r1[2] == r2[2] and r1[3] < r2[4] and r2[3] < r1[4]
                    for r2 in rows
                )
                n += hits if mode == "raw" else hits > 0
            out[f"{a}&{b}"] = n
    return out


@pytest.mark.parametrize("mode", ["raw", "unique"])
def test_overlap_counts(spark, mode):
    rng = random.Random(2)
    cells = ["K562", "HepG2", "H9", "none"]
    rows = []
    for _ in range(300):
        # A third of the intervals pile up on one spot.
        s = 50 if rng.random() < 0.33 else rng.randint(0, 200)
        rows.append((rng.choice("AB"), rng.choice(cells[:3]), rng.choice(["c1", "c2"]), s, s + rng.randint(1, 20)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "rbp string, cell string, chrom string, start bigint, end bigint")
    got = {r["interaction"]: r["n_shared"] for r in I.interval_overlap_count(df, cells, mode).collect()}
    assert got == brute(rows, cells, mode)


def test_touching_intervals_do_not_overlap(spark):
    df = spark.createDataFrame(
        [("A", "x", "c", 0, 10), ("A", "y", "c", 10, 20)],
        "rbp string, cell string, chrom string, start bigint, end bigint",
    )
    assert I.interval_overlap_count(df, ["x", "y"]).collect()[0]["n_shared"] == 0


def test_empty_interval_is_an_error(spark):
    df = spark.createDataFrame(
        [("A", "x", "c", 5, 5)], "rbp string, cell string, chrom string, start bigint, end bigint"
    )
    with pytest.raises(Exception, match="after its start"):
        I.interval_overlap_count(df, ["x", "y"]).collect()


@pytest.mark.parametrize("mode", ["raw", "unique"])
def test_long_intervals_reach_over_many_ranges(spark, mode, monkeypatch):
    """Points are walked along once: no running sums of a column per cell over the whole axis."""
    rng = random.Random(6)
    cells = ["a", "b", "c"]
    rows = [("A", "a", "c1", 0, 5000), ("A", "b", "c1", 10, 11), ("B", "c", "c1", 3, 4000), ("B", "a", "c2", 7, 8)]
    for _ in range(400):
        s = rng.randint(0, 4000)
        rows.append((rng.choice("AB"), rng.choice(cells), rng.choice(["c1", "c2"]), s, s + rng.choice([1, 2, 5, 900])))
    df = spark.createDataFrame(rows, "rbp string, cell string, chrom string, start bigint, end bigint").repartition(3)
    monkeypatch.setattr(I, "running_sums", None, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["interaction"]: r["n_shared"] for r in I.interval_overlap_count(df, cells, mode).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, cells, mode)
