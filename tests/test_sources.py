import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ribospan.operators import motifs as M
from ribospan.sources import readers as R
from ribospan.sources import writers as W
from ribospan.sources.record_files import RecordFiles


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_triplets_and_labels(spark, tmp_path):
    put(tmp_path, "AUH_HepG2_pos.fa", ">r1 chr1:1-4 T>A\nACGT\n0.1,0.2,0.3,0.4\n\n>r2\nAC\n1,2\n")
    put(tmp_path, "AUH_HepG2_neg.fa", ">r3\nNU\n0,0\n")
    rows = {r["rec_id"]: r for r in R.read_labeled_pair(spark, str(tmp_path)).collect()}
    assert set(rows) == {"r1 chr1:1-4 T>A", "r2", "r3"}
    first = rows["r1 chr1:1-4 T>A"]
    assert (first["dataset_id"], first["label"], first["seq"]) == ("AUH_HepG2", 1, "ACGT")
    assert first["track"] == [0.1, 0.2, 0.3, 0.4] and rows["r3"]["label"] == 0


@pytest.mark.parametrize(
    "text, reason",
    [(">a\nACGX\n1,2,3,4\n", "invalid sequence"), (">a\nACG\n1,2\n", "length mismatch"), (">a\nACG\n", "not three")],
)
def test_bad_triplets(spark, tmp_path, text, reason):
    path = put(tmp_path, "x_pos.fa", text + ">ok\nA\n1\n")
    with pytest.raises(Exception, match=reason):
        R.read_triplet_fasta(spark, path).collect()
    kept = R.read_triplet_fasta(spark, path, strict=False).collect()
    assert len(kept) == 2 and sum(r["bad_reason"] is None for r in kept) == 1


def test_wrapped_fasta(spark, tmp_path):
    path = put(tmp_path, "S_K562.fa", ">h1 10:A>G x\nacg\nTTA\n\n>h2\nGG\n")
    rows = {r["header"]: r["seq"] for r in R.read_fasta(spark, path).collect()}
    assert rows == {">h1 10:A>G x": "ACGTTA", ">h2": "GG"}


def test_kmer_tsv(spark, tmp_path):
    path = put(tmp_path, "dev.tsv", "rna_kmers\tlabel\nACG CGT\t1\nAAA\t0\n")
    assert {(r["seq"], r["label"]) for r in R.read_kmer_tsv(spark, path).collect()} == {("ACGT", 1), ("AAA", 0)}
    loose = put(tmp_path, "loose.tsv", "seq\tlabel\nacgta\t1\nccc\nggg\t-2\n")
    got = {(r["seq"], r["label"]) for r in R.read_kmer_tsv(spark, loose, lenient=True, max_len=4).collect()}
    assert got == {("ACGT", 1), ("CCC", 0), ("GGG", -2)}


def test_site_tsv_drops_repeated_headers(spark, tmp_path):
    path = put(tmp_path, "s.tsv", "Type\tloc\tSeq\tStr\tScore\tlabel\na\tl1\tACG\t...\t0.5\t1\nType\tloc\tSeq\tStr\tScore\tlabel\n")
    rows = R.read_site_tsv(spark, path).collect()
    assert [(r["loc"], r["score"], r["label"]) for r in rows] == [("l1", 0.5, 1)]


def test_structure_profiles(spark, tmp_path):
    block = "\n".join("\t".join(str(i + j / 10) for j in range(3)) for i in range(5))
    path = put(tmp_path, "d.txt", f">r1\n{block}\n>r2\n{block}\n")
    rows = R.read_structure_profiles(spark, path, length=3).collect()
    assert len(rows) == 10
    assert {r["structure_type"] for r in rows} == set(R.STRUCTURE_ROWS)
    with pytest.raises(Exception, match="101 values"):
        R.read_structure_profiles(spark, path).collect()


def test_meme_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d", "m1", "TGA"), ("d", "m1", "TCA"), ("d", "m2", "GG")], ["dataset_id", "motif", "seq"])
    pwm = M.pwm_from_instances(df, ["dataset_id", "motif"])
    W.write_meme(pwm, ["dataset_id", "motif"], str(tmp_path / "meme"))
    back = R.read_meme(spark, str(tmp_path / "meme" / "*" / "*")).drop("dataset_id")
    key = lambda rows: sorted((r["motif"], r["pos"], r["symbol"], round(r["p"], 9)) for r in rows)
    assert key(back.collect()) == key(pwm.collect())


def test_meme_file_with_several_motifs(spark, tmp_path):
    text = (
        "MEME version 5\nALPHABET= ACGU\nBackground letter frequencies:A 0.25 C 0.25 G 0.25 U 0.25\n"
        "MOTIF X.1\nletter-probability matrix: alength= 4 w= 2\n1 0 0 0\n0 1e-1 0.9 0\n"
        "MOTIF X.2\nletter-probability matrix: alength= 4 w= 1\n0.25 0.25 0.25 0.25\n"
    )
    rows = R.read_meme(spark, put(tmp_path, "db.meme", text)).collect()
    assert len(rows) == 12
    assert {(r["pos"], r["symbol"]): r["p"] for r in rows if r["motif"] == "X.1"}[(1, "C")] == 0.1


def test_seq_struct_blocks_and_pfm(spark, tmp_path):
    block = lambda n: n + "\n" + "\n".join(" ".join(["0.5"] * 6) for _ in range(11))
    rows = R.read_seq_struct_pwm(spark, put(tmp_path, "A_K562.txt", block("m1") + "\n\n" + block("m2") + "\n")).collect()
    assert len(rows) == 2 * 66 and {r["symbol"] for r in rows if r["part"] == "struct"} == set("LREHBMT")
    pfm = R.read_pfm(spark, put(tmp_path / "p", "PFM-1.txt", "A\t0.1\t0.2\nC\t0.9\t0.8\n")).collect()
    assert {(r["symbol"], r["pos"]): r["p"] for r in pfm}[("C", 1)] == 0.8


def test_bed_and_lists(spark, tmp_path):
    put(tmp_path / "bed", "AARS_K562.bed", "chr1\t5\t9\textra\nchr2\t1\t2\tx\n")
    rows = R.read_bed(spark, str(tmp_path / "bed")).collect()
    assert {(r["rbp"], r["cell"], r["chrom"], r["start"], r["end"]) for r in rows} == {
        ("AARS", "K562", "chr1", 5, 9), ("AARS", "K562", "chr2", 1, 2),
    }
    put(tmp_path / "lists", "KHrbp_list.txt", "FMR1\nNOVA1\n")
    assert R.read_category_lists(spark, str(tmp_path / "lists")).where("category='KH'").count() == 2


def test_summary_stats(spark, tmp_path):
    path = put(tmp_path, "g.tsv", "variant_id\tp_value\tx\nrs1\t0,5\t1\nrs2\tNA\t1\nrs3\t1e-9\t1\n")
    rows = R.read_summary_stats(spark, path, {"variant_id": "rsid", "p_value": "p_value"}).collect()
    assert {(r["rsid"], r["p_value"]) for r in rows} == {("rs1", 0.5), ("rs3", 1e-9)}
    with pytest.raises(ValueError, match="beta"):
        R.read_summary_stats(spark, path, {"beta": "beta"})


def test_eqtl_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "Liver.v10.eGenes.txt.gz", "wt") as f:
        f.write("gene\trs_id\tpval_nominal\ng1\trs1\t1e-7\n")
    rows = R.read_eqtl(spark, str(tmp_path), {"rs_id": "rsid", "pval_nominal": "pval_nominal"}).collect()
    assert [(r["tissue"], r["rsid"], r["pval_nominal"]) for r in rows] == [("Liver", "rs1", 1e-7)]


def test_metric_table_and_logs(spark, tmp_path):
    path = put(tmp_path, "m.txt", "RBP_Cell\tA\tB\nAUH_K562\t0.5\tx\nB_H9 0.1 0.2\n\n")
    rows = {r["key"]: r for r in R.read_metric_table(spark, path, ["a", "b"]).collect()}
    assert rows["AUH_K562"]["b"] is None and rows["B_H9"]["b"] == 0.2
    line = "AUH_HepG2 \t Test  Epoch: 123     avg.loss: 2.9610 Acc: 0.84%, AUC: 0.9009 (0.9020), PRC: 0.8382, MCC: 0.6261, 103\n"
    log = put(tmp_path, "run1.log", "[RUN] x\n" + line + "AUH_HepG2 auc: 0.91\n")
    e = R.read_training_log(spark, log).collect()[0]
    assert (e["run"], e["epoch"], e["auc"], e["mcc"]) == ("run1", 123, 0.9009, 0.6261)
    assert R.read_eval_log(spark, log).collect()[0]["auc"] == 0.91
    js = put(tmp_path, "b.json", '{"run_name": "r",\n "best_epoch": 3, "best_val_auc": 0.9}')
    assert R.read_best_metrics(spark, js).collect()[0]["best_epoch"] == 3


def test_score_lines(spark, tmp_path):
    head = "variant_1 chr1:1-9(+)[utr]{NA} 5:A>G ENSG1[0.1]{rs1}"
    put(tmp_path, "AUH_HepG2_after_mut.txt", f"{head}\tPrediction_score:0.5\nbroken\n")
    loose = R.read_score_lines(spark, str(tmp_path), strict=False).collect()
    assert [(r["rbp"], r["cell"], r["mode"], r["score"], r["header"]) for r in loose] == [("AUH", "HepG2", "after", 0.5, head)]
    with pytest.raises(Exception, match="does not match"):
        R.read_score_lines(spark, str(tmp_path)).collect()
    path = put(tmp_path / "r", "ribo.txt", "v1 chr1:1-2 5:A>G K562 H9 AUH_K562 0.25\n")
    r = R.read_ribosnitch_scores(spark, path).collect()[0]
    assert (r["rbp"], r["cell"], r["cell2"], r["score"]) == ("AUH", "K562", "H9", 0.25)


def test_catalogs(spark, tmp_path):
    path = put(tmp_path, "c.csv", 'CHROM,POS,REF,ALT,RBP_list,ClinVar_CLNDN\n1,5,A,G,"AATF_K562,X_H9",d1|d2\n1,6,A,G,,d1\n')
    df = R.read_variant_catalog(spark, path)
    trips = {(r["variant"], r["rbp"], r["disease"]) for r in R.explode_catalog(df).collect()}
    assert trips == {("1:5:A>G", r, d) for r in ("AATF", "X") for d in ("d1", "d2")}
    row = "1,5,5,A,G,b,+,GBM,+,AATF_K562,1.5,2,g\n1,5,5,A,G,b,+,GBM,+,,1,2,g\n"
    assert R.read_cancer_catalog(spark, put(tmp_path / "t", "t.csv", row)).count() == 1


def test_position_rows(spark, tmp_path):
    path = put(tmp_path, "BUD13_K562_relative_positions.txt", "1,2,x\n-3,\n4\n")
    rows = R.read_position_rows(spark, path, ["AGGU", "UGUGU", "AGG"]).collect()
    assert sorted((r["motif"], r["distance"]) for r in rows) == [("AGG", 4.0), ("AGGU", 1.0), ("AGGU", 2.0), ("UGUGU", -3.0)]
    with pytest.raises(Exception, match="not a row for each motif"):
        R.read_position_rows(spark, put(tmp_path / "s", "a.txt", "1\n"), ["A", "B"]).collect()
    with pytest.raises(Exception, match="not a row for each motif"):
        R.read_position_rows(spark, path, ["A", "B"]).collect()


def test_checksums(spark, tmp_path):
    put(tmp_path / "f", "a.zip", "one")
    put(tmp_path / "f", "b.zip", "two")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    manifest = put(tmp_path, "m.sha256", f"{digest('one')} a.zip\n{digest('x')} b.zip\n{digest('y')} c.zip\n")
    got = {r["name"]: r["status"] for r in R.checksum_audit(spark, manifest, str(tmp_path / "f")).collect()}
    assert got == {"a.zip": "ok", "b.zip": "mismatch", "c.zip": "missing"}
    small = R.file_digests(spark.read.format("binaryFile").load(str(tmp_path / "f")), chunk=2).collect()
    assert {r["actual"] for r in small} == {digest("one"), digest("two")}


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    put(tmp_path / "g", "a.tsv", "variant_id\tp_value\nrs1\t0.5\n")
    put(tmp_path / "g", "b.tsv", "\np_value\tx\tvariant_id\n0.1\t7\trs2\n0,2\t8\trs3\np_value\tx\tvariant_id\n")
    names = {"variant_id": "rsid", "p_value": "p_value"}
    got = {(r["rsid"], r["p_value"]) for r in R.read_summary_stats(spark, str(tmp_path / "g"), names).collect()}
    assert got == {("rs1", 0.5), ("rs2", 0.1), ("rs3", 0.2)}
    eqtl = R.read_eqtl(spark, str(tmp_path / "g"), {"variant_id": "rsid", "p_value": "pval_nominal"}).collect()
    assert {(r["tissue"], r["rsid"], r["pval_nominal"]) for r in eqtl} == {("a", "rs1", 0.5), ("b", "rs2", 0.1), ("b", "rs3", None)}
    head = "CHROM,POS,REF,ALT,RBP_list,ClinVar_CLNDN\n1,5,A,G,\"X,Y\",d\n"
    put(tmp_path / "h", "a.csv", head)
    put(tmp_path / "h", "b.csv", head.replace("REF,ALT", "ALT,REF"))
    got = {(r["ref"], r["alt"], r["rbp_list"]) for r in R.read_variant_catalog(spark, str(tmp_path / "h")).collect()}
    assert got == {("A", "G", "X,Y"), ("G", "A", "X,Y")}
    put(tmp_path / "h", "c.csv", "CHROM,POS\n1,2\n")
    with pytest.raises(ValueError, match="ALT.*c.csv"):
        R.read_variant_catalog(spark, str(tmp_path / "h"))


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_record_files_are_read_in_ranges(spark, tmp_path, split):
    spark.dataSource.register(RecordFiles)
    read = lambda kind, path, **o: spark.read.format("record_files").options(kind=kind, splitBytes=split, **o).load(path)
    body = "".join(f">r{k} A>T\n{'ACGU' * k}\n{','.join(['1'] * (4 * k))}\n" for k in range(1, 6))
    put(tmp_path / "t", "A_K562_pos.fa", body)
    put(tmp_path / "t", "A_K562_neg.fa", body.replace(">r", "\n>n"))
    df = read("triplet", str(tmp_path / "t"))
    text = R.read_triplet_fasta(spark, str(tmp_path / "t"))
    names = ["dataset_id", "rec_id", "seq", "track", "label"]
    assert sorted(map(str, df.select(names).collect())) == sorted(map(str, text.select(names).collect()))
    sizes = [len(body), len(body) + 5]
    assert df.rdd.getNumPartitions() == sum(-(-n // split) for n in sizes)
    some = spark.read.format("record_files").schema("rec_id string, label int").options(kind="triplet", splitBytes=split).load(str(tmp_path / "t/A_K562_{pos,neg}.fa"))
    assert some.columns == ["rec_id", "label"] and some.count() == 10
    put(tmp_path / "bad", "A_K562_pos.fa", ">ok\nAC\n1,2\n>r1\nACGU\n1,2\n")
    loose = {r["rec_id"]: r["bad_reason"] for r in read("triplet", str(tmp_path / "bad"), strict="false").collect()}
    assert loose == {"ok": None, "r1": "length mismatch"}
    with pytest.raises(Exception, match="length mismatch"):
        read("triplet", str(tmp_path / "bad")).collect()


def test_record_files_of_profiles_and_motifs(spark, tmp_path):
    spark.dataSource.register(RecordFiles)
    rows = "\n".join("\t".join(str(k + i / 10) for i in range(3)) for k in range(5))
    path = put(tmp_path, "A_K562.txt", f">v1\n{rows}\n>v2\n{rows}\n")
    got = spark.read.format("record_files").options(kind="profile", splitBytes=40, length=3).load(path)
    assert sorted(map(str, got.collect())) == sorted(map(str, R.read_structure_profiles(spark, path, 3).collect()))
    meme = "MEME version 5\nALPHABET= ACGU\nMOTIF m1 x\nletter-probability matrix: alength= 4 w= 2\n0.1 0.2 0.3 0.4\n1 0 0 0\nMOTIF m2\nletter-probability matrix: w= 1\n0 0 0 1\n"
    path = put(tmp_path, "B.meme", meme)
    got = spark.read.format("record_files").options(kind="pwm", splitBytes=30).load(path)
    assert sorted(map(str, got.collect())) == sorted(map(str, R.read_meme(spark, path).collect()))
    with pytest.raises(Exception, match="unknown columns"):
        spark.read.format("record_files").schema("no string").options(kind="pwm").load(path).collect()


def test_strict_checks_hold_for_any_columns(spark, tmp_path):
    path = put(tmp_path / "t", "A_K562_pos.fa", ">r1\nACGU\n1,2\n")
    for read in (lambda d: d.count(), lambda d: d.select("rec_id", "track").collect()):
        with pytest.raises(Exception, match="length mismatch"):
            read(R.read_triplet_fasta(spark, path))
    rows = "\n".join("0.1\t0.2" for _ in range(5))
    profile = put(tmp_path / "p", "A_K562.txt", f">r1\n{rows}\n")
    with pytest.raises(Exception, match="does not have 101 values"):
        R.read_structure_profiles(spark, profile).select("rec_id").collect()


def test_append_formats(spark, tmp_path):
    df = spark.createDataFrame([(">h x", "A_K562", 0.5)], ["header", "model_id", "score"])
    out = str(tmp_path / "s")
    W.append_scores(df, out, W.gwas_line())
    W.append_scores(df, out, W.catalog_line("after"))
    W.append_scores(df, out, W.ribosnitch_line())
    assert {r["value"] for r in spark.read.text(out).collect()} == {
        "h x\tPrediction_score:0.500000",
        ">h x\tmodel_id=A_K562\tmode=after\tPrediction_score:0.500000",
        "h x\tA_K562\t0.5",
    }
    W.append_scores(df, str(tmp_path / "p"))
    W.append_scores(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_instance_and_difference_sinks(spark, tmp_path):
    inst = spark.createDataFrame([("d", "ACG", i, 0, "ACG") for i in range(5)], ["dataset_id", "motif", "rec_id", "start", "window"])
    W.write_motif_instances(inst, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).where("motif = 'ACG'").count() == 5
    diff = spark.createDataFrame([("Benign", 0.12345), ("Benign", float("inf"))], ["class", "value"])
    W.write_differences(diff, str(tmp_path / "d"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()} == {"Benign\t0.1235", "Benign\t"}
    W.write_metrics(diff.limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["class", "value"]


def test_alphabet_annotations(spark, tmp_path):
    path = put(tmp_path, "fg.tab", "fg_1\tACGU\ta\tb\tc\td\te\tEEEE\n")
    assert R.read_alphabet_annotations(spark, path).collect()[0]["struct_7"] == "EEEE"
