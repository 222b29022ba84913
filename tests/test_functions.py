import math

import pytest
from pyspark.sql import functions as F

from ribospan.functions import headers as H
from ribospan.functions import scores as SC
from ribospan.functions import sequence as S

GWAS = (
    ">variant_1 chr1:27891903-27892003(-)[3_prime_UTR_variant]{NA} 27891953:T>A "
    "ENSG00000117748[0.002]{rs6666467}"
)


def test_kmers(one):
    assert one(S.kmers(F.lit("ACGUA"), 3)) == ["ACG", "CGU", "GUA"]
    assert one(S.kmers(F.lit("AC"), 3)) == []
    assert one(S.kmers_text(F.lit("ACGU"), 2)) == "AC CG GU"
    assert one(S.kmers_to_seq(S.kmers(F.lit("ACGUA"), 3))) == "ACGUA"


def test_kmers_to_seq_rejects_ragged_parts(one):
    with pytest.raises(Exception, match="rebuild"):
        one(S.kmers_to_seq(F.array(F.lit("ACG"), F.lit("C"))))


def test_kmer_order_has_first_character_fastest(one):
    vocab = S.vocabulary_kmers(2)
    assert vocab[:5] == ["AA", "CA", "GA", "UA", "AC"]
    for i in (0, 7, 15):
        assert one(S.kmer_index(F.lit(vocab[i]), 2)) == i


def test_complement_twice_is_identity(one):
    for b in "ACGTN":
        assert one(S.complement(S.complement(F.lit(b)))) == b
    assert one(S.complement(F.lit("U"))) == "U"
    assert one(S.complement(F.lit("AC"))) == "AC"


def test_substitute_and_flanks(one):
    assert one(S.substitute_base(F.lit("ACGT"), F.lit(0), F.lit("T"))) == "TCGT"
    assert one(S.substitute_base(F.lit("ACGT"), F.lit(3), F.lit("A"))) == "ACGA"
    assert one(S.trim_flanks(S.add_flanks(F.lit("ACG"), "GG", "UUU"), 2, 3)) == "ACG"
    assert one(S.normalize_rna(F.lit("ATNG"))) == "AUAG"


def test_one_hot_padding_is_centred(one):
    assert one(S.one_hot(F.lit("TAU"), "T", 6)) == [0, 1, 0, 1, 0, 0]
    assert one(S.weighted_one_hot(F.lit("AC"), F.array(F.lit(0.5), F.lit(2.0)), "C")) == [0.0, 2.0]


def test_tokens(one):
    t = one(S.tokenize_ids(S.kmers(F.lit("ACGTX"), 1), 9))
    assert t["input_ids"] == [2, 6, 7, 8, 9, 1, 3, 0, 0]
    assert t["attention_mask"] == [1] * 7 + [0, 0]
    cut = one(S.tokenize_ids(S.kmers(F.lit("ACGTA"), 1), 4))
    assert cut["input_ids"] == [2, 6, 7, 3]


def test_alphabets(one):
    enc = {k: one(c) for k, c in S.reduce_alphabet(F.lit("ACGU"), F.lit("EHLR")).items()}
    assert enc["seq_struct_28"] == "BJRa"
    assert enc["struct_4"] == "ULPP" and enc["struct_2"] == "UUPP"
    assert enc["seq_struct_8"] == "ACFH"


def test_text_helpers(one):
    assert one(S.matrix_to_string(F.array(F.lit(0.12345), F.lit(1.0)))) == "0.123,1.000"
    assert one(S.parse_track(F.lit("0.5, 1,2"))) == [0.5, 1.0, 2.0]
    assert sum(one(S.softmax(F.array(F.lit(1.0), F.lit(2.0))))) == pytest.approx(1.0)
    assert one(S.int_encode(F.lit("ACGTN"))) == [0, 1, 2, 3, 999]


def test_strict_header(one):
    p = one(H.parse_header_strict(F.lit(GWAS)))
    assert p.asDict() == {
        "var_pos": 27891953, "ref": "T", "alt": "A", "strand": "-", "seq_start": 27891903,
    }
    assert one(H.parse_header_strict(F.lit(">a b"))) is None


def test_flexible_header_finds_tokens_anywhere(one):
    p = one(H.parse_header_flexible(F.lit(">v 12:c>T chr2:10-20(+)[x] K562 HepG2")))
    assert (p["var_pos"], p["ref"], p["alt"], p["seq_start"]) == (12, "c", "T", 10)
    assert one(H.parse_header_flexible(F.lit(">v 12:C>U chr2:10-20(+) K562"))) is None
    pair = one(H.cell_pair(F.lit(">v x K562 HepG2")))
    assert (pair["cell1"], pair["cell2"]) == ("K562", "HepG2")


@pytest.mark.parametrize(
    "header, protein, cell",
    [
        ("chr1:1-9(+) 5:A>G SRSF1 in K562", "SRSF1", "K562"),
        ("chr1:1-9(+) 5:A>G SRSF1 K562", "5:A>G", "K562"),
        ("chr1:1-9(+) 5:A>G in in X", "in", "X"),
        ("chr1:1-9(+) 5:A>G P in", "P", "in"),
    ],
)
def test_catalog_header(one, header, protein, cell):
    p = one(H.parse_header_catalog(F.lit(header)))
    assert (p["chrom"], p["seq_start"], p["seq_end"]) == ("chr1", 1, 9)
    assert (p["protein"], p["cell_line"]) == (protein, cell)


def test_catalog_header_needs_both_tokens(one):
    assert one(H.parse_header_catalog(F.lit("chr1:1-9(+) SRSF1 in K562"))) is None
    assert one(H.parse_header_catalog(F.lit("1:1-9(+) 5:A>G X in K562"))) is None


def test_score_line(one):
    line = GWAS[1:] + "\tPrediction_score: -0.25"
    p = one(H.parse_score_line(F.lit(line)))
    assert (p["rsid"], p["maf"], p["score"], p["chr"]) == ("rs6666467", 0.002, -0.25, "chr1")
    assert one(H.parse_score_line(F.lit("junk"), strict=False)) is None
    with pytest.raises(Exception, match="does not match"):
        one(H.parse_score_line(F.lit("junk")))


def test_dataset_name_splits_at_first_underscore(one):
    d = one(H.split_dataset(F.lit("AUH_HepG2_x")))
    assert (d["rbp"], d["cell"]) == ("AUH", "HepG2_x")


def test_transfer_name(one):
    assert one(SC.transfer_model_name(F.lit("X_K562"))) == "X_HepG2"
    assert one(SC.transfer_model_name(F.lit("K562_K562"))) == "HepG2_HepG2"
    assert one(SC.transfer_model_name(F.lit("X_HepG2"))) == "X_K562"
    assert one(SC.transfer_model_name(F.lit("X_IMR90"))) is None


def test_score_rules(one):
    assert one(SC.ld_bin(F.lit(0.2))) == "0.2"
    assert one(SC.ld_bin(F.lit(0.0))) is None
    assert one(SC.ld_bin(F.lit(1.0))) == "1"
    assert one(SC.clinical_class(F.lit("Pathogenic,Likely_benign"))) == "Benign"
    assert one(SC.significance_stars(F.lit(0.01))) == "*"
    assert one(SC.dynamic_score(F.lit(2), F.lit(3))) == pytest.approx(math.log1p(2 + 0.5 * 7))
    assert one(SC.neg_log10_p(F.lit(None).cast("double"), missing_as_one=True)) == 0
    assert one(SC.pair_difference(F.lit(0.0), F.lit(1.0))["relative_diff"]) is None
    assert one(SC.pair_difference(F.lit(-2.0), F.lit(1.0))["relative_diff"]) == -1.5
    assert one(SC.comma_decimal(F.lit("0,05"))) == 0.05
    assert one(SC.volcano_class(F.lit(0.01), F.lit(-2.0))) == "Down-regulated"
    assert one(SC.maf_bucket(F.lit(0.01))) == "0.001-0.05"


def test_dynamic_score_of_large_counts(one):
    big = 4_000_000_000
    got = one(SC.dynamic_score("d", "c"), d=big, c=big)
    assert got == pytest.approx(math.log1p(big + 0.5 * (float(big) * big + 1)))
