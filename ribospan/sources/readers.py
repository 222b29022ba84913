"""Text sources. Every reader is one scan over a path, folder or glob, for all datasets at once.

Multi-line records are split by the text source itself (``lineSep``), so large files
stay splittable; dataset, label and cell come from the file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospan.functions import headers as H
from ribospan.functions import scores as SC
from ribospan.functions import sequence as S
from ribospan.functions.constants import CANCER_TO_TISSUE
from ribospan.functions.core import string_map
from ribospan.session import materialize
from ribospan.sources.record_files import file_system

FASTA_BREAK = "\n>"


def _file_stem(suffix: str) -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), suffix, "")


def _text(spark: SparkSession, path: str, **options) -> DataFrame:
    """``file_name, value``: what the ``parse_*`` functions take."""
    raw = spark.read.text(path, **options)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), "value")


def _fasta_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per record."""
    return _text(spark, path, lineSep=FASTA_BREAK)


def _with_lines(rows: DataFrame) -> DataFrame:
    """Records with their non-blank, trimmed lines; line 1 is the header."""
    lines = F.filter(
        F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""
    )
    return rows.select("file_name", "value", lines.alias("lines")).where(F.size("lines") > 0)


def _stem(suffix: str) -> Column:
    return F.regexp_replace("file_name", suffix, "")


def _checked(ok: Column, message: Column) -> Column:
    """A filter that fails the job on a row that is not ``ok``, whichever columns are read."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def read_triplet_fasta(
    spark: SparkSession, path: str, label: int | None = None, strict: bool = True
) -> DataFrame:
    """Three-line records: header, sequence, comma-joined track.

    Strict reading fails on a malformed record; otherwise it is kept with a
    ``bad_reason``. Without ``label`` the file name must end in ``_pos.fa`` or ``_neg.fa``.
    """
    return parse_triplet_fasta(_fasta_text(spark, path), label, strict)


def parse_triplet_fasta(rows: DataFrame, label: int | None = None, strict: bool = True) -> DataFrame:
    """:func:`read_triplet_fasta` on record texts."""
    r = _with_lines(rows)
    header = F.regexp_replace(F.element_at("lines", 1), "^>", "")
    seq = F.try_element_at("lines", F.lit(2))
    track_text = F.try_element_at("lines", F.lit(3))
    # Only the first record of a file keeps its '>'; a file that starts without one
    # cannot be told apart by later records, so the check is on the record's shape.
    reason = (
        F.when(F.size("lines") != 3, "line count is not three")
        .when(~seq.rlike("^[ACGTUN]+$"), "invalid sequence")
        .when(F.length(seq) != F.size(F.split(track_text, ",")), "length mismatch")
    )
    by_name = (
        F.when(F.col("file_name").rlike(r"_pos\.fa$"), 1).when(F.col("file_name").rlike(r"_neg\.fa$"), 0)
    )
    out = r.select(
        F.regexp_replace("file_name", r"(_pos|_neg)?\.(fa|fasta)$", "").alias("dataset_id"),
        header.alias("rec_id"),
        seq.alias("seq"),
        F.when(reason.isNull(), F.transform(F.split(track_text, ","), lambda x: F.trim(x).try_cast("double"))).alias("track"),
        (F.lit(label) if label is not None else by_name).cast("int").alias("label"),
        reason.alias("bad_reason"),
    )
    if not strict:
        return out
    message = F.concat(F.col("dataset_id"), F.lit(": "), F.col("bad_reason"), F.lit(" at "), F.col("rec_id"))
    return out.where(_checked(F.col("bad_reason").isNull(), message)).drop("bad_reason")


def read_labeled_pair(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """All ``<stem>_pos.fa`` and ``<stem>_neg.fa`` of a folder with their labels."""
    return read_triplet_fasta(spark, f"{folder}/*_{{pos,neg}}.fa", strict=strict)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Wrapped FASTA: ``dataset_id``, ``header`` (with its '>'), joined upper-case ``seq``."""
    return parse_fasta(_fasta_text(spark, path))


def parse_fasta(rows: DataFrame) -> DataFrame:
    return _with_lines(rows).select(
        F.regexp_replace("file_name", r"\.(fa|fasta)$", "").alias("dataset_id"),
        F.concat(F.lit(">"), F.regexp_replace(F.element_at("lines", 1), "^>", "")).alias("header"),
        F.upper(F.array_join(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), "")).alias("seq"),
    )


def read_kmer_tsv(
    spark: SparkSession, path: str, lenient: bool = False, max_len: int | None = None
) -> DataFrame:
    """``kmers<TAB>label`` with rebuilt sequences.

    The plain form skips the header line. The lenient one keeps any row whose label is
    an integer or missing (then 0) and takes the raw text, upper-cased and cut.
    """
    if lenient:
        return parse_lenient_kmers(_text(spark, path), max_len)
    rows = spark.read.csv(path, sep="\t", header=True, schema="kmers string, label int")
    return rows.select("kmers", S.kmers_to_seq(F.split("kmers", " ")).alias("seq"), "label")


def parse_lenient_kmers(rows: DataFrame, max_len: int | None = None) -> DataFrame:
    parts = rows.where(F.trim("value") != "").select(F.split("value", "\t").alias("p"))
    label = F.try_element_at("p", F.lit(2))
    text = F.upper(F.element_at("p", 1))
    return parts.where(label.isNull() | label.rlike(r"^-*\d+$")).select(
        (F.substr(text, F.lit(1), F.lit(max_len)) if max_len else text).alias("seq"),
        F.coalesce(label.try_cast("int"), F.lit(0)).alias("label"),
    )


def read_site_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless site table; repeated header rows are removed."""
    return parse_site_rows(_text(spark, path))


def parse_site_rows(rows: DataFrame) -> DataFrame:
    names = ["type", "loc", "seq", "str", "score", "label"]
    cells = rows.where(F.trim("value") != "").select(F.split("value", "\t", -1).alias("c"))
    sites = cells.select(*[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return sites.where(F.col("type") != "Type").withColumn("score", F.col("score").try_cast("double")).withColumn(
        "label", F.col("label").try_cast("int")
    )


# Order of the profile rows in a structure block.
STRUCTURE_ROWS = ["paired", "hairpin", "inner", "multi", "external"]


def read_structure_profiles(
    spark: SparkSession, path: str, length: int | None = 101
) -> DataFrame:
    """Blocks of a header and five numeric rows, long: ``(dataset_id, rec_id, structure_type, profile)``.

    With ``length`` every row must have exactly that many values.
    """
    return parse_structure_profiles(_fasta_text(spark, path), length)


def parse_structure_profiles(rows: DataFrame, length: int | None = 101) -> DataFrame:
    r = _with_lines(rows)
    names = F.array(*[F.lit(n) for n in STRUCTURE_ROWS])
    rows = r.select(
        F.regexp_replace("file_name", r"\.[^.]+$", "").alias("dataset_id"),
        F.regexp_replace(F.element_at("lines", 1), "^>", "").alias("rec_id"),
        F.when(F.size("lines") == 6, F.slice("lines", 2, 5))
        .otherwise(F.raise_error(F.lit("structure block does not have five rows")))
        .alias("rows"),
    )
    long = rows.select("dataset_id", "rec_id", F.posexplode("rows").alias("i", "text"))
    profile = F.transform(F.split("text", r"\s+"), lambda x: x.cast("double"))
    if length is not None:
        message = F.lit(f"structure row does not have {length} values")
        long = long.where(_checked(F.size(F.split("text", r"\s+")) == length, message))
    return long.select(
        "dataset_id", "rec_id", F.element_at(names, F.col("i") + 1).alias("structure_type"),
        profile.alias("profile"),
    )


def _matrix_rows(rows: Column) -> Column:
    return F.transform(
        rows, lambda line: F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double"))
    )


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """MEME text motifs as ``(dataset_id, motif, pos, symbol, p)``."""
    return parse_meme(_text(spark, path, lineSep="MOTIF "))


def parse_meme(rows: DataFrame) -> DataFrame:
    """:func:`read_meme` on texts that each begin after the word MOTIF."""
    motifs = rows.where(F.contains("value", F.lit("letter-probability matrix")))
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = motifs.select(
        F.regexp_replace("file_name", r"\.meme$", "").alias("dataset_id"),
        F.element_at(F.split(F.element_at(lines, 1), r"\s+"), 1).alias("motif"),
        F.filter(lines, lambda x: x.rlike(r"^[-+0-9.eE]+(\s+[-+0-9.eE]+)+$")).alias("rows"),
        F.regexp_extract("value", r"w=\s*(\d+)", 1).try_cast("int").alias("w"),
    )
    return _long_pwm(
        parsed.select("dataset_id", "motif", F.slice(_matrix_rows(F.col("rows")), F.lit(1), F.col("w")).alias("m")),
        S.RNA,
    )


def _long_pwm(df: DataFrame, alphabet: str) -> DataFrame:
    """Rows = positions, columns = symbols."""
    cells = df.select("dataset_id", "motif", F.posexplode("m").alias("pos", "row"))
    return cells.select(
        "dataset_id", "motif", "pos", F.posexplode("row").alias("j", "p")
    ).select(
        "dataset_id", "motif", "pos",
        F.substr(F.lit(alphabet), F.col("j") + 1, F.lit(1)).alias("symbol"), "p",
    )


def read_seq_struct_pwm(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a name and 11 rows (4 bases, 7 states) separated by a blank line, long."""
    return parse_seq_struct_pwm(_text(spark, path, lineSep="\n\n"))


def parse_seq_struct_pwm(rows: DataFrame) -> DataFrame:
    """:func:`read_seq_struct_pwm` on texts of one block each; what is no block drops out."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    blocks = rows.select(_stem(r"\.[^.]+$").alias("dataset_id"), lines.alias("l")).where(F.size("l") == 12)
    symbols = S.RNA + S.PWM_STATE_ORDER
    cells = blocks.select(
        "dataset_id", F.element_at("l", 1).alias("motif"),
        F.posexplode(_matrix_rows(F.slice("l", 2, 11))).alias("j", "row"),
    )
    return cells.select(
        "dataset_id", "motif", F.posexplode("row").alias("pos", "p"),
        F.when(F.col("j") < 4, "seq").otherwise("struct").alias("part"),
        F.substr(F.lit(symbols), F.col("j") + 1, F.lit(1)).alias("symbol"),
    )


def read_pfm(spark: SparkSession, path: str) -> DataFrame:
    """Tab PFM files, one motif per file: rows are ``symbol<TAB>p...``."""
    return parse_pfm(_text(spark, path))


def parse_pfm(rows: DataFrame) -> DataFrame:
    cells = rows.where(F.trim("value") != "").select(_stem(r"\.[^.]+$").alias("motif"), F.split("value", "\t").alias("c"))
    return cells.select(
        "motif", F.element_at("c", 1).alias("symbol"),
        F.posexplode(F.transform(F.slice("c", 2, F.size("c")), lambda x: x.cast("double"))).alias("pos", "p"),
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of ``<RBP>_<CELL>.bed`` files; more BED columns are ignored."""
    return parse_bed(_text(spark, path))


def parse_bed(rows: DataFrame) -> DataFrame:
    cells = F.split(F.trim("value"), "\t")
    named = rows.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(
        cells.alias("c"), H.split_dataset(_stem(r"\.bed$")).alias("d")
    )
    return named.select(
        "d.rbp", "d.cell", F.element_at("c", 1).alias("chrom"),
        F.element_at("c", 2).cast("bigint").alias("start"), F.element_at("c", 3).cast("bigint").alias("end"),
    )


def _by_header(spark: SparkSession, path: str, sep: str, columns: dict[str, str]) -> DataFrame:
    """``file_name`` and the text columns ``columns`` (name in the header to output name) of files with headers.

    Each file is read by its own header, so the order of columns may differ from file to file. The
    header is the first line that is not blank; a file without one of the columns is an error.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
    ).where(F.trim("value") != "")
    # Inside the first block of a file the ids grow with the lines; the table has a row a file.
    headers = materialize(lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")))
    widest = headers.agg(F.max(F.size(F.split("header", sep)))).first()[0] or 1
    kind = ", ".join(f"c{i} string" for i in range(widest))
    cells = lambda text: F.from_csv(text, F.lit(kind), {"sep": sep})
    listed = lambda row: F.array(*[row[f"c{i}"] for i in range(widest)])
    places = headers.select("file", "header", listed(cells(F.col("header"))).alias("names"))
    lacking = F.filter(F.array(*[F.lit(c) for c in columns]), lambda c: ~F.coalesce(F.array_contains("names", c), F.lit(False)))
    bad = places.select("file", lacking.alias("lacking")).where(F.size("lacking") > 0).head(3)
    if bad:
        raise ValueError("missing required columns: " + "; ".join(f"{sorted(r['lacking'])} in {r['file']}" for r in bad))
    rows = lines.join(places, "file").where(F.col("value") != F.col("header"))
    parsed = rows.select("file_name", "names", cells(F.col("value")).alias("row"))
    cell = lambda name: F.element_at(listed(F.col("row")), F.array_position("names", F.lit(name)).cast("int"))
    return parsed.select("file_name", *[cell(c).alias(n) for c, n in columns.items()])


def read_summary_stats(
    spark: SparkSession, path: str, columns: dict[str, str], p_value: str = "p_value"
) -> DataFrame:
    """TSV files with headers, each read by its own; ``columns`` maps required names to output names.

    Comma decimals are accepted in the p-value; rows without one are dropped.
    """
    out = _by_header(spark, path, "\t", columns).drop("file_name")
    return out.withColumn(p_value, SC.comma_decimal(p_value)).where(F.col(p_value).isNotNull())


def read_eqtl(spark: SparkSession, path: str, rename: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Gzip TSV of genes per tissue, each file by its own header; the tissue is the file name up to the first dot.

    A gzip file is one task, so rows are spread out right after the read.
    """
    raw = _by_header(spark, path, "\t", rename)
    out = raw.select(F.substring_index("file_name", ".", 1).alias("tissue"), *rename.values()).withColumn(
        "pval_nominal", F.col("pval_nominal").try_cast("double")
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n)


def read_metric_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab (else whitespace) table: first column is the key, the rest numeric; rows without key drop out."""
    return parse_metric_table(_text(spark, path), columns)


def parse_metric_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    parts = rows.where(F.trim("value") != "").select(
        F.when(F.contains("value", F.lit("\t")), F.split("value", "\t"))
        .otherwise(F.split(F.trim("value"), r"\s+"))
        .alias("c")
    )
    return (
        parts.select(
            F.trim(F.element_at("c", 1)).alias("key"),
            *[F.try_element_at("c", F.lit(i + 2)).alias(n) for i, n in enumerate(columns)],
        )
        .where((F.col("key") != "") & (F.col("key") != "RBP_Cell"))
        .withColumns({n: SC.coerce_numeric(n) for n in columns})
    )


def read_score_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Scored variant lines of ``<RBP>_<CELL>_{before,after}_mut.txt`` files."""
    return parse_score_lines(_text(spark, path), strict)


def parse_score_lines(rows: DataFrame, strict: bool = True) -> DataFrame:
    parsed = rows.where(F.trim("value") != "").select(
        H.split_dataset(_stem(r"_(before|after)_mut\.txt$")).alias("d"),
        F.regexp_extract("file_name", r"_(before|after)_mut\.txt$", 1).alias("mode"),
        H.parse_score_line("value", strict).alias("s"),
    ).where(F.col("s").isNotNull())
    return parsed.select("d.rbp", "d.cell", "mode", "s.*")


def read_ribosnitch_scores(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace lines: variant, chr_loc, variant_loc, cell1, cell2, rbp_cell, score.

    Text has no stable line order once it is split, so rules about the "first" line need
    an order written with the data: an eighth column, read as ``line_no``.
    """
    return parse_ribosnitch_scores(_text(spark, path))


def parse_ribosnitch_scores(rows: DataFrame) -> DataFrame:
    names = ["variant", "chr_loc", "variant_loc", "cell1", "cell2", "rbp_cell"]
    parts = rows.where(F.trim("value") != "").select(
        F.split(F.trim("value"), r"\s+").alias("c"), F.col("value").alias("line")
    )
    rbp_cell = F.element_at("c", 6)
    return parts.select(
        *[F.element_at("c", i + 1).alias(n) for i, n in enumerate(names)],
        F.element_at("c", 7).cast("double").alias("score"),
        F.element_at(F.split(rbp_cell, "_"), 1).alias("rbp"),
        F.try_element_at(F.split(rbp_cell, "_"), F.lit(2)).alias("cell"),
        F.try_element_at("c", F.lit(8)).try_cast("bigint").alias("line_no"),
        "line",
    )


EVAL_LINE = r"(?i)(\S+_\S+)\s+auc:\s*([-+0-9.eE]+)"


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """``<RBP>_<CELL> auc: x`` lines."""
    return parse_eval_log(_text(spark, path))


def parse_eval_log(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value").rlike(EVAL_LINE)).select(
        F.regexp_extract("value", EVAL_LINE, 1).alias("dataset_id"),
        F.regexp_extract("value", EVAL_LINE, 2).try_cast("double").alias("auc"),
    )


EPOCH_LINE = (
    r"^(\S+)\s+Test\s+Epoch:\s*(\d+)\s+avg\.loss:\s*([-+0-9.eE]+)\s+Acc:\s*([-+0-9.eE]+)%,"
    r"\s*AUC:\s*([-+0-9.eE]+)\s*\(([-+0-9.eE]+)\),\s*PRC:\s*([-+0-9.eE]+),\s*MCC:\s*([-+0-9.eE]+)"
)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Validation lines of training logs: run (file stem), dataset, epoch and metrics."""
    return parse_training_log(_text(spark, path))


def parse_training_log(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("value").rlike(EPOCH_LINE))
    group = lambda i: F.regexp_extract("value", EPOCH_LINE, i)
    return rows.select(
        _stem(r"\.log$").alias("run"), group(1).alias("dataset_id"),
        group(2).cast("int").alias("epoch"), group(3).cast("double").alias("loss"),
        group(4).cast("double").alias("acc"), group(5).cast("double").alias("auc"),
        group(7).cast("double").alias("prc"), group(8).cast("double").alias("mcc"),
    )


def read_best_metrics(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Best-metric JSON files: one object per file, or with ``whole_files`` off one per line."""
    schema = (
        "run_name string, data_file string, best_epoch int, best_val_auc double, "
        "best_val_acc double, best_val_prc double, best_val_mcc double, seed int, device string"
    )
    return spark.read.schema(schema).json(path, multiLine=whole_files)


def read_variant_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog CSV files with ``RBP_list`` and ``ClinVar_CLNDN``, each by its own header; adds the variant key."""
    columns = {"CHROM": "chrom", "POS": "pos", "REF": "ref", "ALT": "alt", "RBP_list": "rbp_list", "ClinVar_CLNDN": "diseases"}
    raw = _by_header(spark, path, ",", columns).drop("file_name")
    return raw.withColumn("variant", variant_key("chrom", "pos", "ref", "alt")).withColumn("pos", F.col("pos").cast("bigint"))


def read_cancer_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 13-column cancer CSV; adds the variant key and the ``tissue`` of the cancer, if it is known."""
    schema = (
        "chrom string, pos bigint, pos2 bigint, ref string, alt string, clin_sig string, "
        "strand string, cancer string, strand2 string, prefix string, "
        "wild_coverage double, mut_coverage double, gene string"
    )
    raw = spark.read.csv(path, schema=schema)
    return raw.where(F.trim("prefix") != "").withColumn(
        "variant", variant_key("chrom", "pos", "ref", "alt")
    ).withColumn("tissue", F.try_element_at(string_map(CANCER_TO_TISSUE), F.col("cancer")))


def variant_key(chrom: str, pos: str, ref: str, alt: str) -> Column:
    return F.concat(
        F.col(chrom), F.lit(":"), F.col(pos).cast("string"), F.lit(":"), F.col(ref), F.lit(">"), F.col(alt)
    )


def explode_catalog(df: DataFrame) -> DataFrame:
    """(variant, rbp, disease) rows of a catalog; RBP names lose their cell suffix."""
    rbps = F.filter(F.split("rbp_list", ","), lambda r: r != "")
    return df.select(
        "variant",
        F.explode(F.transform(rbps, lambda r: F.substring_index(r, "_", 1))).alias("rbp"),
        "diseases",
    ).select("variant", "rbp", F.explode(F.split("diseases", r"\|")).alias("disease"))


def read_position_rows(spark: SparkSession, path: str, motifs: list[str]) -> DataFrame:
    """Comma-separated distances, row i = motif i, as ``(dataset_id, motif, distance)``.

    A file is one record here: it has a handful of lines, and their order names the motif.
    """
    return parse_position_rows(_text(spark, path, wholetext=True), motifs)


def parse_position_rows(rows: DataFrame, motifs: list[str]) -> DataFrame:
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    staged = rows.select(
        _stem(r"_relative_positions\.txt$").alias("dataset_id"),
        lines.alias("l"),
    ).withColumn(
        "l",
        F.when(F.size("l") == len(motifs), F.col("l")).otherwise(
            F.raise_error(F.concat(F.lit("not a row for each motif in "), F.col("dataset_id")))
        ),
    )
    names = F.array(*[F.lit(m) for m in motifs])
    rows = staged.select("dataset_id", F.posexplode("l").alias("i", "text"))
    return rows.select(
        "dataset_id", F.element_at(names, F.col("i") + 1).alias("motif"),
        F.explode(F.split("text", ",")).alias("d"),
    ).select("dataset_id", "motif", F.trim("d").try_cast("double").alias("distance")).where(
        F.col("distance").isNotNull()
    )


def read_alphabet_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Tab table of a record id and its seven encodings."""
    schema = (
        "rec_id string, seq_4 string, seq_struct_8 string, seq_struct_16 string, "
        "seq_struct_28 string, struct_2 string, struct_4 string, struct_7 string"
    )
    return spark.read.csv(path, sep="\t", schema=schema)


def read_category_lists(spark: SparkSession, path: str) -> DataFrame:
    """``<category>rbp_list.txt`` files, one name per line."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        _file_stem(r"rbp_list\.txt$").alias("category"), F.trim("value").alias("rbp")
    )


def file_digests(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``path, actual``: sha256 of each file of ``files(path)``, read in the tasks piece by piece.

    A file of any size needs one piece of memory. What can't be opened fails the job.
    """
    import hashlib

    def run(found):
        import pyarrow as pa

        for batch in found:
            paths, digests = batch.column(0).to_pylist(), []
            for path in paths:
                system, inner = file_system(path)
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(chunk):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(digests, pa.string())], names=["path", "actual"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, actual string")


def checksum_audit(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """sha256 of each file against a ``<digest>  <name>`` manifest: ok, mismatch or missing."""
    wanted = spark.read.text(manifest).where(F.trim("value") != "").select(
        F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("expected"),
        F.element_at(F.split(F.trim("value"), r"\s+"), 2).alias("name"),
    )
    # The listing alone: the content column is not read.
    listed = spark.read.format("binaryFile").load(folder).select("path")
    found = file_digests(listed).select(F.element_at(F.split("path", "/"), -1).alias("name"), "actual")
    return wanted.join(found, "name", "left").select(
        "name", "expected", "actual",
        F.when(F.col("actual").isNull(), "missing")
        .when(F.lower("expected") == F.col("actual"), "ok")
        .otherwise("mismatch")
        .alias("status"),
    )
