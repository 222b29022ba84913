"""Files written from the driver tables to the shared folder, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ribospan import surrogates as X
from ribospan.session import new_path
from ribospan.sources import readers as R
from ribospan.sources import writers as WR
from ribospan.sources.record_files import RecordFiles
from ribospan.workload.inputs_sql import PREDICTIONS, PROFILES, SCORES, WINDOWS
from ribospan.workload.motifs import LANGUAGE, REGION_MOTIFS, _instances
from ribospan.workload.registry import query, with_ctes
from ribospan.workload.source_texts import TRIPLET_SQL, _triplets

#: Tasks that write one dataset.
SHARES = 16


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _named_parts(spark, folder: str, name) -> str:
    """Rename the part files below ``folder``: ``name(parent folder, number)``; returns the folder."""
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = path_class(folder)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = system.listFiles(top, True), []
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith("part-"):
            found.append(path)
    for k, path in enumerate(sorted(found, key=str)):
        system.rename(path, path_class(top, name(path.getParent().getName(), k)))
    return folder


def _record_files(spark, kind: str, path: str, columns: str, **options):
    spark.dataSource.register(RecordFiles)
    return spark.read.format("record_files").schema(columns).options(kind=kind, splitBytes=1 << 16, **options).load(path)


@query(with_ctes(WINDOWS, body=TRIPLET_SQL.replace("label,", "NULL::INTEGER AS label,")))
def record_files_triplets(spark, sf_dir):
    """Up to ``SHARES`` files a dataset, however large it is, each read by several tasks."""
    path = new_path(spark, "files")
    rows = _triplets(spark, sf_dir).select(
        F.regexp_replace("file_name", r"_(pos|neg)\.fa$", "").alias("dataset_id"), F.concat(F.lit(">"), "value").alias("value")
    )
    rows.repartition("dataset_id", F.pmod(F.xxhash64("value"), F.lit(SHARES))).write.partitionBy("dataset_id").text(path)
    read = _record_files(spark, "triplet", path, "dataset_id string, rec_id string, seq string, track array<double>, label int")
    total = F.aggregate("track", F.lit(0.0), lambda a, x: a + x).alias("track_total")
    return read.select("dataset_id", "rec_id", "seq", "label", total)


@query(with_ctes(PROFILES, body="""
SELECT grp::VARCHAR AS dataset_id, t.name AS structure_type, count(*) AS n, sum(list_sum([floor(x * 1000.0::DOUBLE) * t.i for x in scores])) AS total
FROM profiles, (VALUES (1, 'paired'), (2, 'hairpin'), (3, 'inner'), (4, 'multi'), (5, 'external')) AS t(i, name) GROUP BY ALL
"""))
def record_files_profiles(spark, sf_dir):
    path = new_path(spark, "files")
    row = lambda i: F.array_join(F.transform("scores", lambda x: (F.floor(x * 1000.0) * i).cast("string")), "\t")
    value = F.concat_ws("\n", F.concat(F.lit(">v"), _s("rec_id")), *[row(i) for i in range(1, 6)])
    rows = X.profile_rows(spark, sf_dir).select(_s("grp").alias("dataset_id"), value.alias("value"))
    rows.repartition("dataset_id").write.partitionBy("dataset_id").text(path)
    read = _record_files(spark, "profile", path, "dataset_id string, structure_type string, profile array<double>", length=64)
    total = F.aggregate("profile", F.lit(0.0), lambda a, x: a + x)
    return read.groupBy("dataset_id", "structure_type").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"))


@query(with_ctes(WINDOWS, body="SELECT label, count(*) AS n, sum(length(seq))::BIGINT AS n_bases, count(DISTINCT rec_id) AS n_records FROM windows GROUP BY label"))
def source_labeled_pair(spark, sf_dir):
    """A folder of ``_pos.fa`` and ``_neg.fa`` files; other files in it are not read."""
    folder = new_path(spark, "files")
    rows = _triplets(spark, sf_dir).select(
        F.regexp_extract("file_name", r"_(pos|neg)\.fa$", 1).alias("kind"), F.concat(F.lit(">"), "value").alias("value")
    )
    rows.write.partitionBy("kind").text(folder)
    _named_parts(spark, folder, lambda parent, k: f"set{k}_{parent.split('=')[1]}.fa")
    X.table(spark, sf_dir, "region").select(F.lit("no record").alias("value")).write.text(f"{folder}/notes")
    read = R.read_labeled_pair(spark, folder)
    return read.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("n_bases"), F.count_distinct(F.substr("rec_id", F.lit(4)).cast("bigint")).alias("n_records")
    )


@query(with_ctes(WINDOWS, body="""
SELECT 'loc' || rec_id AS loc, seq, (rec_id % 100) / 100.0::DOUBLE AS score, CASE WHEN rec_id % 7 <> 0 THEN label END AS label FROM windows
"""))
def source_site_tsv(spark, sf_dir):
    """Every window is followed by a repeated header in one of five cases; some labels are no numbers."""
    label = F.when(F.col("rec_id") % 7 == 0, "none").otherwise(_s("label"))
    line = F.concat_ws("\t", F.lit("site"), F.concat(F.lit("loc"), _s("rec_id")), "seq", F.lit("..."), _s((F.col("rec_id") % 100) / 100.0), label)
    header = F.lit("Type\tloc\tSeq\tStr\tScore\tlabel")
    lines = F.when(F.col("rec_id") % 5 == 0, F.concat_ws("\n", line, header)).otherwise(line)
    folder = new_path(spark, "files")
    X.windows(spark, sf_dir).select(lines.alias("value")).write.text(folder)
    return R.read_site_tsv(spark, folder).select("loc", "seq", "score", "label")


@query(with_ctes(SCORES, body="""
SELECT 'R' || rbp || '_' || cell AS key, floor(maf * 1000.0::DOUBLE) AS first, CASE WHEN line_no % 4 <> 0 THEN line_no::DOUBLE END AS second FROM scores
"""))
def source_metric_table(spark, sf_dir):
    """Lines with tabs and lines with spaces, some values no numbers, a header."""
    key = F.concat(F.lit("R"), _s("rbp"), F.lit("_"), "cell")
    second = F.when(F.col("line_no") % 4 == 0, "n/a").otherwise(_s("line_no"))
    cells = [key, _s(F.floor(F.col("maf") * 1000.0)), second]
    value = F.when(F.col("line_no") % 2 == 0, F.concat_ws("\t", *cells)).otherwise(F.concat_ws("  ", *cells))
    rows = X.score_rows(spark, sf_dir).select(value.alias("value"))
    folder = new_path(spark, "files")
    rows.unionByName(X.table(spark, sf_dir, "region").select(F.lit("RBP_Cell\tfirst\tsecond").alias("value"))).write.text(folder)
    return R.read_metric_table(spark, folder, ["first", "second"])


def _two_headers(spark, folder: str, df, names: list[str], sep: str, **options) -> str:
    """``df`` in two halves by ``_half``; the second one's files have their columns the other way round."""
    for half, order in ((0, names), (1, names[::-1])):
        part = df.where(F.col("_half") == half).select(*order)
        part.write.options(header=True, sep=sep, **options).csv(f"{folder}/half{half}")
    return f"{folder}/half*"


@query("""
SELECT o_custkey::VARCHAR AS rsid, (o_orderkey % 1000) / 1000.0::DOUBLE AS p_value, count(*) AS n
FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY ALL
""")
def source_summary_stats(spark, sf_dir):
    """Files with two orders of columns, decimals with a comma in one of three, some p-values missing."""
    p = F.format_string("%.3f", (F.col("o_orderkey") % 1000) / F.lit(1000.0))
    p = F.when(F.col("o_orderkey") % 11 == 0, "NA").when(F.col("o_orderkey") % 3 == 0, F.replace(p, F.lit("."), F.lit(","))).otherwise(p)
    rows = X.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("variant_id"), p.alias("p_value"), F.lit("x").alias("other"), (F.col("o_orderkey") % 2).alias("_half")
    )
    path = _two_headers(spark, new_path(spark, "files"), rows, ["variant_id", "p_value", "other"], "\t")
    read = R.read_summary_stats(spark, path, {"variant_id": "rsid", "p_value": "p_value"})
    return read.groupBy("rsid", "p_value").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT split_part(o_orderpriority, '-', 1) AS tissue, count(*) AS n, sum(o_custkey)::BIGINT AS total, sum((o_orderkey % 1000) / 8.0::DOUBLE) AS p_total
FROM orders GROUP BY ALL
""")
def source_eqtl_gzip(spark, sf_dir):
    """Gzip files, a tissue each, in two orders of columns."""
    folder = new_path(spark, "files")
    rows = X.table(spark, sf_dir, "orders").select(
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("tissue"), F.col("o_custkey").alias("rs_id"),
        ((F.col("o_orderkey") % 1000) / F.lit(8.0)).alias("pval"), (F.col("o_orderkey") % 2).alias("_half"),
    )
    for half, order in ((0, ["rs_id", "pval"]), (1, ["pval", "rs_id"])):
        part = rows.where(F.col("_half") == half).select("tissue", *order)
        part.write.partitionBy("tissue").options(header=True, sep="\t", compression="gzip").csv(f"{folder}/half{half}")
        _named_parts(spark, f"{folder}/half{half}", lambda parent, k: f"{parent.split('=')[1]}.{k}.txt.gz")
    read = R.read_eqtl(spark, f"{folder}/half*/*.gz", {"rs_id": "rsid", "pval": "pval_nominal"})
    return read.groupBy("tissue").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rsid").cast("bigint")).alias("total"), F.sum("pval_nominal").alias("p_total")
    )


@query("""
SELECT (s_nationkey || ':' || p_size || ':' || 'A>G') AS variant, r.rbp, r.disease, count(*) AS n
FROM (SELECT p_size, p_partkey % 25 AS s_nationkey, p_brand, p_type FROM part) p,
  (VALUES ('first'), ('second')) AS x(which),
  LATERAL (SELECT CASE which WHEN 'first' THEN replace(p_brand, '#', '') ELSE 'RBP2' END AS rbp, unnest(string_split(p_type, ' ')) AS disease) r
GROUP BY ALL
""")
def source_variant_catalog(spark, sf_dir):
    """Catalog files with quoted lists, in two orders of columns, exploded to (variant, rbp, disease)."""
    rows = X.table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 25).alias("CHROM"), F.col("p_size").alias("POS"), F.lit("A").alias("REF"), F.lit("G").alias("ALT"),
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_K562,RBP2_H9")).alias("RBP_list"),
        F.replace("p_type", F.lit(" "), F.lit("|")).alias("ClinVar_CLNDN"), (F.col("p_partkey") % 2).alias("_half"),
    )
    names = ["CHROM", "POS", "REF", "ALT", "RBP_list", "ClinVar_CLNDN"]
    path = _two_headers(spark, new_path(spark, "files"), rows, names, ",", quoteAll=True)
    found = R.explode_catalog(R.read_variant_catalog(spark, path))
    return found.groupBy("variant", "rbp", "disease").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH lines AS (SELECT source, doc_id, doc_id || ' ' || md5(text) AS line FROM documents),
files AS (SELECT source, sha256(string_agg(line, chr(10) ORDER BY doc_id) || chr(10)) AS actual, row_number() OVER (ORDER BY source) AS k FROM lines GROUP BY source)
SELECT source || '.txt' AS name, actual, CASE WHEN k % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM files
UNION ALL SELECT 'none.txt', NULL, 'missing'
""")
def checksum_audit(spark, sf_dir):
    """A file for each source, read in pieces; the manifest has every third digest wrong and one file too many."""
    folder, manifest = new_path(spark, "files"), new_path(spark, "manifest")
    lines = X.table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(_s("doc_id"), F.lit(" "), F.md5("text")).alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(folder)
    _named_parts(spark, folder, lambda parent, k: f"{parent.split('=')[1]}.txt")
    listed = spark.read.format("binaryFile").load(f"{folder}/*.txt").select("path")
    digests = R.file_digests(listed).select(F.element_at(F.split("path", "/"), -1).alias("name"), "actual")
    place = digests.select("name").distinct().collect()  # a name a source
    wrong = [r["name"] for r in sorted(place)][2::3]
    expected = F.when(F.col("name").isin(wrong), F.reverse("actual")).otherwise(F.upper("actual"))
    rows = digests.select(F.concat_ws("  ", expected, "name").alias("value"))
    more = X.table(spark, sf_dir, "region").select(F.lit("00  none.txt").alias("value")).distinct()
    rows.unionByName(more).write.text(manifest)
    return R.checksum_audit(spark, manifest, f"{folder}/*.txt").select("name", "actual", "status")


@query(with_ctes(WINDOWS, LANGUAGE, REGION_MOTIFS, body="""
SELECT dataset_id, motif, count(*) AS n, sum(s)::BIGINT AS starts FROM instances GROUP BY ALL
"""))
def sink_motif_instances(spark, sf_dir):
    """Instances in folders by dataset and motif, read back with the folders' names."""
    path = new_path(spark, "instances")
    WR.write_motif_instances(_instances(spark, sf_dir).select("dataset_id", "motif", "rec_id", "start", "end"), path)
    read = spark.read.schema("rec_id bigint, start int, end int, dataset_id string, motif string").parquet(path)
    return read.groupBy("dataset_id", "motif").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


@query(with_ctes(PREDICTIONS, body="""
SELECT dataset_id AS data_file, batch::INTEGER AS best_epoch, round(avg(prob), 6) AS best_val_acc, 42 AS seed FROM predictions GROUP BY ALL
"""))
def sink_metrics_json(spark, sf_dir):
    """Metric rows as JSON, read back as best metrics."""
    path = new_path(spark, "metrics")
    rows = X.prediction_rows(spark, sf_dir).groupBy(F.col("dataset_id").alias("data_file"), F.col("batch").cast("int").alias("best_epoch")).agg(
        F.round(F.avg("prob"), 6).alias("best_val_acc")
    )
    WR.write_metrics(rows.withColumn("seed", F.lit(42)), path)
    return R.read_best_metrics(spark, path, whole_files=False).select("data_file", "best_epoch", "best_val_acc", "seed")


@query(with_ctes(SCORES, body="""
SELECT cell || chr(9) || CASE WHEN line_no % 6 < 2 THEN '' ELSE printf('%.4f', floor(maf * 1000.0::DOUBLE) / 8.0::DOUBLE) END AS line, count(*) AS n
FROM scores GROUP BY ALL
"""))
def sink_differences(spark, sf_dir):
    """Two-column text with blanks for infinite values and those that are no numbers."""
    path = new_path(spark, "differences")
    odd = F.when(F.col("line_no") % 6 == 0, float("inf")).when(F.col("line_no") % 6 == 1, float("nan"))
    value = F.coalesce(odd, F.floor(F.col("maf") * 1000.0) / F.lit(8.0))
    WR.write_differences(X.score_rows(spark, sf_dir).select(F.col("cell").alias("class"), value.alias("value")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(PROFILES, body="""
SELECT grp::VARCHAR AS dataset_id, 'v' || rec_id AS motif, sum(floor(scores[1 + t.j * 5 + k] * 100.0::DOUBLE)) AS total,
       CASE WHEN t.j < 4 THEN 'seq' ELSE 'struct' END AS part, count(*) AS n
FROM profiles, (SELECT unnest(range(0, 11)) AS j) t, (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL
"""))
def source_seq_struct_pwm(spark, sf_dir):
    """Blocks of a name and eleven rows, separated by blank lines."""
    folder = new_path(spark, "files")
    row = lambda j: F.array_join(F.transform(F.slice("scores", 1 + 5 * j, 5), lambda x: F.floor(x * 100.0).cast("string")), " ")
    value = F.concat(F.concat_ws("\n", F.concat(F.lit("v"), _s("rec_id")), *[row(j) for j in range(11)]), F.lit("\n"))
    X.profile_rows(spark, sf_dir).select(_s("grp").alias("grp"), value.alias("value")).write.partitionBy("grp").text(folder)
    _named_parts(spark, folder, lambda parent, k: f"{parent.split('=')[1]}.{k}")
    read = R.read_seq_struct_pwm(spark, folder)
    return read.groupBy("dataset_id", "motif", "part").agg(F.sum("p").alias("total"), F.count(F.lit(1)).alias("n"))


@query(with_ctes(PROFILES, body="""
SELECT 'v' || rec_id AS motif, 'ACGU'[j + 1] AS symbol, sum(floor(scores[1 + j * 16 + k] * 100.0::DOUBLE) * (k + 1)) AS weighted, count(*) AS n
FROM profiles, (SELECT unnest(range(0, 4)) AS j), (SELECT unnest(range(0, 16)) AS k) GROUP BY ALL
"""))
def source_pfm(spark, sf_dir):
    """Tab matrices, a file each, from the texts and names of files."""
    row = lambda j, a: F.concat_ws("\t", F.lit(a), F.transform(F.slice("scores", 1 + 16 * j, 16), lambda x: F.floor(x * 100.0).cast("string")))
    rows = X.profile_rows(spark, sf_dir).select(
        F.concat(F.lit("v"), _s("rec_id"), F.lit(".txt")).alias("file_name"), F.explode(F.array(*[row(j, a) for j, a in enumerate("ACGU")])).alias("value")
    )
    read = R.parse_pfm(rows)
    return read.groupBy("motif", "symbol").agg(F.sum(F.col("p") * (F.col("pos") + 1)).alias("weighted"), F.count(F.lit(1)).alias("n"))
