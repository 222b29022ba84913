"""Sinks. All writes are partitioned files; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gwas_line() -> Column:
    return F.concat(
        F.regexp_replace("header", "^>+", ""), F.lit("\tPrediction_score:"), F.format_string("%.6f", "score")
    )


def catalog_line(mode: str) -> Column:
    return F.concat(
        F.col("header"), F.lit("\tmodel_id="), F.col("model_id"), F.lit(f"\tmode={mode}\tPrediction_score:"),
        F.format_string("%.6f", "score"),
    )


def ribosnitch_line() -> Column:
    return F.concat_ws(
        "\t", F.regexp_replace("header", "^>+", ""), F.col("model_id"), F.col("score").cast("string")
    )


def append_scores(df: DataFrame, path: str, line: Column | None = None) -> None:
    """Append scores as parquet, or as text lines when a line format is given."""
    if line is None:
        df.write.mode("append").parquet(path)
    else:
        df.select(line.alias("value")).write.mode("append").text(path)


def write_motif_instances(df: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Instances under ``dataset_id=/motif=`` folders.

    Rows are spread by (dataset, motif) and a share of the motif's rows of about
    ``file_rows``: a rare motif is one file, a popular one is written by as many tasks as it
    has shares.
    """
    keys = ["dataset_id", "motif"]
    shares = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("_shares"))
    shared = df.join(shares, keys).withColumn("_share", F.pmod(F.xxhash64("rec_id", "start"), F.col("_shares")))
    shared.repartition(*keys, "_share").drop("_shares", "_share").write.mode("overwrite").partitionBy(
        "dataset_id", "motif"
    ).parquet(path)


def meme_text(pwm: DataFrame, by: list[str], alphabet: str = "ACGU") -> DataFrame:
    """One MEME version 5 text per motif: uniform background, 14 decimals."""
    share = 1 / len(alphabet)
    row = F.concat_ws(" ", *[
        F.format_string("%.14f", F.coalesce(F.col(f"`{a}`"), F.lit(0.0))) for a in alphabet
    ])
    lines = (
        pwm.groupBy(*by, "pos").pivot("symbol", list(alphabet)).agg(F.first("p"))
        .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("t")))).alias("rows"))
    )
    background = " ".join(f"{a} {share:.2f}" for a in alphabet)
    head = F.concat(
        F.lit(f"MEME version 5\nALPHABET= {alphabet}\nBackground letter frequencies: {background}\nMOTIF "),
        F.col(by[-1]),
        F.lit(f"\nletter-probability matrix: alength= {len(alphabet)} w= "),
        F.size("rows").cast("string"),
    )
    return lines.select(
        *by, F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n")).alias("value")
    )


def write_meme(pwm: DataFrame, by: list[str], path: str) -> None:
    texts = meme_text(pwm, by)
    texts.write.mode("overwrite").partitionBy(*by).text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_differences(df: DataFrame, path: str) -> None:
    """Long two-column difference text: class, value with four decimals; infinities and NaN stay blank."""
    v = F.col("value")
    infinite = F.abs(v) == F.lit(float("inf"))
    text = F.when(v.isNull() | F.isnan(v) | infinite, "").otherwise(F.format_string("%.4f", v))
    df.select(F.concat_ws("\t", F.col("class"), text).alias("value")).write.mode("overwrite").text(path)
