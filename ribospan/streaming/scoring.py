"""Streaming use of the stateless stages: FASTA-like rows in, scores out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ribospan.plans import variant_scoring as P


def read_record_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Parquet folder of (dataset_id, header, seq) rows as a stream."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def score_stream(
    records: DataFrame, models: DataFrame, out: str, checkpoint: str, mode: str = "after",
    scorer: P.Scorer | None = None,
) -> StreamingQuery:
    """Append scores of a record stream; the plan is the batch plan, with a static model table."""
    scored = P.score_gwas(records, models, mode, scorer)
    return (
        scored.select("dataset_id", "header", "model_id", "score")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def keyed_sink(out: str):
    """A ``foreachBatch`` function that writes each batch to its own folder below ``out``.

    The folder is named by the batch id and overwritten, so a batch that is repeated after a failure
    adds nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def score_stream_once(
    records: DataFrame, models: DataFrame, out: str, checkpoint: str, mode: str = "after",
    scorer: P.Scorer | None = None,
) -> StreamingQuery:
    """Score all files that are there, batch after batch, into a sink keyed by batch, and stop."""
    scored = P.score_gwas(records, models, mode, scorer).select("dataset_id", "header", "model_id", "score")
    return (
        scored.writeStream.foreachBatch(keyed_sink(out))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """What the batches of :func:`score_stream_once` wrote, with their ``batch``."""
    return spark.read.parquet(out)
