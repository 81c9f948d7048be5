"""Sequence files as a stream: new FASTA or GenBank files are parsed, and each micro-batch is annotated or ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import parse_text


def stream_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs of files as they arrive in folder; stateless."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).load(folder)
    return parse_text(files.select("value", F.col("_metadata.file_name").alias("name")), name="name")


def run(contigs: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """plan over each micro-batch, appended to Parquet; contigs are independent, so no state is kept."""

    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("append").parquet(out)

    return contigs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
