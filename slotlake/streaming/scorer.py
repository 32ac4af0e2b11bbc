"""Scoring of arriving bookings: stateless, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start_scoring(stream: DataFrame, score: Callable[[DataFrame], DataFrame], output: str,
                  checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write scored micro-batches to ``output``; with ``once`` stop after what has arrived.

    The file sink records finished batches, so a restarted query neither loses nor repeats rows.
    """
    writer = (
        score(stream).writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
