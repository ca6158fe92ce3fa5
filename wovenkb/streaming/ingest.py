"""Incremental ingest as a stream (an addition to what the batch side has)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import ingest as plan
from ..sources.readers import Catalog


def ingest_stream(catalog: Catalog, documents: DataFrame, checkpoint: str, **options: object) -> StreamingQuery:
    """Publish a version for each micro-batch of loaded documents (title, content, file_type, source_path, error).

    A batch that is delivered again changes nothing, because a live source with the same title and checksum is left out.
    """
    def publish(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            plan.ingest(catalog, batch, **options)

    return documents.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_rows(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], into: str, checkpoint: str) -> StreamingQuery:
    """Append what a transformation makes of new parquet files of a folder to a table."""
    return transform(spark.readStream.schema(schema).parquet(folder)).writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by type in windows of event time; rows later than the watermark are left out on streams."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
