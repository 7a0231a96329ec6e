"""Extensions for unbounded feeds: micro-batch ingest and windowed counts with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revlens.engine import ReviewEngine
from revlens.sources import ingest


def ingest_stream(engine: ReviewEngine, source: DataFrame, checkpoint: str, to_canonical: Callable[[DataFrame], DataFrame] = ingest.from_frame) -> StreamingQuery:
    """Runs the batch plan on every micro-batch."""

    def on_batch(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            engine.ingest(to_canonical(df), "stream", f"epoch-{epoch}")

    return source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feature_counts(events: DataFrame, time: str = "ts", by: str = "feature", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and key; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
