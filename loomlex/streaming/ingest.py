"""Streams: texts into term counts, the activity log in windows.

Our own addition: the batch operators above are the parity surface.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlex.operators import analytics, index


def activity_windows(events: DataFrame, ts: str = "ts", late: str = "30 minutes", width: str = "15 minutes") -> DataFrame:
    """Events by window and kind; rows later than ``late`` are left out (AGG26's shape on a stream)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id").alias("users"))


def sessions(events: DataFrame, ts: str = "ts", gap: str = "20 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "user_id").agg(F.count(F.lit(1)).alias("events"))


def ingest_texts(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Term counts of every arriving text, appended by batch; a batch that runs again replaces its own files."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        analytics.counted(index.sentences(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
