"""Events that arrive as a stream: appended once each, and rolled up by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import EventLog


def ingest(events: DataFrame, log: EventLog, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the log. Each batch drops what the log has, so a batch that is run again after a
    failure adds nothing twice."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: log.append(df)).start()


def activity(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by type and window of time, each snapshot_hash once within the watermark."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["snapshot_hash"]).groupBy(F.window("timestamp", window).alias("period"), "event_type").agg(F.count("*").alias("n"))
