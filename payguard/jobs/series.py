"""Keep the minute and hour series of scored events, and a table of late ones, until stopped.

python -m payguard.jobs.series EVENTS OUT_DIR; EVENTS is the table of batches that stream_score writes its events to.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from payguard.sources.snapshots import Snapshots
from payguard.streaming.fanout import start_series


def start(spark: SparkSession, events: str, out: str, delay_seconds: int = 600, trigger: dict | None = None) -> StreamingQuery:
    return start_series(spark, events, Snapshots(spark, f"{out}/series"), f"{out}/late_events", f"{out}/_checkpoints/series", delay_seconds, trigger)


if __name__ == "__main__":
    session = SparkSession.builder.appName("series").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    start(session, sys.argv[1], sys.argv[2], trigger={"processingTime": "10 seconds"}).awaitTermination()
