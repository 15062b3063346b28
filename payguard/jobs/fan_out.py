"""Write scored events into the document tables until stopped.

python -m payguard.jobs.fan_out EVENTS OUT_DIR; EVENTS is the table of batches that stream_score writes its events to.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from payguard.streaming.fanout import Tables, start_fanout


def start(spark: SparkSession, events: str, out: str, trigger: dict | None = None) -> StreamingQuery:
    tables = Tables(f"{out}/transaction_logs", f"{out}/logs", f"{out}/fraud_alerts", f"{out}/features")
    return start_fanout(spark, events, tables, f"{out}/_checkpoints/fan-out", trigger)


if __name__ == "__main__":
    session = SparkSession.builder.appName("fan_out").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    start(session, sys.argv[1], sys.argv[2], {"processingTime": "10 seconds"}).awaitTermination()
