"""Keep a stored copy of the transactions from their change messages until stopped.

python -m payguard.jobs.apply_changes CHANGES ROOT; CHANGES as in stream_score.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from payguard.jobs.stream_score import source_of
from payguard.sources.snapshots import Snapshots
from payguard.streaming.apply import start_apply


def start(spark: SparkSession, changes: str, root: str, trigger: dict | None = None) -> StreamingQuery:
    return start_apply(spark, source_of(changes), Snapshots(spark, root), f"{root}/_checkpoints/apply", trigger=trigger)


if __name__ == "__main__":
    session = SparkSession.builder.appName("apply_changes").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    start(session, sys.argv[1], sys.argv[2], {"processingTime": "10 seconds"}).awaitTermination()
