"""Score a folder (or topic) of change messages until stopped.

python -m payguard.jobs.stream_score CHANGES OUT_DIR [--models MODEL_STORE] [--tables ROOT] [--history TRANSACTIONS]

CHANGES is a folder, or servers/topic after kafka:. ROOT holds versions of
transactions and indicators, into which scores are written back. TRANSACTIONS
is a table of what came before the stream, whose last day seeds the velocities.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from payguard.sources.changes import ChangeSource
from payguard.sources.tables import read_table
from payguard.streaming.score import Sinks, start_scoring


def source_of(text: str) -> ChangeSource:
    if text.startswith("kafka:"):
        servers, _, topic = text.removeprefix("kafka:").rpartition("/")
        return ChangeSource(topic=topic, servers=servers)
    return ChangeSource(path=text)


def start(spark: SparkSession, changes: str, out: str, models: str | None = None, tables: str | None = None, history: str | None = None, trigger: dict | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """The scoring and the dead-letter query."""
    sinks = Sinks(f"{out}/events", f"{out}/alerts", f"{out}/dead-letters", tables, f"{out}/progress")
    before = read_table(spark, "transactions", history) if history else None
    return start_scoring(spark, source_of(changes), sinks, f"{out}/checkpoint", history=before, model_store=models, trigger=trigger)


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    for name in ("changes", "out", "--models", "--tables", "--history"):
        parser.add_argument(name)
    session = SparkSession.builder.appName("stream_score").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for query in start(session, **vars(parser.parse_args()), trigger={"processingTime": "5 seconds"}):
        query.awaitTermination()
