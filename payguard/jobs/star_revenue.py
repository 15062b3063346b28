"""Keep the star's daily revenue by region and currency at most an hour behind its facts, until stopped.

python -m payguard.jobs.star_revenue WAREHOUSE_DIR
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from payguard.sources.snapshots import Snapshots
from payguard.streaming.fanout import start_star_revenue

#: How far the stored result may lie behind.
LAG = "1 hour"


def start(spark: SparkSession, warehouse: str, trigger: dict | None = None) -> StreamingQuery:
    """The warehouse must have had a first load."""
    return start_star_revenue(spark, Snapshots(spark, f"{warehouse}/star"), Snapshots(spark, f"{warehouse}/preagg"), f"{warehouse}/_checkpoints/star-revenue", trigger)


if __name__ == "__main__":
    session = SparkSession.builder.appName("star_revenue").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    start(session, sys.argv[1], {"processingTime": LAG}).awaitTermination()
