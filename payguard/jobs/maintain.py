"""Begin to maintain the aggregates of a versioned root's transactions.

python -m payguard.jobs.maintain ROOT; apply_changes and stream_score --tables ROOT correct them from then on.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from payguard.operators import preagg
from payguard.sources.snapshots import Snapshots

if __name__ == "__main__":
    session = SparkSession.builder.appName("maintain").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(preagg.maintain(Snapshots(session, sys.argv[1])))
