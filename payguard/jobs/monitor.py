"""One monitoring cycle, appended to the monitoring table.

python -m payguard.jobs.monitor TRANSACTIONS TRANSACTION_LOGS MODEL_STORE MONITORING
"""

from __future__ import annotations

import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from payguard.ml import store
from payguard.ml.monitor import monitor_once
from payguard.sources.snapshots import exists
from payguard.sources.tables import read_table


def cycle(spark: SparkSession, transactions: str, logs: str, root: str, table: str, as_of: datetime) -> None:
    """The time of the last retraining comes from the table itself."""
    last = spark.read.parquet(table).filter("retrain_triggered").agg(F.max("checked_at")).first()[0] if exists(spark, table) else None
    found = store.current(root)
    record = monitor_once(spark, read_table(spark, "transactions", transactions), spark.read.parquet(logs), root, as_of, found[1]["version"] if found else None, last)
    record.write.mode("append").parquet(table)


if __name__ == "__main__":
    session = SparkSession.builder.appName("monitor").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cycle(session, *sys.argv[1:5], datetime.now(timezone.utc).replace(tzinfo=None))
