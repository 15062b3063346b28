"""Apply the retention rules to a versioned root of document tables.

python -m payguard.jobs.retain ROOT YYYY-MM-DD [GRACE_SECONDS]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from payguard.operators.governance import RETENTION, retained
from payguard.sources.snapshots import Snapshots


def retain(spark: SparkSession, root: str, day: str, grace: float = 0) -> list[str]:
    """Tables to which a rule was applied; all change in one version. Tables without a rule stay as they are. Versions with the expired rows are removed once they are older than `grace` seconds."""
    store, as_of = Snapshots(spark, root), F.lit(day).cast("timestamp")
    found: list[str] = []

    def step(base: int) -> int:
        there = store.names(base)
        kept = {name: retained(store.current(name, base), as_of, column, days) for name, column, days in RETENTION if name in there}
        found[:] = sorted(kept)
        return store.commit(kept, base)

    store.retry(step)
    store.vacuum(grace)
    return found


if __name__ == "__main__":
    session = SparkSession.builder.appName("retain").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(retain(session, *sys.argv[1:3], *map(float, sys.argv[3:4])))
