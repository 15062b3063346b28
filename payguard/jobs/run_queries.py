"""Run named queries and report rows, seconds and failures; exit status 1 if any failed.

python -m payguard.jobs.run_queries SF_DIR [NAME ...]
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from payguard.plans import registry


def run_queries(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """One row for each query: name, rows, seconds, error. A failure does not stop the others."""
    found = []
    for name in names or sorted(registry.QUERIES):
        began, rows, error = time.perf_counter(), None, None
        try:
            rows = registry.QUERIES[name](spark, sf_dir).count()
        except Exception as e:  # reported, and the exit status tells
            error = f"{type(e).__name__}: {e}"[:500]
        found.append((name, rows, time.perf_counter() - began, error))
    return spark.createDataFrame(found, "name string, rows bigint, seconds double, error string")


if __name__ == "__main__":
    session = SparkSession.builder.appName("run_queries").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    report = run_queries(session, sys.argv[1], sys.argv[2:]).collect()
    for r in report:
        print(f"{r.name}: {r.error or f'{r.rows} rows, {r.seconds:.1f} s'}")
    sys.exit(int(any(r.error for r in report)))
