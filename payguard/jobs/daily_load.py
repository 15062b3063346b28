"""Load one day of transactions into the star and refresh the pre-aggregates.

OLTP_DIR holds the operational tables as folders or as a versioned root. The
aggregates that a versioned root maintains are not computed again.

python -m payguard.jobs.daily_load OLTP_DIR WAREHOUSE_DIR [YYYY-MM-DD]; the day is yesterday by default.
"""

from __future__ import annotations

import datetime as dt
import sys

from pyspark.sql import SparkSession

from payguard.operators import preagg, star
from payguard.sources.snapshots import Snapshots
from payguard.sources.tables import read_table


def load(spark: SparkSession, oltp: str, warehouse: str, day: str, dry_run: bool = False) -> dict[str, int]:
    """Rows added by table."""
    transactions, methods, merchants = (read_table(spark, n, f"{oltp}/{n}") for n in ("transactions", "payment_methods", "merchants"))
    added = star.load_day(spark, star.daily_extract(transactions, methods, merchants, day), warehouse, dry_run)
    if not dry_run:
        root = Snapshots(spark, oltp)
        kept = {n: root.current(n).drop(preagg.CELL) for n in preagg.MAINTAINED if n in root.names()}
        sums = kept.get("merchant_sums", preagg.merchant_sums(transactions))
        preagg.refresh(Snapshots(spark, f"{warehouse}/preagg"), {"daily_revenue": kept.get("daily_revenue", preagg.daily_revenue(transactions)), "merchant_stats": preagg.with_merchants(merchants, sums)})
    return added


if __name__ == "__main__":
    session = SparkSession.builder.appName("daily_load").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    chosen = sys.argv[3] if len(sys.argv) > 3 else str(dt.datetime.now(dt.timezone.utc).date() - dt.timedelta(days=1))
    print(load(session, sys.argv[1], sys.argv[2], chosen))
