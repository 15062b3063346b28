"""Erase customers: the ids of a table (customer_id) from a versioned root of customers, payment_methods and transactions.

python -m payguard.jobs.erase ROOT IDS [--dry-run] [--grace SECONDS]

Exit status 1 if an id is unknown, and then nothing is written. Versions from
before the erasure still hold the persons; they are removed once they are older
than the grace, by default at once, else by the next vacuum.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from payguard.operators.governance import anonymize
from payguard.operators.writeback import rekeyed
from payguard.sources.snapshots import Snapshots

NAMES = ("customers", "payment_methods", "transactions")


def erase(spark: SparkSession, root: str, ids: DataFrame, dry_run: bool = False, grace: float = 0) -> tuple[DataFrame, DataFrame]:
    """Counts by id and unknown ids. The tables change in one version, unless an id is unknown or it is a dry run.

    Only rows of the persons are written; then the buckets that hold their old
    rows are, and versions and folders older than `grace` seconds are removed.
    A reader of such a version fails with a missing file.
    """
    store = Snapshots(spark, root)
    base = store.version()
    done = anonymize(*(store.current(n, base) for n in NAMES), ids)
    if not dry_run and done["unknown"].isEmpty():
        rekeyed(store, *NAMES)

        def step(base: int) -> int:
            asked = ids.select("customer_id").distinct()
            mine = {n: store.current(n, base).join(asked, "customer_id", "left_semi") for n in NAMES}
            changed = anonymize(*mine.values(), ids)
            return store.commit(changes={n: changed[n] for n in NAMES}, base=base)

        # Counts are of what was, so they are taken before the old rows go.
        counts = [tuple(r) for r in done["counts"].collect()]
        store.retry(step)
        for name in NAMES:
            store.retry(lambda base, name=name: store.compact(name))
        store.vacuum(grace)
        return spark.createDataFrame(counts, done["counts"].schema), spark.createDataFrame([], done["unknown"].schema)
    return done["counts"], done["unknown"]


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("root")
    parser.add_argument("ids")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--grace", type=float, default=0)
    a = parser.parse_args()
    session = SparkSession.builder.appName("erase").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found, unknown = erase(session, a.root, session.read.parquet(a.ids), a.dry_run, a.grace)
    found.show()
    sys.exit(int(not unknown.isEmpty()))
