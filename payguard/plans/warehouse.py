"""The stored star of a folder of test tables, which the star-schema queries read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.operators import preagg, star
from payguard.operators.running import scratch, shared_dir
from payguard.sources.snapshots import Snapshots, _path
from payguard.sources.tables import Tables

#: Test tables that each star is made from.
SOURCES = {"orders": ("orders", "customer", "supplier"), "events": ("events", "customer", "supplier")}


def _state(spark: SparkSession, path: str) -> list[str]:
    """Names, sizes and times of the files under a path."""
    fs, p = _path(spark, path)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        s = found.next()
        out.append(f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}")
    return sorted(out)


def stored_star(spark: SparkSession, sf_dir: str, kind: str) -> Snapshots:
    """The star over `orders` or `events`, loaded by star.load() when it is first asked for, with its star_revenue.

    It lies in the shared folder under a name made from the state of the test
    tables' files, so other queries and later runs read it as long as they
    stay the same. Facts are partitioned by month.
    """
    state = [x for name in SOURCES[kind] for x in _state(spark, f"{sf_dir}/{name}.parquet")]
    name = hashlib.sha256("\n".join([kind, *state]).encode()).hexdigest()[:32]
    store = Snapshots(spark, f"{shared_dir(spark)}/payguard-stars/{name}")
    if "star_revenue" not in store.names():
        t = Tables(spark, sf_dir)
        rows = t.orders.withColumn("fraud_score", F.lit(None).cast("double")) if kind == "orders" else t.decided
        with scratch(spark):
            star.load(store, star.daily_extract(rows, t.payment_methods, t.merchants), "month_key")
            store.commit({"star_revenue": preagg.star_revenue(store.current(star.FACTS), star.dim_geography(spark))})
    return store


def facts(store: Snapshots) -> DataFrame:
    return store.current(star.FACTS)
