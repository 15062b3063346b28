"""From scored events to document tables, and to incremental aggregates.

The scoring stream leaves a table of batches; the streams here read its log,
so each of its batches is taken once and whole, and what they write carries
that batch's number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payguard.operators import documents, preagg
from payguard.operators.star import dim_geography
from payguard.operators.writeback import KEYS, tidy
from payguard.sources.snapshots import Snapshots, batch_log, put_batch, read_batch


@dataclass(frozen=True)
class Tables:
    """Tables of batches transaction_logs, logs and fraud_alerts, and the versioned root of ml_features and online_features."""

    transaction_logs: str
    logs: str
    fraud_alerts: str
    features: str


def for_each_batch(spark: SparkSession, events: str, name: str, one: Callable[[DataFrame, int, str], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream that calls one(rows, batch, writer) for each batch of a table of batches, in order. A transaction that a batch has twice comes once."""

    def process(log: DataFrame, _: int) -> None:
        for r in sorted(log.collect(), key=lambda r: r["batch"]):
            one(read_batch(spark, events, r["batch"]).dropDuplicates(["txn_id"]), r["batch"], r["writer"])

    return batch_log(spark, events).writeStream.queryName(name).foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_tables(store: Snapshots, batch: DataFrame, number: int) -> None:
    """ml_features and online_features after a batch of scored events: only its customers' rows change, and records that have expired go. A batch that is not after the last one changes nothing."""

    def step(base: int) -> int | None:
        last = store.mark("fan-out", base)
        now = batch.agg(F.max("created_at")).first()[0]
        if now is None or last is not None and last >= number:
            return None
        keys, marks = {n: KEYS[n] for n in ("ml_features", "online_features")}, {"fan-out": number}
        if "ml_features" not in store.names(base):
            return store.commit({"ml_features": documents.upsert_features(None, batch), "online_features": documents.upsert_online(None, batch, F.lit(now))}, base, keys=keys, marks=marks)
        known = batch.filter("customer_id IS NOT NULL")
        online = store.current("online_features", base)
        mine = online.join(known.select("customer_id").distinct(), "customer_id", "left_semi")
        new = documents.upsert_online(mine, batch, F.lit(now))
        gone = online.filter(F.col("expires_at") <= F.lit(now)).join(new.select("customer_id"), "customer_id", "left_anti").withColumn("_deleted", F.lit(True))
        changes = {"ml_features": documents.upsert_features(store.rows_of("ml_features", known, base), batch), "online_features": new.withColumn("_deleted", F.lit(False)).unionByName(gone)}
        return store.commit(changes=changes, base=base, marks=marks)

    store.retry(step)
    tidy(store)


def start_fanout(spark: SparkSession, events: str, tables: Tables, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each batch of scored events into five tables; a repeated batch, here or of the scoring stream, changes nothing."""

    def one(batch: DataFrame, number: int, writer: str) -> None:
        put_batch(documents.to_transaction_logs(batch), tables.transaction_logs, number, writer)
        put_batch(documents.to_logs(batch), tables.logs, number, writer)
        put_batch(documents.to_alerts(batch), tables.fraud_alerts, number, writer)
        upsert_tables(Snapshots(spark, tables.features), batch, number)

    return for_each_batch(spark, events, "fan-out", one, checkpoint, trigger)


#: Stored series of counts and their widths.
SERIES = {"minute_series": "1 minute", "hour_series": "1 hour"}


def add_to_series(store: Snapshots, late_rows: str, batch: DataFrame, number: int, writer: str, delay_seconds: int) -> None:
    """The minute and hour series after a batch of scored events: its counts are added to the windows that it touches, however old.

    Rows more than the delay older than the latest one of the batches before
    are late: they count all the same, and are kept in the table of batches
    late_rows; the mark `late` counts them. A batch that is not after the last
    one changes nothing.
    """
    def step(base: int) -> int | None:
        last, high = store.mark("series", base), store.mark("series-high", base)
        if last is not None and last >= number:
            return None
        late = batch.filter(F.unix_micros("created_at") < F.lit(high - delay_seconds * 1_000_000)) if high is not None else batch.limit(0)
        put_batch(late, late_rows, number, writer)
        n = read_batch(store.spark, late_rows, number).count()
        newest = batch.agg(F.max(F.unix_micros("created_at"))).first()[0]
        marks = {"series": number, "late": (store.mark("late", base) or 0) + n}
        if newest is not None:
            marks["series-high"] = newest if high is None else max(high, newest)
        counts = {name: windowed_counts(batch, width) for name, width in SERIES.items()}
        if "minute_series" not in store.names(base):
            return store.commit(counts, base, keys=dict.fromkeys(SERIES, "window_start"), marks=marks)
        changes = {}
        for name, new in counts.items():
            both = store.rows_of(name, new, base).unionByName(new)
            changes[name] = both.groupBy("window_start").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("count", "fraud_count", "volume_cents")))
        return store.commit(changes=changes, base=base, marks=marks)

    store.retry(step)
    tidy(store)


def start_series(spark: SparkSession, events: str, store: Snapshots, late_rows: str, checkpoint: str, delay_seconds: int = 600, trigger: dict | None = None) -> StreamingQuery:
    """Keep the minute and hour series of scored events; see add_to_series()."""

    def one(batch: DataFrame, number: int, writer: str) -> None:
        add_to_series(store, late_rows, batch, number, writer, delay_seconds)

    return for_each_batch(spark, events, "series", one, checkpoint, trigger)


def start_star_revenue(spark: SparkSession, star: Snapshots, store: Snapshots, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the star's revenue by day, region and currency as fresh as the trigger's interval: the facts of each new version of the star are added to the stored sums.

    The stream reads the star's versions. The last one whose facts were added
    is committed with the sums, so a repeated batch changes nothing.
    """

    def process(_: DataFrame, __: int) -> None:
        def step(base: int) -> int | None:
            last, seen = star.version(), store.mark("star-version", base) or 0
            facts = star.loads_since("fact_transactions", seen, last)
            if facts is None:
                return None
            new = preagg.star_revenue(facts, dim_geography(spark))
            old = store.current("star_revenue", base)
            both = new if old is None else old.unionByName(new)
            sums = both.groupBy("full_date", "region", "currency").agg(F.sum("txn_count").alias("txn_count"), F.sum("revenue_eur").cast("decimal(28,2)").alias("revenue_eur"), F.sum("fraud_count").alias("fraud_count"))
            return store.commit({"star_revenue": sums}, base, marks={"star-version": last})

        store.retry(step)

    versions = spark.readStream.schema("at bigint").option("pathGlobFilter", "*.json").json(f"{star.root}/_versions")
    return versions.writeStream.queryName("star-revenue").foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def intake_once(rows: DataFrame, key: str = "txn_id", delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark: replayed messages are dropped."""
    return rows.withWatermark("created_at", delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, width: str, delay: str = "10 minutes", fraud_at: float = 0.85) -> DataFrame:
    """Tumbling counts by event time: window_start, count, fraud_count, volume_cents. The same on a stream or a table."""
    if rows.isStreaming:
        rows = rows.withWatermark("created_at", delay)
    out = rows.groupBy(F.window("created_at", width)).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("fraud_score") >= fraud_at).alias("fraud_count"), F.sum("amount").alias("volume_cents"))
    return out.select(F.col("window.start").alias("window_start"), "count", "fraud_count", "volume_cents")


def daily_revenue(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The daily pre-aggregate by currency as a stream: day, currency, txn_count, gross_amount_cents of successful rows."""
    if rows.isStreaming:
        rows = rows.withWatermark("created_at", delay)
    out = rows.filter("status = 'succeeded'").groupBy(F.window("created_at", "1 day"), "currency").agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("gross_amount_cents"))
    return out.select(F.to_date("window.start").alias("day"), "currency", "txn_count", "gross_amount_cents")
