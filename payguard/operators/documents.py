"""Scored transactions as documents: logs, operational logs, alerts and the latest features of each customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.functions import rules

PAYLOAD = ("txn_id", "merchant_id", "customer_id", "pm_id", "amount", "currency", "status", "device_type", "ip_country", "metadata", "fraud_score", "decision", "velocity_1h", "velocity_24h", "rules_triggered", "model_version")
ALERT = ("txn_id", "customer_id", "merchant_id", "amount", "currency", "ip_country", "device_type", "fraud_score", "decision", "rules_triggered", "model_version", "velocity_1h", "velocity_24h", "created_at")
SERVICE = "document-writer"


def to_transaction_logs(scored: DataFrame) -> DataFrame:
    """One log document for each scored transaction; created_at is the transaction's, so replays give equal rows."""
    return scored.select("txn_id", F.lit("transaction.scored").alias("event_type"), F.struct(*PAYLOAD).alias("payload"), F.lit(SERVICE).alias("source"), "created_at")


def duration_ms(score: Column) -> Column:
    """The stand-in latency 5 + 10 * score, one digit, exact halves to even."""
    return F.bround((F.lit(5) + F.coalesce(score, F.lit(0.0)).cast("decimal(9,4)") * 10), 1).cast("double")


def to_logs(scored: DataFrame) -> DataFrame:
    """One access log for each scored transaction; rows without a decision are logged as errors."""
    failed = F.col("decision").isNull()
    context = F.struct("txn_id", "decision", F.when(~failed, duration_ms(F.col("fraud_score"))).alias("duration_ms"))
    message = F.when(failed, F.lit("transaction.unscored")).otherwise(F.concat(F.lit("transaction.scored txn_id="), F.col("txn_id")))
    return scored.select(F.lit(SERVICE).alias("service"), F.when(failed, "error").otherwise("access").alias("type"), F.when(failed, "ERROR").otherwise("INFO").alias("level"), message.alias("message"), context.alias("context"), "created_at", (F.col("created_at") + F.expr("INTERVAL 90 DAYS")).alias("ttl_expires_at"))


def to_alerts(scored: DataFrame) -> DataFrame:
    """The 14 fields of rows to review or block."""
    return rules.alerts(scored).select(*ALERT)


def latest_features(scored: DataFrame) -> DataFrame:
    """The latest values of each customer, by (created_at, txn_id). A partial aggregate: no customer's rows are gathered."""
    fields = {"amount": "last_amount", "currency": "last_currency", "ip_country": "last_country", "device_type": "last_device_type", "velocity_1h": "velocity_1h", "velocity_24h": "velocity_24h", "fraud_score": "last_fraud_score", "decision": "last_decision", "model_version": "last_model_version", "created_at": "last_updated"}
    row = F.struct("created_at", "txn_id", F.struct(*(F.col(k).alias(v) for k, v in fields.items())).alias("values"))
    known = scored.filter("customer_id IS NOT NULL")
    return known.groupBy("customer_id").agg(F.max(row).alias("row")).select("customer_id", "row.values.*", F.col("row.txn_id").alias("last_txn_id"))


def upsert_features(previous: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The feature table after a batch of scored rows: of both, the newer values of each customer."""
    new = latest_features(batch)
    if previous is None:
        return new
    both = previous.unionByName(new)
    row = F.struct("last_updated", "last_txn_id", F.struct(*new.columns[1:]).alias("values"))
    return both.groupBy("customer_id").agg(F.max(row).alias("row")).select("customer_id", "row.values.*")


def online_features(scored: DataFrame, seconds: int = 3600) -> DataFrame:
    """The short-lived feature record of each customer, with the instant that it expires at."""
    rows = latest_features(scored)
    return rows.select("customer_id", "last_amount", "last_country", "velocity_1h", "velocity_24h", (F.col("last_updated") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("expires_at"))


def upsert_online(previous: DataFrame | None, batch: DataFrame, as_of: Column, seconds: int = 3600) -> DataFrame:
    """The online feature table after a batch of scored rows: of both, the record of each customer that expires last, unless it has expired at `as_of`."""
    new = online_features(batch, seconds)
    if previous is not None:
        row = F.struct("expires_at", *(c for c in new.columns if c not in ("customer_id", "expires_at")))
        # Of two records of one instant the batch's counts, as it is the later write.
        both = previous.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        new = both.groupBy("customer_id").agg(F.max(F.struct("expires_at", "_new", row.alias("row"))).alias("m")).select("customer_id", "m.row.*").select(*new.columns)
    return new.filter(F.col("expires_at") > as_of)
