"""Dashboard queries: counters, series, rankings, latest rows, score histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.columns import cents, ratio, ratio_half_even
from payguard.operators import documents
from payguard.plans import oracle as sql
from payguard.plans.oltp import stamp
from payguard.sources.tables import Tables

FRAUD, REVIEW = 0.85, 0.6


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    score = F.col("fraud_score")
    out = t.decided.withColumn("now", t.as_of(t.transactions)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("created_at") >= F.col("now") - F.expr("INTERVAL 1 HOUR")).alias("txns_1h"), F.coalesce(cents(F.sum(F.when(F.col("status") == "succeeded", F.col("amount")))), F.lit(0.0)).alias("revenue_eur"), F.count_if(score >= FRAUD).alias("fraud_count"), F.sum(F.round(score * 10000).cast("bigint")).alias("points"), F.count(score).alias("scored"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    guard = F.greatest(F.col("total"), F.lit(1))
    return out.select("total", "txns_1h", "revenue_eur", "fraud_count", ratio_half_even("fraud_count", guard, 2, 100).alias("fraud_rate"), F.coalesce(ratio("points", F.col("scored") * 10000, 4), F.lit(0.0)).alias("avg_score"), "succeeded", "failed")


KPIS = sql.with_tables("d", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE created_at >= (SELECT max(created_at) FROM d) - INTERVAL 1 HOUR) AS txns_1h, coalesce(sum(amount) FILTER (WHERE status = 'succeeded')::BIGINT / 100.0, 0) AS revenue_eur, count(*) FILTER (WHERE fraud_score >= 0.85) AS fraud_count,
  {sql.even("count(*) FILTER (WHERE fraud_score >= 0.85)", "greatest(count(*), 1)", 2, 100)} AS fraud_rate, coalesce({sql.ratio("sum(points)::BIGINT", "count(points) * 10000", 4)}, 0) AS avg_score, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed FROM d""")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.decided_since(t.before(t.transactions, "30 MINUTES"))
    return rows.groupBy(stamp(F.date_trunc("minute", "created_at")).alias("minute")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("fraud_score") >= FRAUD).alias("fraud_count"), cents(F.sum("amount")).alias("volume_eur")).orderBy("minute")


MINUTES = sql.with_tables("d", f"""
SELECT {sql.when("date_trunc('minute', created_at)")} AS minute, count(*) AS count, count(*) FILTER (WHERE fraud_score >= 0.85) AS fraud_count, sum(amount)::BIGINT / 100.0 AS volume_eur FROM d WHERE created_at >= (SELECT max(created_at) FROM d) - INTERVAL 30 MINUTE GROUP BY 1""")


def fraud_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).scored.filter((F.col("fraud_score") >= FRAUD) & F.col("ip_country").isNotNull())
    return rows.groupBy("ip_country").agg(F.count(F.lit(1)).alias("fraud_count")).orderBy(F.desc("fraud_count"), "ip_country").limit(10)


FRAUD_COUNTRY = sql.with_tables("sc", "SELECT ip_country, count(*) AS fraud_count FROM sc WHERE fraud_score >= 0.85 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def top_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    sums = t.transactions.groupBy("merchant_id").agg(F.count("txn_id").alias("txn_count"), F.coalesce(cents(F.sum(F.when(F.col("status") == "succeeded", F.col("amount")))), F.lit(0.0)).alias("gmv"))
    return sums.join(t.merchants.select("merchant_id", "name"), "merchant_id").select("name", "txn_count", "gmv").orderBy(F.desc("gmv"), "name").limit(8)


TOP_MERCHANTS = sql.with_tables("merchants t", "SELECT name, count(txn_id) AS txn_count, coalesce(sum(amount) FILTER (WHERE t.status = 'succeeded')::BIGINT / 100.0, 0) AS gmv FROM t JOIN merchants USING (merchant_id) GROUP BY merchant_id, name ORDER BY gmv DESC, name LIMIT 8")


def suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).scored.filter(F.col("fraud_score") >= REVIEW)
    latest = rows.orderBy(F.desc("created_at"), F.desc("txn_id")).limit(15)
    return latest.select(F.col("txn_id").cast("string").alias("txn_id"), cents("amount").alias("amount_eur"), "currency", "fraud_score", "ip_country", "device_type", stamp("created_at").alias("created_at"))


SUSPICIOUS = sql.with_tables("sc", f"SELECT txn_id::VARCHAR AS txn_id, amount / 100.0 AS amount_eur, currency, fraud_score, ip_country, device_type, {sql.when('created_at')} AS created_at FROM (SELECT * FROM sc WHERE points >= 6000 ORDER BY created_at DESC, txn_id DESC LIMIT 15)")


def alerts(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    rows = documents.to_alerts(Tables(spark, sf_dir).scored).orderBy(F.desc("created_at"), F.desc("txn_id")).limit(limit)
    return rows.withColumns({"created_at": stamp("created_at"), "rules_triggered": F.array_join("rules_triggered", ",")})


ALERTS = sql.with_tables("fi", f"""
SELECT txn_id, customer_id, merchant_id, amount, currency, ip_country, device_type, fraud_score, decision, array_to_string(rules_triggered, ',') AS rules_triggered, model_version, velocity_1h, velocity_24h, {sql.when("created_at")} AS created_at
FROM (SELECT * FROM fi ORDER BY created_at DESC, txn_id DESC LIMIT 20)""")


def score_hist(spark: SparkSession, sf_dir: str, bins: int = 20, limit: int = 300) -> DataFrame:
    """Histogram over 0 to 1 of the latest alerts' scores, by model version."""
    rows = documents.to_alerts(Tables(spark, sf_dir).scored).orderBy(F.desc("created_at"), F.desc("txn_id")).limit(limit)
    points = F.round(F.col("fraud_score") * 10000).cast("bigint")
    place = F.least(F.width_bucket(points.cast("double"), F.lit(0.0), F.lit(10000.0), F.lit(bins)), F.lit(bins)).cast("bigint")
    return rows.groupBy("model_version", place.alias("bin")).agg(F.count(F.lit(1)).alias("alerts"))


SCORE_HIST = sql.with_tables("fi", "SELECT model_version, least(points // 500 + 1, 20)::BIGINT AS bin, count(*) AS alerts FROM (SELECT * FROM fi ORDER BY created_at DESC, txn_id DESC LIMIT 300) GROUP BY ALL")


def velocity(spark: SparkSession, sf_dir: str, customers: int = 5) -> DataFrame:
    """Current velocity of the customers with the lowest ids, as of the latest transaction."""
    t = Tables(spark, sf_dir)
    now = t.as_of(t.transactions)
    some = t.customers.select("customer_id").orderBy("customer_id").limit(customers)
    rows = t.transactions.filter(F.col("created_at") > now - F.expr("INTERVAL 24 HOURS")).join(F.broadcast(some), "customer_id").withColumn("now", now)  # `customers` rows
    counted = rows.groupBy("customer_id").agg(*(F.count_if(F.col("created_at") > F.col("now") - F.expr(f"INTERVAL {h} HOURS")).alias(n) for n, h in (("v1h", 1), ("v24h", 24))))
    return some.join(counted, "customer_id", "left").select("customer_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v1h", "v24h")))


VELOCITY = sql.with_tables("customers t", """
SELECT c.customer_id, count(*) FILTER (WHERE t.created_at > m.now - INTERVAL 1 HOUR) AS v1h, count(*) FILTER (WHERE t.created_at > m.now - INTERVAL 24 HOUR) AS v24h
FROM (SELECT customer_id FROM customers ORDER BY customer_id LIMIT 5) c CROSS JOIN (SELECT max(created_at) AS now FROM t) m LEFT JOIN t ON t.customer_id = c.customer_id GROUP BY 1""")

QUERIES = {
    "dash_kpis": (kpis, KPIS),
    "dash_minutes": (minutes, MINUTES),
    "dash_fraud_country": (fraud_country, FRAUD_COUNTRY),
    "dash_top_merchants": (top_merchants, TOP_MERCHANTS),
    "dash_suspicious": (suspicious, SUSPICIOUS),
    "dash_alerts": (alerts, ALERTS),
    "dash_score_hist": (score_hist, SCORE_HIST),
    "dash_velocity": (velocity, VELOCITY),
}
