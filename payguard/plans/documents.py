"""Queries over documents: alerts, logs, feature snapshots, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.columns import cents, ratio_half_even
from payguard.operators import documents, governance
from payguard.plans import oracle as sql
from payguard.plans.oltp import stamp
from payguard.sources.tables import Tables


def _alerts(t: Tables) -> DataFrame:
    return documents.to_alerts(t.scored)


def _points() -> Column:
    return F.sum(F.round(F.col("fraud_score") * 10000).cast("bigint"))


def alerts_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = documents.to_alerts(t.scored_since(t.before(t.transactions, "24 HOURS")))
    out = rows.groupBy("decision", "model_version").agg(F.count(F.lit(1)).alias("alerts"), _points().alias("points"), F.sum("amount").alias("total"))
    return out.select("decision", "model_version", "alerts", ratio_half_even("points", F.col("alerts") * 10000, 4).alias("avg_score"), cents("total").alias("total_amount")).orderBy(F.desc("alerts"))


ALERTS_BY_DECISION = sql.with_tables("t fi", f"""
SELECT decision, model_version, count(*) AS alerts, {sql.even("sum(points)::BIGINT", "count(*) * 10000", 4)} AS avg_score, sum(amount)::BIGINT / 100.0 AS total_amount
FROM fi WHERE created_at >= (SELECT max(created_at) FROM t) - INTERVAL 24 HOUR GROUP BY ALL""")


def rules_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alerts(Tables(spark, sf_dir)).filter("model_version = 'rule-based-v1'").select(F.explode("rules_triggered").alias("rule"), "fraud_score")
    out = rows.groupBy("rule").agg(F.count(F.lit(1)).alias("count"), _points().alias("points"))
    return out.select("rule", "count", ratio_half_even("points", F.col("count") * 10000, 4).alias("avg_score")).orderBy(F.desc("count"), "rule")


RULES_FIRED = sql.with_tables("fi", f"""
SELECT rule, count(*) AS count, {sql.even("sum(points)::BIGINT", "count(*) * 10000", 4)} AS avg_score FROM (SELECT unnest(rules_triggered) AS rule, points FROM fi WHERE model_version = 'rule-based-v1') GROUP BY rule""")


def alerts_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _alerts(Tables(spark, sf_dir)).groupBy("ip_country").agg(F.count(F.lit(1)).alias("alerts"), F.sum(F.when(F.col("decision") == "block", 1).otherwise(0)).alias("blocks"), _points().alias("points"))
    return out.select("ip_country", "alerts", "blocks", ratio_half_even("blocks", "alerts", 1, 100).alias("block_share_pct"), ratio_half_even("points", F.col("alerts") * 10000, 4).alias("avg_score")).orderBy(F.desc("alerts"), "ip_country").limit(10)


ALERTS_BY_COUNTRY = sql.with_tables("fi", f"""
SELECT ip_country, count(*) AS alerts, count(*) FILTER (WHERE decision = 'block') AS blocks, {sql.even("count(*) FILTER (WHERE decision = 'block')", "count(*)", 1, 100)} AS block_share_pct, {sql.even("sum(points)::BIGINT", "count(*) * 10000", 4)} AS avg_score
FROM fi GROUP BY ip_country ORDER BY alerts DESC, ip_country LIMIT 10""")


def hourly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = documents.to_transaction_logs(t.scored_since(t.before(t.known, "24 HOURS")))
    return rows.groupBy(stamp(F.date_trunc("hour", "created_at")).alias("hour")).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("hour"))


HOURLY_VOLUME = sql.with_tables("sc", f"SELECT {sql.when("date_trunc('hour', created_at)")} AS hour, count(*) AS events FROM sc WHERE created_at >= (SELECT max(created_at) FROM sc) - INTERVAL 24 HOUR GROUP BY 1")


def txn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of the newest alert's transaction."""
    t = Tables(spark, sf_dir)
    last = _alerts(t).orderBy(F.desc("created_at"), F.desc("txn_id")).limit(1).select("txn_id")
    rows = documents.to_transaction_logs(t.scored).join(last, "txn_id", "left_semi")
    return rows.select("txn_id", "event_type", stamp("created_at").alias("created_at"), F.col("payload.fraud_score").alias("fraud_score"), F.col("payload.decision").alias("decision"), F.col("payload.velocity_1h").alias("velocity_1h"), F.col("payload.model_version").alias("model_version"))


TXN_HISTORY = sql.with_tables("sc fi", f"""
SELECT txn_id, 'transaction.scored' AS event_type, {sql.when("created_at")} AS created_at, fraud_score, decision, velocity_1h, model_version FROM sc WHERE txn_id = (SELECT txn_id FROM fi ORDER BY created_at DESC, txn_id DESC LIMIT 1)""")


def high_velocity(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    rows = documents.latest_features(Tables(spark, sf_dir).scored).filter(F.col("velocity_1h") > most)
    return rows.select("customer_id", "velocity_1h", "velocity_24h", "last_fraud_score", "last_decision", stamp("last_updated").alias("last_updated")).orderBy(F.desc("velocity_1h"), "customer_id").limit(10)


def high_velocity_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a limit of 1, which the test tables' thin traffic exceeds."""
    return high_velocity(spark, sf_dir, 1)


_LATEST = "WITH m AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, txn_id DESC) = 1)"
def _fast(most: int) -> str:
    return sql.with_tables("sc", f"""{_LATEST}
SELECT customer_id, velocity_1h, velocity_24h, fraud_score AS last_fraud_score, decision AS last_decision, {sql.when("created_at")} AS last_updated FROM m WHERE velocity_1h > {most} ORDER BY velocity_1h DESC, customer_id LIMIT 10""")




def last_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.latest_features(Tables(spark, sf_dir).scored)
    return rows.groupBy(F.col("last_model_version").alias("model"), F.col("last_decision").alias("decision")).agg(F.count(F.lit(1)).alias("customers")).orderBy("model", F.desc("customers"))


LAST_DECISIONS = sql.with_tables("sc", f"{_LATEST}\nSELECT model_version AS model, decision, count(*) AS customers FROM m GROUP BY ALL")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and exact 95th percentile (the least value that 95 % do not exceed) by service; durations are tenths of a millisecond."""
    t = Tables(spark, sf_dir)
    rows = documents.to_logs(t.decided_since(t.before(t.transactions, "24 HOURS"))).filter("type = 'access' AND context.duration_ms IS NOT NULL")
    tenths = F.round(F.col("context.duration_ms") * 10).cast("bigint")
    out = rows.groupBy("service").agg(F.count(F.lit(1)).alias("requests"), F.sum(tenths).alias("sum"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY context.duration_ms)").alias("p95_ms"))
    return out.select("service", "requests", ratio_half_even("sum", F.col("requests") * 10, 1).alias("avg_ms"), "p95_ms")


def _tenths(points: str) -> str:
    return f"((50000 + {points} * 10) // 1000 + ((50000 + {points} * 10) % 1000 > 500 OR ((50000 + {points} * 10) % 1000 = 500 AND ((50000 + {points} * 10) // 1000) % 2 = 1))::INT)"


LATENCY = sql.with_tables("d", f"""
WITH l AS (SELECT {_tenths("points")} AS x FROM d WHERE points IS NOT NULL AND created_at >= (SELECT max(created_at) FROM d) - INTERVAL 24 HOUR)
SELECT 'document-writer' AS service, count(*) AS requests, {sql.even("sum(x)::BIGINT", "count(*) * 10", 1)} AS avg_ms, quantile_disc(x, 0.95) / 10.0 AS p95_ms FROM l""")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = documents.to_logs(t.decided_since(t.before(t.transactions, "24 HOURS"))).filter("level = 'ERROR'")
    return rows.groupBy("service", "message").agg(F.count(F.lit(1)).alias("count"), stamp(F.max("created_at")).alias("last_seen")).orderBy(F.desc("count"), "service", "message").limit(20)


ERRORS = sql.with_tables("d", f"""
SELECT 'document-writer' AS service, 'transaction.unscored' AS message, count(*) AS count, {sql.when("max(created_at)")} AS last_seen FROM d WHERE points IS NULL AND created_at >= (SELECT max(created_at) FROM d) - INTERVAL 24 HOUR HAVING count(*) > 0""")


def retention(spark: SparkSession, sf_dir: str, days: int = 20) -> DataFrame:
    """Log rows by day that a retention rule would keep and drop as of the latest one."""
    t = Tables(spark, sf_dir)
    rows = documents.to_transaction_logs(t.scored)
    kept = governance.keeps(t.as_of(t.transactions), "created_at", days)
    marked = rows.select("created_at", kept.alias("kept"))
    return marked.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


RETENTION = sql.with_tables("t sc", """
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) FILTER (WHERE created_at + INTERVAL 20 DAY > (SELECT max(created_at) FROM t)) AS kept, count(*) FILTER (WHERE created_at + INTERVAL 20 DAY <= (SELECT max(created_at) FROM t)) AS dropped FROM sc GROUP BY 1""")


def retention_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each retention rule and the rows of today's documents that it governs."""
    t = Tables(spark, sf_dir)
    found = {"transaction_logs": documents.to_transaction_logs(t.scored), "logs": documents.to_logs(t.decided)}
    counts = None
    for name, df in found.items():
        row = df.groupBy(F.lit(name).alias("collection")).agg(F.count(F.lit(1)).alias("rows"))
        counts = row if counts is None else counts.unionByName(row)
    return governance.retention_report(spark).join(counts, "collection", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


RETENTION_POLICY = sql.with_tables("t sc", """
SELECT * FROM (VALUES ('transaction_logs', 'created_at', 90::INT, (SELECT count(*) FROM sc)), ('user_interactions', 'created_at', 30, 0), ('logs', 'ttl_expires_at', 0, (SELECT count(*) FROM t))) AS r (collection, rule, expire_after_days, rows)""")

QUERIES = {
    "doc_alerts_by_decision": (alerts_by_decision, ALERTS_BY_DECISION),
    "doc_rules_fired": (rules_fired, RULES_FIRED),
    "doc_alerts_by_country": (alerts_by_country, ALERTS_BY_COUNTRY),
    "doc_hourly_volume": (hourly_volume, HOURLY_VOLUME),
    "doc_txn_history": (txn_history, TXN_HISTORY),
    "doc_high_velocity": (high_velocity, _fast(10)),
    "doc_high_velocity_any": (high_velocity_any, _fast(1)),
    "doc_last_decisions": (last_decisions, LAST_DECISIONS),
    "doc_latency": (latency, LATENCY),
    "doc_errors": (errors, ERRORS),
    "doc_retention_effect": (retention, RETENTION),
    "doc_retention": (retention_policy, RETENTION_POLICY),
}
