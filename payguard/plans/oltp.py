"""Operational queries: revenue, decisions, segments, velocity, refunds, pre-aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.columns import cents, confusion_counts, elapsed_days, elapsed_hours, ratio
from payguard.operators import governance, preagg
from payguard.plans import oracle as sql
from payguard.sources.tables import Tables, truth


def stamp(column: str | Column) -> Column:
    """An instant as text, to the second."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def since(tables: Tables, df: DataFrame, interval: str) -> DataFrame:
    """Rows of the last `interval` before the latest one."""
    return df.filter(F.col("created_at") >= tables.as_of(df) - F.expr(f"INTERVAL {interval}"))


def top_merchants_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.orders.filter("status = 'succeeded'").filter(F.col("created_at") >= F.date_trunc("year", t.as_of(t.orders)))
    keys = rows.withColumn("month", F.date_format("created_at", "yyyy-MM-01")).groupBy("merchant_id", "month", "currency")
    sums = keys.agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("total"))
    out = sums.join(t.merchants.select("merchant_id", F.col("name").alias("merchant"), "country_code"), "merchant_id")
    return out.select("merchant", "country_code", "month", "currency", "txn_count", cents("total").alias("revenue"), ratio("total", F.col("txn_count") * 100, 2).alias("avg_basket")).orderBy(F.desc("revenue"), "merchant", "month", "currency").limit(10)


TOP_MERCHANTS_MONTH = sql.with_tables("merchants o", f"""
SELECT m.name AS merchant, m.country_code, strftime(date_trunc('month', o.created_at), '%Y-%m-%d') AS month, o.currency, count(*) AS txn_count, sum(amount)::BIGINT / 100.0 AS revenue, {sql.ratio("sum(amount)::BIGINT", "count(*) * 100", 2)} AS avg_basket
FROM o JOIN merchants m USING (merchant_id) WHERE o.status = 'succeeded' AND o.created_at >= (SELECT date_trunc('year', max(created_at)) FROM o)
GROUP BY ALL ORDER BY revenue DESC, merchant, month, currency LIMIT 10""")


def decisions_by_pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.decided_since(t.before(t.transactions, "30 DAYS")).select("pm_id", "decision").join(t.payment_methods.select("pm_id", "type", "brand"), "pm_id")
    block = F.count_if(F.col("decision") == "block")
    out = rows.groupBy("type", "brand").agg(F.count(F.lit(1)).alias("txn_count"), F.count_if(F.col("decision") == "review").alias("review_count"), block.alias("block_count"))
    return out.withColumn("block_rate_pct", ratio("block_count", "txn_count", 2, 100)).orderBy(F.desc_nulls_last("block_rate_pct"), "type", "brand")


DECISIONS_BY_PM = sql.with_tables("pms fi", f"""
SELECT pms.type, pms.brand, count(*) AS txn_count, count(*) FILTER (WHERE fi.decision = 'review') AS review_count, count(*) FILTER (WHERE fi.decision = 'block') AS block_count,
  {sql.ratio("count(*) FILTER (WHERE fi.decision = 'block')", "count(*)", 2, 100)} AS block_rate_pct
FROM t JOIN pms USING (pm_id) LEFT JOIN fi USING (txn_id) WHERE t.created_at >= (SELECT max(created_at) FROM t) - INTERVAL 30 DAY GROUP BY ALL""")


def labelled(t: Tables, interval: str = "24 HOURS") -> DataFrame:
    """Scored transactions of the last `interval` whose label is known: model_version, is_fraud, predicted."""
    rows = truth(t.scored_since(t.before(t.transactions, interval)))
    marked = F.col("decision").isin("review", "block")  # what has an indicator
    return rows.select(F.when(marked, F.col("model_version")).otherwise(F.lit("allow (no indicator)")).alias("model_version"), "is_fraud", (F.col("decision") == "block").alias("predicted"))


def served_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labelled(Tables(spark, sf_dir)).agg(*confusion_counts("scored"))
    return out.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp"), 3), "recall": ratio("tp", F.col("tp") + F.col("fn"), 3)})


def served_perf_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labelled(Tables(spark, sf_dir)).groupBy("model_version").agg(*confusion_counts("scored"))
    return out.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp"), 3), "recall": ratio("tp", F.col("tp") + F.col("fn"), 3)})


def _served(group: str) -> str:
    tp, fp, fn = "count(*) FILTER (WHERE hit AND is_fraud)", "count(*) FILTER (WHERE hit AND NOT is_fraud)", "count(*) FILTER (WHERE NOT hit AND is_fraud)"
    return sql.with_tables("fi d", f"""
WITH l AS (SELECT coalesce(fi.model_version, 'allow (no indicator)') AS model_version, d.is_fraud, coalesce(fi.decision = 'block', false) AS hit
  FROM d LEFT JOIN fi USING (txn_id) WHERE d.fraud_score IS NOT NULL AND d.labelled AND d.created_at >= (SELECT max(created_at) FROM d) - INTERVAL 24 HOUR)
SELECT {group} count(*) AS scored, {tp} AS tp, {fp} AS fp, {fn} AS fn, {sql.ratio(tp, f"{tp} + {fp}", 3)} AS precision, {sql.ratio(tp, f"{tp} + {fn}", 3)} AS recall FROM l {"GROUP BY ALL" if group else ""}""")


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.transactions.filter("status = 'succeeded' AND customer_id IS NOT NULL").groupBy("customer_id").agg(F.max("created_at").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("amount").alias("total"))
    segment = F.when((F.col("frequency") > 50) & (F.col("total") > 500_000), "VIP").when((F.col("frequency") > 10) & (F.col("total") > 100_000), "Regular").when(F.col("frequency") > 2, "Occasional").otherwise("New")
    return rows.select("customer_id", elapsed_days("last", t.as_of(t.transactions)).alias("recency_days"), "frequency", cents("total").alias("monetary"), segment.alias("segment")).orderBy(F.desc("monetary"), "customer_id").limit(20)


RFM = sql.with_tables("t", """
SELECT customer_id, (((SELECT max(us) FROM t) - max(us)) // 86400000000)::INT AS recency_days, count(*) AS frequency, sum(amount)::BIGINT / 100.0 AS monetary,
  CASE WHEN count(*) > 50 AND sum(amount) > 500000 THEN 'VIP' WHEN count(*) > 10 AND sum(amount) > 100000 THEN 'Regular' WHEN count(*) > 2 THEN 'Occasional' ELSE 'New' END AS segment
FROM t WHERE status = 'succeeded' AND customer_id IS NOT NULL GROUP BY customer_id ORDER BY monetary DESC, customer_id LIMIT 20""")


def velocity_suspects(spark: SparkSession, sf_dir: str, interval: str = "1 HOUR", most: int = 10, countries: int = 2, cards: int = 3) -> DataFrame:
    """Customers above any of three limits in the last interval."""
    t = Tables(spark, sf_dir)
    rows = since(t, t.transactions, interval).filter("customer_id IS NOT NULL").join(t.payment_methods.select("pm_id", "fingerprint"), "pm_id", "left")
    out = rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("txn_count"), cents(F.sum("amount")).alias("total"), F.count_distinct("ip_country").alias("distinct_countries"), F.count_distinct("fingerprint").alias("distinct_cards"))
    return out.filter((F.col("txn_count") > most) | (F.col("distinct_countries") > countries) | (F.col("distinct_cards") > cards)).orderBy(F.desc("txn_count"), "customer_id").limit(20)


def _suspects(hours: int, most: int, countries: int, cards: int) -> str:
    return sql.with_tables("t pms", f"""
SELECT t.customer_id, count(*) AS txn_count, sum(amount)::BIGINT / 100.0 AS total, count(DISTINCT ip_country) AS distinct_countries, count(DISTINCT fingerprint) AS distinct_cards
FROM t LEFT JOIN pms USING (pm_id) WHERE t.created_at >= (SELECT max(created_at) FROM t) - INTERVAL {hours} HOUR AND t.customer_id IS NOT NULL GROUP BY t.customer_id
HAVING count(*) > {most} OR count(DISTINCT ip_country) > {countries} OR count(DISTINCT fingerprint) > {cards} ORDER BY txn_count DESC, customer_id LIMIT 20""")


def velocity_suspects_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a day, with limits that the test tables' thin traffic exceeds."""
    return velocity_suspects(spark, sf_dir, "24 HOURS", 3, 2, 1)



def refunds_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    now = t.as_of(t.transactions)
    rows = t.refunds.filter("status = 'pending'").filter(F.col("created_at") < now - F.expr("INTERVAL 48 HOURS"))
    rows = rows.join(t.transactions.select("txn_id", "currency", "merchant_id"), "txn_id").join(t.merchants.select("merchant_id", F.col("name").alias("merchant"), "tier"), "merchant_id")
    return rows.select("refund_id", "txn_id", cents("amount").alias("refund_amount"), "currency", "reason", elapsed_hours("created_at", now).alias("hours_pending"), "merchant", "tier").orderBy(F.desc("hours_pending"), "refund_id")


REFUNDS_SLA = sql.with_tables("merchants t refunds", """
SELECT r.refund_id, r.txn_id, r.amount / 100.0 AS refund_amount, t.currency, r.reason, ((SELECT max(us) FROM t) - epoch_us(r.created_at)) / 3600000000.0 AS hours_pending, m.name AS merchant, m.tier
FROM refunds r JOIN t ON t.txn_id = r.txn_id JOIN merchants m ON m.merchant_id = t.merchant_id WHERE r.status = 'pending' AND r.created_at < (SELECT max(created_at) FROM t) - INTERVAL 48 HOUR""")


def mv_daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = preagg.daily_revenue(t.decided_since(F.date_trunc("day", t.as_of(t.transactions)) - F.expr("INTERVAL 7 DAYS")))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "currency", "txn_count", cents("gross_amount_cents").alias("gross_amount"), ratio("score_points", F.col("scored") * 10000, 4).alias("avg_fraud_score")).orderBy(F.desc("day"), F.desc("gross_amount"))


MV_DAILY_REVENUE = sql.with_tables("d", f"""
SELECT strftime(created_at, '%Y-%m-%d') AS day, currency, count(*) AS txn_count, sum(amount)::BIGINT / 100.0 AS gross_amount, {sql.ratio("sum(points)::BIGINT", "count(points) * 10000", 4)} AS avg_fraud_score
FROM d WHERE status = 'succeeded' AND created_at::DATE >= (SELECT max(created_at)::DATE FROM d) - 7 GROUP BY ALL""")


def mv_merchant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = preagg.merchant_stats(t.merchants, t.decided)
    return rows.filter("txn_count >= 20").select("name", "tier", "txn_count", cents("gmv_cents").alias("gmv"), "avg_fraud_score").orderBy(F.desc("avg_fraud_score"), "name").limit(10)


MV_MERCHANT_STATS = sql.with_tables("merchants d", f"""
SELECT m.name, m.tier, count(d.txn_id) AS txn_count, coalesce(sum(d.amount) FILTER (WHERE d.status = 'succeeded'), 0)::BIGINT / 100.0 AS gmv, coalesce({sql.ratio("sum(points)::BIGINT", "count(points) * 10000", 4)}, 0) AS avg_fraud_score
FROM merchants m LEFT JOIN d USING (merchant_id) GROUP BY m.merchant_id, m.name, m.tier HAVING count(d.txn_id) >= 20 ORDER BY avg_fraud_score DESC, name LIMIT 10""")


def idempotency_lookup(spark: SparkSession, sf_dir: str, key: str = "key-77") -> DataFrame:
    return Tables(spark, sf_dir).transactions.filter(F.col("idempotency_key") == key).select("txn_id")


IDEMPOTENCY_LOOKUP = sql.with_tables("t", "SELECT txn_id FROM t WHERE idempotency_key = 'key-77'")


def gdpr_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What erasing the customer of the latest transaction would change: the customer's row, detached and remaining transactions."""
    t = Tables(spark, sf_dir)
    target = t.transactions.filter("customer_id IS NOT NULL").orderBy(F.desc("created_at"), F.desc("txn_id")).limit(1).select("customer_id")
    done = governance.anonymize(t.customers, t.payment_methods, t.transactions, target)
    left = done["transactions"].join(target, "customer_id", "left_semi").agg(F.count(F.lit(1)).alias("remaining"))
    return done["customers"].join(done["counts"], "customer_id").crossJoin(left).select("customer_id", "email", "name", "country_code", "detached", "remaining")


GDPR_ANONYMIZE = sql.with_tables("customers t", """
SELECT c.customer_id, 'anonymized_' || left(md5(c.customer_id::VARCHAR), 8) || '@deleted.invalid' AS email, 'ANONYMIZED' AS name, NULL::VARCHAR AS country_code, (SELECT count(*) FROM t WHERE t.customer_id = c.customer_id) AS detached, 0::BIGINT AS remaining
FROM customers c WHERE c.customer_id = (SELECT customer_id FROM t WHERE customer_id IS NOT NULL ORDER BY created_at DESC, txn_id DESC LIMIT 1)""")

QUERIES = {
    "oltp_top_merchants_month": (top_merchants_month, TOP_MERCHANTS_MONTH),
    "oltp_decisions_by_pm": (decisions_by_pm, DECISIONS_BY_PM),
    "oltp_served_perf": (served_perf, _served("")),
    "oltp_served_perf_by_version": (served_perf_by_version, _served("model_version,")),
    "oltp_rfm": (rfm, RFM),
    "oltp_velocity_suspects": (velocity_suspects, _suspects(1, 10, 2, 3)),
    "oltp_velocity_suspects_daily": (velocity_suspects_daily, _suspects(24, 3, 2, 1)),
    "oltp_refunds_sla": (refunds_sla, REFUNDS_SLA),
    "mv_daily_revenue": (mv_daily_revenue, MV_DAILY_REVENUE),
    "mv_merchant_stats": (mv_merchant_stats, MV_MERCHANT_STATS),
    "oltp_idempotency_lookup": (idempotency_lookup, IDEMPOTENCY_LOOKUP),
    "gdpr_anonymize": (gdpr_anonymize, GDPR_ANONYMIZE),
}
