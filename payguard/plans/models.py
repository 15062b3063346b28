"""Model-quality queries: drift, ranking, monitoring cycles, skew and consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payguard.functions.columns import confusion_counts, ratio
from payguard.functions.features import feature_columns
from payguard.functions.velocity import training
from payguard.ml import drift as drifts
from payguard.ml import evaluate, monitor
from payguard.operators import documents, star, writeback
from payguard.plans import oracle as sql
from payguard.plans.oltp import stamp
from payguard.sources.changes import parse
from payguard.sources.tables import Tables, truth
from payguard.streaming.fanout import windowed_counts


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the last day's rows against all rows before it, on exact values."""
    t = Tables(spark, sf_dir)
    rows = feature_columns(training(t.transactions.filter("customer_id IS NOT NULL"))).withColumn("cut", t.as_of(t.transactions) - F.expr("INTERVAL 1 DAY"))
    return drifts.drift(rows.filter("created_at < cut"), rows.filter("created_at >= cut")).select("feature", "distance", "n_reference", "n_current", "drifted")


DRIFT = sql.with_tables("x", """
WITH y AS (SELECT *, created_at < (SELECT max(created_at) FROM t) - INTERVAL 1 DAY AS ref FROM x),
p AS (
  SELECT 'amount_log' AS feature, greatest(amount, 0) AS bin, ref FROM y UNION ALL SELECT 'is_high_risk_country', (ip_country IN ('RU', 'NG', 'KP', 'IR', 'VE', 'BY'))::INT, ref FROM y
  UNION ALL SELECT 'is_pos_device', (device_type = 'pos')::INT, ref FROM y UNION ALL SELECT 'velocity_1h', velocity_1h, ref FROM y UNION ALL SELECT 'velocity_24h', velocity_24h, ref FROM y),
c AS (SELECT feature, bin, count(*) FILTER (WHERE ref) AS a, count(*) FILTER (WHERE NOT ref) AS b FROM p GROUP BY ALL),
s AS (SELECT feature, sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER w AS n, sum(b) OVER w AS m FROM c WINDOW u AS (PARTITION BY feature ORDER BY bin), w AS (PARTITION BY feature)),
g AS (SELECT feature, max(abs(ca * m - cb * n))::BIGINT AS gap, max(n)::BIGINT AS n, max(m)::BIGINT AS m FROM s GROUP BY feature)
SELECT feature, gap / (n * m) AS distance, n AS n_reference, m AS n_current, gap / (n * m) > sqrt(-ln(0.025) / 2) * sqrt((n + m) / (n * m)) AS drifted FROM g""")


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC and average precision of the rule scores, to nine digits."""
    rows = truth(Tables(spark, sf_dir).scored).filter("is_fraud IS NOT NULL").withColumn("label", F.col("is_fraud").cast("int"))
    out = evaluate.ranking(rows)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


RANKING = sql.with_tables("sc", """
WITH g AS (SELECT points, count(*) FILTER (WHERE is_fraud) AS p, count(*) FILTER (WHERE NOT is_fraud) AS n FROM sc WHERE labelled GROUP BY points),
c AS (SELECT *, sum(p) OVER (ORDER BY points DESC) AS tp, sum(n) OVER (ORDER BY points DESC) AS fp FROM g)
SELECT round(sum((tp - p / 2) * n) / (sum(p) * sum(n)), 9) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 9) AS average_precision FROM c""")


def monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served performance of each day as monitoring records: day, n, tp, fp, fn, precision, recall, status, reasons."""
    rows = monitor.served_rows(documents.to_transaction_logs(Tables(spark, sf_dir).scored))
    daily = monitor.rates(rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(*confusion_counts()))
    cfg = monitor.MonitorConfig()
    found = F.array_compact(F.array(F.when(F.col("recall") < cfg.least_recall, "recall"), F.when(F.col("precision") < cfg.least_precision, "precision")))
    few = F.col("n") < monitor.LEAST_WINDOW
    status = F.when(few, "skipped").when(F.size(found) > 0, "alert").otherwise("ok")
    return daily.select("day", "n", "tp", "fp", "fn", "precision", "recall", status.alias("status"), F.array_join(found, ",").alias("reasons"))


_DAYS = """
WITH c AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE decision = 'block' AND is_fraud) AS tp, count(*) FILTER (WHERE decision = 'block' AND NOT is_fraud) AS fp, count(*) FILTER (WHERE decision <> 'block' AND is_fraud) AS fn FROM sc WHERE labelled GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c),
m AS (SELECT *, CASE WHEN n < 30 THEN 'skipped' WHEN recall < 0.7 OR precision < 0.5 THEN 'alert' ELSE 'ok' END AS status, concat_ws(',', CASE WHEN recall < 0.7 THEN 'recall' END, CASE WHEN precision < 0.5 THEN 'precision' END) AS reasons FROM r)
"""
MONITORING = sql.with_tables("sc", f"{_DAYS} SELECT * FROM m")


def monitoring_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten records."""
    return monitoring(spark, sf_dir).orderBy(F.desc("day")).limit(10).select("day", "status", "precision", "recall", "reasons")


MONITORING_TAIL = sql.with_tables("sc", f"{_DAYS} SELECT day, status, precision, recall, reasons FROM m ORDER BY day DESC LIMIT 10")


def monitoring_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty records in order of time, and which one is the latest."""
    rows = monitoring(spark, sf_dir).orderBy(F.desc("day")).limit(50)
    return rows.select("day", "n", "precision", "recall", (F.row_number().over(Window.orderBy(F.desc("day"))) == 1).alias("latest"))  # fifty rows


MONITORING_HISTORY = sql.with_tables("sc", f"{_DAYS} SELECT day, n, precision, recall, day = (SELECT max(day) FROM m) AS latest FROM m ORDER BY day DESC LIMIT 50")


def skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of which some were served with counts that are off (txn_id % 100 = 5: an hour's by one; = 9: both by two), against recomputed counts."""
    t = Tables(spark, sf_dir)
    place = F.col("txn_id") % 100
    off = t.scored.withColumns({"velocity_1h": F.col("velocity_1h") + F.when(place == 5, 1).when(place == 9, 2).otherwise(0), "velocity_24h": F.col("velocity_24h") + F.when(place == 9, 2).otherwise(0)})
    return monitor.skew(documents.to_transaction_logs(off), t.transactions)


SKEW = sql.with_tables("sc", "SELECT count(*) AS rows, count(*) FILTER (WHERE txn_id % 100 NOT IN (5, 9)) AS equal_1h, count(*) FILTER (WHERE txn_id % 100 <> 9) AS equal_24h FROM sc")


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of which some are lost (txn_id % 100 = 5) and some doubled (txn_id % 100 = 9), against the transactions."""
    t = Tables(spark, sf_dir)
    logs = documents.to_transaction_logs(t.scored).filter("txn_id % 100 <> 5")
    return monitor.consistency(logs.unionByName(logs.filter("txn_id % 100 = 9")), t.decided)


CONSISTENCY = sql.with_tables("sc", "SELECT count(*) FILTER (WHERE txn_id % 100 = 5) AS missing, 0::BIGINT AS orphans, count(*) FILTER (WHERE txn_id % 100 = 9) AS double FROM sc")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions as change messages, some in envelopes, deleted or broken, decoded again: rows by outcome."""
    t = Tables(spark, sf_dir)
    row = F.struct("txn_id", "merchant_id", "customer_id", "pm_id", "amount", "currency", "status", "device_type", "ip_country", "metadata", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").alias("created_at"), F.when(F.col("txn_id") % 40 == 3, "true").otherwise("false").alias("__deleted"))
    kind = F.col("txn_id") % 20
    value = F.when(kind == 0, F.concat(F.lit('{"payload":{"before":null,"after":'), F.to_json(row), F.lit("}}"))).when(kind == 1, F.concat(F.lit('{"after":'), F.to_json(row), F.lit("}"))).when(kind == 2, F.substring(F.to_json(row), 1, 30)).when(kind != 4, F.to_json(row))
    messages = t.transactions.select(value.alias("value"), F.lit("transactions").alias("topic"), F.lit(0).alias("partition"), F.col("txn_id").alias("offset"), F.col("created_at").alias("timestamp"))
    read = F.col("error").isNull()
    out = parse(messages).filter("kept OR error IS NOT NULL").select(F.coalesce("error", F.lit("row")).alias("outcome"), F.when(read, F.col("row.amount")).otherwise(0).alias("amount"), F.when(read, F.col("instant")).otherwise(F.col("timestamp")).alias("at"))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"), stamp(F.max("at")).alias("latest"))


CHANGES = sql.with_tables("t", f"""
SELECT CASE txn_id % 20 WHEN 2 THEN 'not a JSON object of the expected types' WHEN 4 THEN 'null value' ELSE 'row' END AS outcome, count(*) AS rows, sum(CASE WHEN txn_id % 20 IN (2, 4) THEN 0 ELSE amount END)::BIGINT AS amount, {sql.when("max(created_at)")} AS latest
FROM t WHERE txn_id % 40 <> 3 GROUP BY 1""")


def latest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as change rows of their line items (each one an image of its order), applied: the last image of each order."""
    t = Tables(spark, sf_dir)
    rows = t.raw("lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("ts"), "l_linenumber", F.col("l_partkey"), F.when(F.col("l_linenumber") == 7, "true").otherwise("false").alias("__deleted"))
    return writeback.latest_images(rows, "l_orderkey", ("ts", "l_linenumber", "l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey")


LATEST_IMAGES = """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) = 1) WHERE l_linenumber <> 7"""


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of which every third arrived twice, the second time later: each key once, with its first arrival."""
    t = Tables(spark, sf_dir)
    late = t.transactions.filter("txn_id % 3 = 0").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    return writeback.once(t.transactions.unionByName(late)).select("txn_id", "idempotency_key", stamp("created_at").alias("created_at"))


INTAKE = sql.with_tables("t", f"SELECT txn_id, idempotency_key, {sql.when('created_at')} AS created_at FROM t")


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming hourly counts, over the table."""
    out = windowed_counts(Tables(spark, sf_dir).scored, "1 hour")
    return out.withColumn("window_start", stamp("window_start"))


HOURLY_WINDOWS = sql.with_tables("sc", f"SELECT {sql.when("date_trunc('hour', created_at)")} AS window_start, count(*) AS count, count(*) FILTER (WHERE points >= 8500) AS fraud_count, sum(amount)::BIGINT AS volume_cents FROM sc GROUP BY 1")


def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose dimension members are unknown."""
    t = Tables(spark, sf_dir)
    return star.unmatched(star.build(star.daily_extract(t.decided, t.payment_methods, t.merchants))["fact"])


UNMATCHED_KEYS = sql.with_tables("t geo", "SELECT 0::BIGINT AS no_merchant_key, count(*) FILTER (WHERE customer_id IS NULL) AS no_customer_key, 0::BIGINT AS no_pm_key, count(*) FILTER (WHERE ip_country NOT IN (SELECT country_code FROM geo)) AS no_geo_key FROM t WHERE status = 'succeeded'")


def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served precision at the observed and at a base rate of 0.3 %, by decision threshold; to six digits."""
    rows = truth(Tables(spark, sf_dir).scored).filter("is_fraud IS NOT NULL")
    cuts = rows.select("is_fraud", F.explode(F.array(F.lit("review"), F.lit("block"))).alias("threshold"), "decision")
    hit = F.col("decision").isin("block") | ((F.col("threshold") == "review") & (F.col("decision") == "review"))
    c = cuts.groupBy("threshold").agg(F.count_if(hit & F.col("is_fraud")).alias("tp"), F.count_if(hit & ~F.col("is_fraud")).alias("fp"), F.count_if("is_fraud").alias("p"), F.count_if(~F.col("is_fraud")).alias("n"))
    recall, fpr = F.col("tp") / F.col("p"), F.col("fp") / F.col("n")
    restated = recall * 0.003 / F.nullif(recall * 0.003 + fpr * (1 - 0.003), F.lit(0.0))
    return c.select("threshold", ratio("tp", F.col("tp") + F.col("fp"), 6).alias("precision"), F.round(restated, 6).alias("restated"))


BASE_RATE = sql.with_tables("sc", f"""
WITH c AS (SELECT threshold, count(*) FILTER (WHERE hit AND is_fraud) AS tp, count(*) FILTER (WHERE hit AND NOT is_fraud) AS fp, count(*) FILTER (WHERE is_fraud) AS p, count(*) FILTER (WHERE NOT is_fraud) AS n
  FROM (SELECT is_fraud, threshold, decision = 'block' OR (threshold = 'review' AND decision = 'review') AS hit FROM sc CROSS JOIN (SELECT unnest(['review', 'block']) AS threshold) WHERE labelled) GROUP BY threshold)
SELECT threshold, {sql.ratio("tp", "tp + fp", 6)} AS precision, round((tp / p) * 0.003::DOUBLE / ((tp / p) * 0.003::DOUBLE + (fp / n) * (1 - 0.003::DOUBLE)), 6) AS restated FROM c""")

QUERIES = {
    "ml_drift": (drift, DRIFT),
    "ml_ranking": (ranking, RANKING),
    "ml_monitoring": (monitoring, MONITORING),
    "doc_monitoring_tail": (monitoring_tail, MONITORING_TAIL),
    "dash_monitoring": (monitoring_history, MONITORING_HISTORY),
    "ml_skew": (skew, SKEW),
    "ml_consistency": (consistency, CONSISTENCY),
    "ml_base_rate": (base_rate, BASE_RATE),
    "changes_decode": (changes, CHANGES),
    "changes_apply": (latest_images, LATEST_IMAGES),
    "intake_once": (intake, INTAKE),
    "stream_hourly_windows": (hourly_windows, HOURLY_WINDOWS),
    "etl_unmatched_keys": (unmatched_keys, UNMATCHED_KEYS),
}
