"""Warehouse load, training sets and rule scoring as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions import features, rules, velocity
from payguard.functions.columns import cents, ratio
from payguard.operators import documents, governance, star, writeback
from payguard.operators.running import new_path, written
from payguard.plans import oracle as sql
from payguard.plans.oltp import stamp
from payguard.sources.changes import decode
from payguard.sources.snapshots import Snapshots
from payguard.sources.tables import TEST_RULES, Tables, truth

DAY = "2024-01-10"


def daily_extract(spark: SparkSession, sf_dir: str, day: str = DAY) -> DataFrame:
    t = Tables(spark, sf_dir)
    out = star.daily_extract(t.decided, t.payment_methods, t.merchants, day)
    return out.select("txn_id", "merchant_id", "customer_id", "pm_id", "amount", "currency", "fraud_score", "device_type", "ip_country", "pm_type", "pm_brand", "merchant_name", "merchant_country_code", "merchant_tier", stamp("created_at").alias("created_at")).fillna(-1, ["customer_id"])


DAILY_EXTRACT = sql.with_tables("d pms merchants", f"""
SELECT txn_id, merchant_id, coalesce(d.customer_id, -1) AS customer_id, pm_id, amount, currency, fraud_score, device_type, ip_country, type AS pm_type, brand AS pm_brand, name AS merchant_name, country_code AS merchant_country_code, tier AS merchant_tier, {sql.when("created_at")} AS created_at
FROM d LEFT JOIN pms USING (pm_id) JOIN merchants USING (merchant_id) WHERE created_at >= DATE '{DAY}' AND created_at < DATE '{DAY}' + 1 AND d.status = 'succeeded'""")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts with their surrogate keys; -1 stands for an unknown member."""
    t = Tables(spark, sf_dir)
    s = star.build(written(star.daily_extract(t.decided, t.payment_methods, t.merchants), "extract"))
    keys = ["merchant_key", "customer_key", "pm_key", "geo_key"]
    return s["fact"].select("txn_id", *keys, "date_key", F.col("amount_eur").cast("double").alias("amount_eur"), F.col("fee_amount").cast("double").alias("fee_amount"), "currency", "is_fraud", "device_type").fillna(-1, keys)


_KEY = "row_number() OVER (ORDER BY {0})"
FACT = sql.with_tables("d pms geo", f"""
WITH f AS (SELECT * FROM d WHERE status = 'succeeded'),
m AS (SELECT merchant_id, {_KEY.format("merchant_id")} AS k FROM (SELECT DISTINCT merchant_id FROM f)),
c AS (SELECT customer_id, {_KEY.format("customer_id")} AS k FROM (SELECT DISTINCT customer_id FROM f WHERE customer_id IS NOT NULL)),
y AS (SELECT pm_id, {_KEY.format("pm_id")} AS k FROM (SELECT DISTINCT pm_id FROM f))
SELECT f.txn_id, m.k AS merchant_key, coalesce(c.k, -1) AS customer_key, y.k AS pm_key, coalesce(geo.geo_key, -1)::BIGINT AS geo_key, strftime(created_at, '%Y%m%d')::INT AS date_key, amount / 100.0 AS amount_eur, (((amount * 14 + 5) // 10 + 50) // 100) / 100.0 AS fee_amount, currency, coalesce(fraud_score >= 0.85, false) AS is_fraud, device_type
FROM f LEFT JOIN m USING (merchant_id) LEFT JOIN c ON c.customer_id = f.customer_id LEFT JOIN y ON y.pm_id = f.pm_id LEFT JOIN geo ON geo.country_code = f.ip_country""")


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of the years that the orders span."""
    t = Tables(spark, sf_dir)
    span = t.orders.agg(F.date_trunc("year", F.min("created_at")).cast("date").alias("a"), F.date_add(F.date_trunc("year", F.max("created_at") + F.expr("INTERVAL 1 YEAR")).cast("date"), -1).alias("b")).first()
    return star.dim_date(spark, str(span["a"]), str(span["b"])).withColumn("full_date", F.date_format("full_date", "yyyy-MM-dd"))


DIM_DATE = sql.with_tables("o", """
SELECT strftime(x, '%Y%m%d')::INT AS date_key, strftime(x, '%Y-%m-%d') AS full_date, year(x)::INT AS year, quarter(x)::INT AS quarter, month(x)::INT AS month, weekofyear(x)::INT AS week, dayofweek(x)::INT AS day_of_week, dayofweek(x) IN (0, 6) AS is_weekend
FROM (SELECT unnest(generate_series((SELECT date_trunc('year', min(created_at)) FROM o), (SELECT date_trunc('year', max(created_at)) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM o), INTERVAL 1 DAY)) AS x)""")


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = truth(velocity.training(t.transactions.filter("customer_id IS NOT NULL")))
    return rows.select("txn_id", "amount", "device_type", "ip_country", "velocity_1h", "velocity_24h", "is_fraud")


TRAINING_SET = sql.with_tables("x", "SELECT txn_id, amount, device_type, ip_country, velocity_1h, velocity_24h, is_fraud FROM x WHERE labelled")


def current_window(spark: SparkSession, sf_dir: str, minutes: int = 30) -> DataFrame:
    """The last minutes' rows; velocity looks back beyond the window, so a day more is read."""
    t = Tables(spark, sf_dir)
    now, rows = t.as_of(t.transactions), t.transactions.filter("customer_id IS NOT NULL")
    rows = rows.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {minutes + 1440} MINUTES"))
    rows = velocity.training(rows).filter(F.col("created_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return truth(rows).select("txn_id", "amount", "device_type", "ip_country", "velocity_1h", "velocity_24h", "is_fraud")


def current_window_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's rows."""
    return current_window(spark, sf_dir, 1440)


def _window(minutes: int) -> str:
    return sql.with_tables("x", f"SELECT txn_id, amount, device_type, ip_country, velocity_1h, velocity_24h, is_fraud FROM x WHERE labelled AND created_at >= (SELECT max(created_at) FROM t) - INTERVAL {minutes} MINUTE")



def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature columns of the training set; amount_log at two digits."""
    t = Tables(spark, sf_dir)
    rows = features.feature_columns(velocity.training(t.transactions.filter("customer_id IS NOT NULL")))
    whole = [c for c in features.FEATURES if c != "amount_log"]
    return rows.select("txn_id", F.floor(F.log1p(F.col("amount").cast("double")) * 100 + 0.5).cast("bigint").alias("amount_log_100"), *(F.col(c).cast("int").alias(c) for c in whole))


FEATURE_ROWS = sql.with_tables("x", """
SELECT txn_id, floor(ln(1 + amount::DOUBLE) * 100 + 0.5)::BIGINT AS amount_log_100, hour(created_at)::INT AS hour_of_day, (isodow(created_at) - 1)::INT AS day_of_week, (ip_country IN ('RU', 'NG', 'KP', 'IR', 'VE', 'BY'))::INT AS is_high_risk_country, (device_type = 'pos')::INT AS is_pos_device, velocity_1h::INT AS velocity_1h, velocity_24h::INT AS velocity_24h FROM x""")


def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).scored
    return rows.select("txn_id", "fraud_score", "decision", "velocity_1h", "velocity_24h", F.array_join("rules_triggered", ",").alias("rules_triggered"), "model_version")


SCORE_RULES = sql.with_tables("sc", "SELECT txn_id, fraud_score, decision, velocity_1h, velocity_24h, array_to_string(rules_triggered, ',') AS rules_triggered, model_version FROM sc")


def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored transactions after their scores were written back twice, the second time with other scores: the first ones stay. Indicators are counted beside each."""
    t = Tables(spark, sf_dir)
    store = Snapshots(spark, new_path(spark, "oltp"))
    scored = written(t.scored, "scored")
    empty = t.transactions.select("txn_id", "status", "amount", "currency", "merchant_id", "created_at", F.lit(None).cast("double").alias("fraud_score"), F.col("created_at").alias("updated_at"))
    store.commit({"transactions": empty, "indicators": t.indicators_of(scored.limit(0))}, keys=writeback.KEYS)
    writeback.apply_scores(store, scored)
    writeback.apply_scores(store, rules.score_rules(scored, rules.RuleConfig(base=2000, velocity_1h=TEST_RULES.velocity_1h)))
    count = store.current("indicators").groupBy("txn_id").agg(F.count(F.lit(1)).alias("indicators"))
    return store.current("transactions").join(count, "txn_id", "left").select("txn_id", F.coalesce("fraud_score", F.lit(-1.0)).alias("fraud_score"), F.coalesce("indicators", F.lit(0)).alias("indicators"))


WRITE_BACK = sql.with_tables("d", "SELECT txn_id, coalesce(fraud_score, -1) AS fraud_score, (coalesce(decision, 'allow') <> 'allow')::BIGINT AS indicators FROM d")


def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table after two batches, upserted one after the other."""
    t = Tables(spark, sf_dir)
    first = documents.upsert_features(None, t.scored.filter("txn_id % 2 = 0"))
    out = documents.upsert_features(first, t.scored.filter("txn_id % 2 = 1"))
    return out.withColumn("last_updated", stamp("last_updated"))


LATEST_FEATURES = sql.with_tables("sc", f"""
SELECT customer_id, amount AS last_amount, currency AS last_currency, ip_country AS last_country, device_type AS last_device_type, velocity_1h, velocity_24h, fraud_score AS last_fraud_score, decision AS last_decision, model_version AS last_model_version, {sql.when("created_at")} AS last_updated, txn_id AS last_txn_id
FROM sc QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, txn_id DESC) = 1""")


def online_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short-lived feature records after two batches, as of the latest transaction: expired ones are gone."""
    t = Tables(spark, sf_dir)
    first = documents.upsert_online(None, t.scored.filter("txn_id % 2 = 0"), t.as_of(t.known), 86_400)
    out = documents.upsert_online(first, t.scored.filter("txn_id % 2 = 1"), t.as_of(t.known), 86_400)
    return out.withColumn("expires_at", stamp("expires_at"))


ONLINE_FEATURES = sql.with_tables("sc", f"""
SELECT customer_id, amount AS last_amount, ip_country AS last_country, velocity_1h, velocity_24h, {sql.when("created_at + INTERVAL 1 DAY")} AS expires_at
FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, txn_id DESC) = 1) WHERE created_at + INTERVAL 1 DAY > (SELECT max(created_at) FROM sc)""")


def merged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change messages of all transactions, decoded and applied in two batches that overlap: every seventh is deleted, every fifth changed, some of those by a late old image."""
    t = Tables(spark, sf_dir)

    def messages(rows: DataFrame, offset: int, amount: Column, deleted: Column) -> DataFrame:
        row = F.struct("txn_id", amount.alias("amount"), "currency", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").alias("created_at"), F.when(deleted, "true").otherwise("false").alias("__deleted"))
        return rows.select(F.to_json(F.struct(row.alias("after"))).alias("value"), F.lit("transactions").alias("topic"), F.lit(0).alias("partition"), (F.col("txn_id") * 4 + offset).alias("offset"), F.col("created_at").alias("timestamp"))

    rows, amount, no = t.transactions, F.col("amount"), F.lit(False)
    inserts, updates = messages(rows, 1, amount, no), messages(rows.filter("txn_id % 5 = 0"), 2, amount + 1, no)
    deletes, old = messages(rows.filter("txn_id % 7 = 0"), 3, amount, F.lit(True)), messages(rows.filter("txn_id % 10 = 0"), 0, amount - 1, no)
    store = Snapshots(spark, new_path(spark, "changes"))
    for batch in (inserts, inserts.unionByName(updates).unionByName(deletes).unionByName(old)):
        writeback.apply_images(store, "transactions", decode(batch, keep_deleted=True)[0], "txn_id", ("offset",))
    return store.current("transactions").select("txn_id", "amount", "currency", "status", stamp("created_at").alias("created_at"))


MERGED_CHANGES = sql.with_tables("t", f"SELECT txn_id, amount + (txn_id % 5 = 0)::INT AS amount, currency, status, {sql.when('created_at')} AS created_at FROM t WHERE txn_id % 7 <> 0")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = governance.Check
    tables = {"transactions": t.transactions, "merchants": t.merchants, "customers": t.customers, "indicators": t.indicators, "items": t.raw("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"))}
    return governance.run_checks(tables, [c("transactions", "unique", "idempotency_key"), c("transactions", "required", "customer_id"), c("transactions", "references", "merchant_id", "merchants"), c("transactions", "references", "customer_id", "customers"), c("merchants", "at_least", least=100), c("indicators", "unique", "txn_id"), c("items", "unique", "item")])


CHECKS = sql.with_tables("t merchants customers fi", """
WITH r AS (
  SELECT 'transactions' AS "table", 'unique' AS kind, 'idempotency_key' AS "column", (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY idempotency_key HAVING count(*) > 1)) AS failures
  UNION ALL SELECT 'transactions', 'required', 'customer_id', (SELECT count(*) FROM t WHERE customer_id IS NULL)
  UNION ALL SELECT 'transactions', 'references', 'merchant_id', (SELECT count(*) FROM t ANTI JOIN merchants USING (merchant_id))
  UNION ALL SELECT 'transactions', 'references', 'customer_id', (SELECT count(*) FROM t ANTI JOIN customers USING (customer_id) WHERE customer_id IS NOT NULL)
  UNION ALL SELECT 'merchants', 'at_least', '', (SELECT greatest(100 - count(*), 0) FROM merchants)
  UNION ALL SELECT 'indicators', 'unique', 'txn_id', (SELECT count(*) FROM (SELECT 1 FROM fi GROUP BY txn_id HAVING count(*) > 1))
  UNION ALL SELECT 'items', 'unique', 'item', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)))
SELECT *, failures = 0 AS passed FROM r""")


def analyst_payment_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment methods as analysts see them: without fingerprints."""
    return governance.analyst_view(Tables(spark, sf_dir).payment_methods)


ANALYST_PAYMENT_METHODS = sql.with_tables("pms", "SELECT pm_id, customer_id, type, brand, last4 FROM pms")


def fraud_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of blocked and reviewed transactions by fraud profile."""
    rows = Tables(spark, sf_dir).scored.withColumn("profile", F.coalesce(F.get_json_object("metadata", "$.fraud_profile"), F.lit("none")))
    out = rows.groupBy("profile").agg(F.count(F.lit(1)).alias("txns"), F.count_if(F.col("decision") == "block").alias("blocked"), F.count_if(F.col("decision") == "review").alias("reviewed"), cents(F.sum("amount")).alias("amount_eur"))
    return out.withColumns({"blocked_pct": ratio("blocked", "txns", 2, 100), "reviewed_pct": ratio("reviewed", "txns", 2, 100)})


FRAUD_PROFILES = sql.with_tables("sc", f"""
WITH x AS (SELECT sc.*, CASE WHEN k >= 87 THEN ['brutal', 'card_testing', 'furtive'][k % 3 + 1] ELSE 'none' END AS profile FROM sc JOIN (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e ON e.event_id = sc.txn_id)
SELECT profile, count(*) AS txns, count(*) FILTER (WHERE decision = 'block') AS blocked, count(*) FILTER (WHERE decision = 'review') AS reviewed, sum(amount)::BIGINT / 100.0 AS amount_eur,
  {sql.ratio("count(*) FILTER (WHERE decision = 'block')", "count(*)", 2, 100)} AS blocked_pct, {sql.ratio("count(*) FILTER (WHERE decision = 'review')", "count(*)", 2, 100)} AS reviewed_pct FROM x GROUP BY profile""")

QUERIES = {
    "etl_daily_extract": (daily_extract, DAILY_EXTRACT),
    "etl_fact": (fact, FACT),
    "dim_date": (dim_date, DIM_DATE),
    "ml_training_set": (training_set, TRAINING_SET),
    "ml_current_window": (current_window, _window(30)),
    "ml_current_window_daily": (current_window_daily, _window(1440)),
    "ml_features": (feature_rows, FEATURE_ROWS),
    "score_rules": (score_rules, SCORE_RULES),
    "score_write_back": (write_back, WRITE_BACK),
    "doc_latest_features": (latest_features, LATEST_FEATURES),
    "doc_online_features": (online_features, ONLINE_FEATURES),
    "changes_merge": (merged_changes, MERGED_CHANGES),
    "data_checks": (checks, CHECKS),
    "gdpr_analyst_view": (analyst_payment_methods, ANALYST_PAYMENT_METHODS),
    "ml_fraud_profiles": (fraud_profiles, FRAUD_PROFILES),
}
