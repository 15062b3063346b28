"""Queries over results that are stored and kept up to date: corrected sums, hourly sketches, series, skew by feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.columns import cents, ratio
from payguard.ml import monitor
from payguard.operators import documents, preagg, sketches, writeback
from payguard.operators.running import new_path, written
from payguard.plans import oracle as sql
from payguard.plans.oltp import stamp
from payguard.sources.snapshots import Snapshots
from payguard.sources.tables import Tables
from payguard.streaming import fanout


def _corrected(spark: SparkSession, sf_dir: str) -> Snapshots:
    """Stored transactions and their maintained sums after a batch of changes: every seventh is deleted, every fifth costs more, every eleventh fails, every thirteenth is in euros now; and after the same batch once more."""
    t = Tables(spark, sf_dir)
    store = Snapshots(spark, new_path(spark, "maintained"))
    rows = t.decided.select("txn_id", "merchant_id", "amount", "currency", "status", "fraud_score", "created_at", F.lit(0).cast("bigint").alias("offset"))
    rows = written(rows, "decided")
    store.commit({"transactions": rows} | preagg.build_maintained(rows), keys=writeback.KEYS | preagg.maintained_keys())
    place = F.col("txn_id")
    changes = rows.filter("txn_id % 7 = 0 OR txn_id % 5 = 0 OR txn_id % 11 = 0 OR txn_id % 13 = 0").withColumns({
        "amount": F.when(place % 5 == 0, F.col("amount") + 100).otherwise(F.col("amount")), "status": F.when(place % 11 == 0, "failed").otherwise(F.col("status")),
        "currency": F.when(place % 13 == 0, "EUR").otherwise(F.col("currency")), "offset": F.lit(1).cast("bigint"), "__deleted": F.when(place % 7 == 0, "true").otherwise("false"),
    })
    for _ in range(2):
        writeback.apply_images(store, "transactions", changes, "txn_id", ("offset",))
    return store


_CHANGED = """
WITH x AS (
  SELECT txn_id, merchant_id, CASE WHEN txn_id % 5 = 0 THEN amount + 100 ELSE amount END AS amount, CASE WHEN txn_id % 11 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN txn_id % 13 = 0 THEN 'EUR' ELSE currency END AS currency, points, created_at
  FROM d WHERE txn_id % 7 <> 0)"""


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored daily aggregate after updates and deletions."""
    rows = _corrected(spark, sf_dir).current("daily_revenue")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "currency", "txn_count", cents("gross_amount_cents").alias("gross_amount"), ratio("score_points", F.col("scored") * 10000, 4).alias("avg_fraud_score"))


DAILY_REVENUE = sql.with_tables("d", f"""{_CHANGED}
SELECT strftime(created_at, '%Y-%m-%d') AS day, currency, count(*) AS txn_count, sum(amount)::BIGINT / 100.0 AS gross_amount, {sql.ratio("sum(points)::BIGINT", "count(points) * 10000", 4)} AS avg_fraud_score
FROM x WHERE status = 'succeeded' GROUP BY ALL""")


def merchant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merchants with their stored sums after updates and deletions."""
    rows = preagg.with_merchants(Tables(spark, sf_dir).merchants, _corrected(spark, sf_dir).current("merchant_sums"))
    return rows.select("merchant_id", "name", "tier", "txn_count", cents("gmv_cents").alias("gmv"), "avg_fraud_score")


MERCHANT_STATS = sql.with_tables("merchants d", f"""{_CHANGED}
SELECT m.merchant_id, m.name, m.tier, count(x.txn_id) AS txn_count, coalesce(sum(x.amount) FILTER (WHERE x.status = 'succeeded'), 0)::BIGINT / 100.0 AS gmv, coalesce({sql.ratio("sum(points)::BIGINT", "count(points) * 10000", 4)}, 0) AS avg_fraud_score
FROM merchants m LEFT JOIN x USING (merchant_id) GROUP BY m.merchant_id, m.name, m.tier""")


def _served(t: Tables) -> DataFrame:
    """Scored rows with what the hourly sketches count."""
    cards = t.payment_methods.select("pm_id", "fingerprint")
    return t.scored.select("created_at", documents.duration_ms(F.col("fraud_score")).alias("duration_ms"), "customer_id", "pm_id", "ip_country").join(cards, "pm_id", "left")


def latency_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's requests and mean from the stored hourly aggregate, and whether what its merged sketches say is as near to the exact values as they promise: the 95th percentile's rank, distinct customers, cards and countries."""
    rows = written(_served(Tables(spark, sf_dir)), "served")
    store = Snapshots(spark, new_path(spark, "hourly"))
    store.commit({"hourly_latency": sketches.hourly(rows)})
    day = F.date_format("hour", "yyyy-MM-dd").alias("day")
    said = sketches.read_out(sketches.merged(store.current("hourly_latency"), day))
    same = [F.count_distinct(c).alias(f"exact_{n}") for n, c in zip(sketches.DISTINCT, ("customer_id", "fingerprint", "ip_country"), strict=True)]
    exact = rows.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    ranks = exact.join(said.select("day", "quantile_ms"), "day").groupBy("day").agg(F.count_if(F.col("duration_ms") < F.col("quantile_ms")).alias("below"), F.count_if(F.col("duration_ms") <= F.col("quantile_ms")).alias("not_above"))
    both = said.join(exact.groupBy("day").agg(*same), "day").join(ranks, "day")
    n, wrong = F.col("requests"), sketches.RANK_ERROR
    rank_ok = (F.col("below") <= (0.95 + wrong) * n) & (F.col("not_above") >= (0.95 - wrong) * n)
    near = [(F.abs(F.col(c) - F.col(f"exact_{c}")) <= F.greatest(F.lit(1.0), F.col(f"exact_{c}") * sketches.DISTINCT_ERROR)).alias(f"{c}_near") for c in sketches.DISTINCT]
    return both.select("day", "requests", ratio("total_tenths", F.col("requests") * 10, 1).alias("avg_ms"), rank_ok.alias("p95_near"), *near)


def _latency_sql() -> str:
    tenths = "((50000 + points * 10) // 1000 + ((50000 + points * 10) % 1000 > 500 OR ((50000 + points * 10) % 1000 = 500 AND ((50000 + points * 10) // 1000) % 2 = 1))::INT)"
    return sql.with_tables("sc", f"""
WITH l AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, {tenths} AS x FROM sc)
SELECT day, count(*) AS requests, {sql.ratio("sum(x)::BIGINT", "count(*) * 10", 1)} AS avg_ms, true AS p95_near, true AS customers_near, true AS cards_near, true AS countries_near FROM l GROUP BY day""")


def minute_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored series of minutes after three batches out of order, the last of which comes twice; every row counts once."""
    rows = written(Tables(spark, sf_dir).scored.select("txn_id", "created_at", "fraud_score", "amount"), "series-rows")
    store, late = Snapshots(spark, new_path(spark, "series")), new_path(spark, "late")
    for number in (0, 1, 2, 2):
        fanout.add_to_series(store, late, rows.filter(F.pmod("txn_id", F.lit(3)) == number), number, "query", 600)
    return store.current("minute_series").withColumn("window_start", stamp("window_start"))


MINUTE_SERIES = sql.with_tables("sc", f"SELECT {sql.when("date_trunc('minute', created_at)")} AS window_start, count(*) AS count, count(*) FILTER (WHERE points >= 8500) AS fraud_count, sum(amount)::BIGINT AS volume_cents FROM sc GROUP BY 1")


def skew_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of which some were served with counts that are off (txn_id % 100 = 5: an hour's by one; = 9: both by two; odd ones by another model, whose day counts are all one too high), against recomputed counts."""
    t = Tables(spark, sf_dir)
    place, odd = F.col("txn_id") % 100, F.col("txn_id") % 2 == 1
    off = t.scored.withColumns({"velocity_1h": F.col("velocity_1h") + F.when(place == 5, 1).when(place == 9, 2).otherwise(0), "velocity_24h": F.col("velocity_24h") + F.when(place == 9, 2).otherwise(0) + odd.cast("int"), "model_version": F.when(odd, "other").otherwise(F.col("model_version"))})
    return monitor.skew_by_feature(documents.to_transaction_logs(off), t.transactions).select("model_version", "feature", "rows", "equal", "distance", "skewed")


SKEW_BY_FEATURE = sql.with_tables("sc", """
WITH r AS (SELECT CASE WHEN txn_id % 2 = 1 THEN 'other' ELSE model_version END AS model_version, velocity_1h, velocity_24h, velocity_1h + CASE txn_id % 100 WHEN 5 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS s1, velocity_24h + CASE txn_id % 100 WHEN 9 THEN 2 ELSE 0 END + txn_id % 2 AS s24 FROM sc),
pairs AS (SELECT model_version, 'velocity_1h' AS feature, s1 AS was, velocity_1h AS now FROM r UNION ALL SELECT model_version, 'velocity_24h', s24, velocity_24h FROM r),
e AS (SELECT model_version, feature, count(*) AS rows, count(*) FILTER (WHERE was = now) AS equal FROM pairs GROUP BY ALL),
c AS (SELECT model_version, feature, v, sum(a) AS a, sum(b) AS b FROM (SELECT model_version, feature, now AS v, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT model_version, feature, was, 0, 1 FROM pairs) GROUP BY ALL),
s AS (SELECT model_version, feature, abs(sum(a) OVER w - sum(b) OVER w) AS gap FROM c WINDOW w AS (PARTITION BY model_version, feature ORDER BY v)),
g AS (SELECT model_version, feature, max(gap)::BIGINT AS gap FROM s GROUP BY ALL)
SELECT model_version, feature, rows, equal, (gap * rows) / (rows * rows) AS distance, (gap * rows) / (rows * rows) > sqrt(-ln(0.025) / 2) * sqrt((rows + rows) / (rows * rows)) AS skewed FROM e JOIN g USING (model_version, feature)""")

QUERIES = {
    "mv_daily_revenue_corrected": (daily_revenue, DAILY_REVENUE),
    "mv_merchant_stats_corrected": (merchant_stats, MERCHANT_STATS),
    "doc_latency_sketched": (latency_sketched, _latency_sql()),
    "stream_minute_series": (minute_series, MINUTE_SERIES),
    "ml_skew_by_feature": (skew_by_feature, SKEW_BY_FEATURE),
}
