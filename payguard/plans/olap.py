"""Star-schema queries over the stored star. The yearly ones read a star of `orders`, those about fraud one of `events`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payguard.functions.columns import month_of, quarter_of, ratio, share_of_total, year_of
from payguard.operators import star
from payguard.plans import oracle as sql
from payguard.plans import warehouse
from payguard.sources.tables import Tables


def _money(column: str) -> Column:
    return F.sum(column).cast("double")


def region_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = star.between_days(warehouse.facts(warehouse.stored_star(spark, sf_dir, "orders")), 19960101, 19981231)
    rows = facts.join(star.dim_geography(spark), "geo_key")
    rows = rows.withColumns({"year": year_of("date_key"), "quarter": quarter_of("date_key")})
    out = rows.groupBy("region", "year", "quarter").agg(F.count(F.lit(1)).alias("txn_count"), _money("amount_eur").alias("revenue_eur"), _money("fee_amount").alias("fees_eur"), F.count_if("is_fraud").alias("fraud_count"))
    return out.withColumn("fraud_pct", ratio("fraud_count", "txn_count", 3, 100)).orderBy("year", "quarter", F.desc("revenue_eur"))


_FEE = "(((amount * 14 + 5) // 10 + 50) // 100)"  # 1.4 % at four digits, then at two
REGION_QUARTER = sql.with_tables("o geo", f"""
SELECT region, year(created_at)::INT AS year, quarter(created_at)::INT AS quarter, count(*) AS txn_count, sum(amount)::BIGINT / 100.0 AS revenue_eur, sum({_FEE})::BIGINT / 100.0 AS fees_eur, 0::BIGINT AS fraud_count, 0.0::DOUBLE AS fraud_pct
FROM o JOIN geo ON geo.country_code = o.ip_country WHERE status = 'succeeded' AND created_at >= DATE '1996-01-01' AND created_at < DATE '1999-01-01' GROUP BY ALL""")


def payment_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = warehouse.stored_star(spark, sf_dir, "events")
    rows = star.between_days(warehouse.facts(store), 20240101, 20241231).join(store.current("dim_payment_method"), "pm_key")
    score = F.round(F.col("fraud_score") * 10000).cast("bigint")
    out = rows.groupBy("type", "brand", "is_digital_wallet").agg(F.count(F.lit(1)).alias("txn_count"), F.sum((F.col("amount_eur") * 100).cast("bigint")).alias("cents"), F.count_if("is_fraud").alias("fraud_count"), F.sum(score).alias("points"), F.count("fraud_score").alias("scored"))
    return out.select("type", "brand", "is_digital_wallet", "txn_count", (F.col("cents") / 100.0).alias("total_eur"), ratio("cents", F.col("txn_count") * 100, 2).alias("avg_basket_eur"), "fraud_count", ratio("points", F.col("scored") * 10000, 4).alias("avg_fraud_score")).orderBy(F.desc("txn_count"))


PAYMENT_MIX = sql.with_tables("d pms", f"""
SELECT coalesce(type, 'card') AS type, brand, coalesce(type, 'card') = 'wallet' AS is_digital_wallet, count(*) AS txn_count, sum(amount)::BIGINT / 100.0 AS total_eur, {sql.ratio("sum(amount)::BIGINT", "count(*) * 100", 2)} AS avg_basket_eur,
  count(*) FILTER (WHERE fraud_score >= 0.85) AS fraud_count, {sql.ratio("sum(points)::BIGINT", "count(points) * 10000", 4)} AS avg_fraud_score
FROM d LEFT JOIN pms USING (pm_id) WHERE status = 'succeeded' AND year(created_at) = 2024 GROUP BY ALL""")


def country_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = warehouse.facts(warehouse.stored_star(spark, sf_dir, "events"))
    out = facts.join(star.dim_geography(spark), "geo_key").groupBy("is_high_risk", "country_code").agg(F.count(F.lit(1)).alias("txn_count"), F.count_if("is_fraud").alias("fraud_count"))
    return out.withColumns({"share_of_all_fraud": share_of_total("fraud_count"), "share_of_volume": share_of_total("txn_count")}).orderBy(F.desc("fraud_count"), "country_code").limit(20)


COUNTRY_SHARE = sql.with_tables("d geo", """
WITH g AS (SELECT is_high_risk, country_code, count(*) AS txn_count, count(*) FILTER (WHERE fraud_score >= 0.85) AS fraud_count FROM d JOIN geo ON geo.country_code = d.ip_country WHERE status = 'succeeded' GROUP BY ALL)
SELECT *, fraud_count / nullif((SELECT sum(fraud_count)::BIGINT FROM g), 0) AS share_of_all_fraud, txn_count / nullif((SELECT sum(txn_count)::BIGINT FROM g), 0) AS share_of_volume FROM g ORDER BY fraud_count DESC, country_code LIMIT 20""")


def merchant_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = warehouse.stored_star(spark, sf_dir, "orders")
    rows = warehouse.facts(store).filter("status = 'succeeded'").join(store.current("dim_merchant"), "merchant_key")
    rows = rows.withColumns({"year": year_of("date_key"), "month": month_of("date_key")})
    monthly = rows.groupBy("merchant_id", "name", "tier", "year", "month").agg(F.sum((F.col("amount_eur") * 100).cast("bigint")).alias("gmv"))
    by = Window.partitionBy("merchant_id")
    monthly = monthly.withColumns({"prev": F.lag("gmv").over(by.orderBy("year", "month")), "place": F.row_number().over(by.orderBy(F.desc("year"), F.desc("month")))})
    change = F.floor((2000 * F.col("gmv") + F.col("prev")) / F.nullif(2 * F.col("prev"), F.lit(0))) / 10.0 - 100.0
    return monthly.filter("place = 1").select("name", "tier", "year", "month", (F.col("gmv") / 100.0).alias("gmv_eur"), (F.col("prev") / 100.0).alias("prev_month_gmv_eur"), change.alias("mom_growth_pct")).orderBy(F.desc("gmv_eur"), "name").limit(20)


MERCHANT_MOM = sql.with_tables("o merchants", """
WITH m AS (SELECT merchant_id, name, tier, year(o.created_at)::INT AS year, month(o.created_at)::INT AS month, sum(amount)::BIGINT AS gmv FROM o JOIN merchants USING (merchant_id) WHERE o.status = 'succeeded' GROUP BY ALL),
l AS (SELECT *, lag(gmv) OVER (PARTITION BY merchant_id ORDER BY year, month) AS prev FROM m QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY year DESC, month DESC) = 1)
SELECT name, tier, year, month, gmv / 100.0 AS gmv_eur, prev / 100.0 AS prev_month_gmv_eur, ((2000 * gmv + prev) // nullif(2 * prev, 0)) / 10.0 - 100.0 AS mom_growth_pct FROM l ORDER BY gmv_eur DESC, name LIMIT 20""")


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty days of the stored aggregate by day, region and currency."""
    t = Tables(spark, sf_dir)
    first = F.to_date(F.date_trunc("day", t.as_of(t.transactions)) - F.expr("INTERVAL 30 DAYS"))
    out = warehouse.stored_star(spark, sf_dir, "events").current("star_revenue").filter(F.col("full_date") >= first)
    return out.select(F.date_format("full_date", "yyyy-MM-dd").alias("full_date"), "region", "currency", "txn_count", F.col("revenue_eur").cast("double").alias("revenue_eur"), "fraud_count").orderBy(F.desc("full_date"), F.desc("revenue_eur"))


DAILY_REVENUE = sql.with_tables("d geo", """
SELECT strftime(created_at, '%Y-%m-%d') AS full_date, region, currency, count(*) AS txn_count, sum(amount)::BIGINT / 100.0 AS revenue_eur, count(*) FILTER (WHERE fraud_score >= 0.85) AS fraud_count
FROM d JOIN geo ON geo.country_code = d.ip_country WHERE status = 'succeeded' AND created_at::DATE >= (SELECT max(created_at)::DATE FROM d) - 30 GROUP BY ALL""")

QUERIES = {
    "olap_region_quarter": (region_quarter, REGION_QUARTER),
    "olap_payment_mix": (payment_mix, PAYMENT_MIX),
    "olap_country_share": (country_share, COUNTRY_SHARE),
    "olap_merchant_mom": (merchant_mom, MERCHANT_MOM),
    "olap_daily_revenue": (daily_revenue, DAILY_REVENUE),
}
