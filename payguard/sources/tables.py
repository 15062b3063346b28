"""Operational tables: readers with fixed schemas, and views of the driver's test tables in their shape."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard import schemas
from payguard.functions import rules, velocity
from payguard.functions.columns import fingerprint, has_key, json_boolean
from payguard.sources.snapshots import Snapshots, listed

#: Country codes and currencies of the test views; fixed values.
COUNTRIES = ("FR", "US", "GB", "DE", "ES", "IT", "NL", "BE", "CA", "RU", "NG", "KP", "IR", "VE", "BY", "JP")
CURRENCIES = ("EUR", "USD", "GBP", "JPY", "CAD", "AUD")
#: Thresholds of the test views: a test customer has ten earlier events a day at most.
TEST_RULES = rules.RuleConfig(velocity_1h=2, velocity_24h=5)


def typed(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table of schemas.TABLES in their types; null where df has no such column."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]))


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table of schemas.TABLES in any of Spark's formats, typed, without inference.

    Where the path is ROOT/<table> of a versioned root, the table's last
    committed version is read, so all jobs can share one root. A folder that
    holds other folders alone is no table, and an error.
    """
    if fmt == "parquet" and "," not in path:
        root, _, leaf = path.rstrip("/").rpartition("/")
        if leaf in (store := Snapshots(spark, root)).names():
            return typed(store.current(leaf), name)
        there = [n for n in listed(spark, path) if not n.startswith((".", "_"))]
        if there and all("." not in n and "=" not in n for n in there):
            raise ValueError(f"{path} holds folders and no table")
    return spark.read.format(fmt).schema(schemas.TABLES[name]).options(**options).load(path)


def read_jdbc(spark: SparkSession, name: str, url: str, key: str, lower: int, upper: int, partitions: int = 64, **options: str) -> DataFrame:
    """A table of a relational store, read in key ranges by many tasks. Needs the store's driver on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(name, url, key, lower, upper, partitions), **options).load()


def jdbc_options(name: str, url: str, key: str, lower: int, upper: int, partitions: int = 64) -> dict[str, str]:
    """Options of a read in key ranges; the ranges' ends are no filter, so rows outside are read too."""
    return {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}


def _pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at a place (from 0, modulo their number)."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


class Tables:
    """The operational tables over one folder of test tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def merchants(self) -> DataFrame:
        place = F.col("s_suppkey") % 10
        return self.raw("supplier").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("name"), _pick(COUNTRIES, F.col("s_nationkey")).alias("country_code"), F.when(place < 6, "standard").when(place < 9, "premium").otherwise("enterprise").alias("tier"), F.lit("active").alias("status"))

    @cached_property
    def customers(self) -> DataFrame:
        place = F.col("c_custkey") % 20
        segment = F.when(place < 3, "premium").when(place < 13, "standard").when(place < 18, "new").otherwise("inactive")
        return self.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")).alias("email"), F.col("c_name").alias("name"), _pick(COUNTRIES, F.col("c_nationkey")).alias("country_code"), segment.alias("segment"))

    @cached_property
    def payment_methods(self) -> DataFrame:
        rows = self.raw("customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        rows = rows.select((F.col("c_custkey") * 2 + F.col("k")).alias("pm_id"), F.col("c_custkey").alias("customer_id"))
        kind = F.when(F.col("pm_id") % 20 < 17, "card").when(F.col("pm_id") % 20 < 19, "wallet").otherwise("bank_transfer")
        rows = rows.withColumn("type", kind)
        card = F.col("type") == "card"
        brand = _pick(("visa", "mastercard", "amex", "cb"), F.col("pm_id"))
        return rows.withColumns({"brand": F.when(card, brand), "last4": F.when(card, F.lpad((F.col("pm_id") % 10000).cast("string"), 4, "0")), "fingerprint": F.when(card, fingerprint("pm_id"))})

    @cached_property
    def merchant_count(self) -> int:
        """Rows of the merchants table; one number, which the test views deal transactions by."""
        return self.raw("supplier").count()

    @cached_property
    def transactions(self) -> DataFrame:
        """Card traffic, from `events`; fraud_score is null, as before scoring."""
        event = F.col("event_id")
        k = F.get_json_object("props", "$.k").cast("bigint")
        amount = F.round(F.col("value") * 100).cast("bigint") * F.when(event % 11 == 0, 10).otherwise(1)
        device = F.when(F.col("event_type") == "purchase", "pos").when(F.col("event_type") == "view", "desktop").when(F.col("event_type") == "signup", "tablet").otherwise("mobile")
        profile = F.when(k >= 87, _pick(("brutal", "card_testing", "furtive"), k))
        shown = F.to_json(F.struct((k >= 87).alias("is_fraud_pattern"), profile.alias("fraud_profile")))
        hidden = F.to_json(F.struct(profile.alias("fraud_profile")))
        return self.raw("events").select(event.alias("txn_id"), (event % self.merchant_count).alias("merchant_id"), F.when(event % 97 != 0, F.col("user_id")).alias("customer_id"), (F.col("user_id") * 2 + event % 2).alias("pm_id"), amount.alias("amount"), _pick(CURRENCIES, event).alias("currency"), F.when(event % 10 == 3, "failed").otherwise("succeeded").alias("status"), F.concat(F.lit("key-"), event).alias("idempotency_key"), device.alias("device_type"), _pick(COUNTRIES, k).alias("ip_country"), F.when(event % 50 == 7, hidden).otherwise(shown).alias("metadata"), F.col("ts").cast("timestamp").alias("created_at"))

    @cached_property
    def orders(self) -> DataFrame:
        """Traffic over years, from `orders`; without scores."""
        order = F.col("o_orderkey")
        amount = F.round(F.col("o_totalprice") * 100).cast("bigint") % 200_000
        return self.raw("orders").select(order.alias("txn_id"), (order % self.merchant_count).alias("merchant_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_custkey") * 2 + order % 2).alias("pm_id"), amount.alias("amount"), _pick(CURRENCIES, order).alias("currency"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"), _pick(COUNTRIES, order).alias("ip_country"), F.lit("desktop").alias("device_type"), F.col("o_orderdate").cast("timestamp").alias("created_at"))

    @property
    def known(self) -> DataFrame:
        """Transactions that have a customer."""
        return self.transactions.filter("customer_id IS NOT NULL")

    @cached_property
    def scored(self) -> DataFrame:
        """Transactions that have a customer, with velocity, score and decision."""
        return rules.score_rules(velocity.served(self.known), TEST_RULES)

    def scored_since(self, start: Column) -> DataFrame:
        """`scored` from an instant on. Velocity looks back a day, so a day more is read, and no more than that is scored."""
        rows = self.known.filter(F.col("created_at") >= start - F.expr("INTERVAL 1 DAY"))
        return rules.score_rules(velocity.served(rows), TEST_RULES).filter(F.col("created_at") >= start)

    @cached_property
    def decided(self) -> DataFrame:
        """All transactions, with the score that was written back; null without a customer."""
        return self.scored.unionByName(self.transactions.filter("customer_id IS NULL"), allowMissingColumns=True)

    def decided_since(self, start: Column) -> DataFrame:
        """`decided` from an instant on."""
        rest = self.transactions.filter("customer_id IS NULL").filter(F.col("created_at") >= start)
        return self.scored_since(start).unionByName(rest, allowMissingColumns=True)

    @cached_property
    def indicators(self) -> DataFrame:
        """One row for each transaction to review or block."""
        return self.indicators_of(self.scored)

    @staticmethod
    def indicators_of(scored: DataFrame) -> DataFrame:
        return rules.alerts(scored).select(F.col("txn_id").alias("fraud_id"), "txn_id", F.col("fraud_score").alias("anomaly_score"), "rules_triggered", "model_version", "decision", "created_at")

    @cached_property
    def refunds(self) -> DataFrame:
        rows = self.transactions.filter("txn_id % 25 = 0")
        return rows.select(F.col("txn_id").alias("refund_id"), "txn_id", F.floor(F.col("amount") / 2).alias("amount"), F.lit("requested").alias("reason"), F.when(F.col("txn_id") % 50 == 0, "pending").otherwise("succeeded").alias("status"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))

    def before(self, df: DataFrame, interval: str) -> Column:
        """The instant `interval` before the latest created_at of df."""
        return self.as_of(df) - F.expr(f"INTERVAL {interval}")

    def as_of(self, df: DataFrame) -> Column:
        """The latest created_at of df, as a scalar subquery: the `now` of queries over stored data."""
        return df.agg(F.max("created_at")).scalar()


def truth(df: DataFrame) -> DataFrame:
    """Rows whose metadata carries the label, with is_fraud (null where it is no boolean)."""
    return df.filter(has_key("metadata", "is_fraud_pattern")).withColumn("is_fraud", json_boolean("metadata", "is_fraud_pattern"))
