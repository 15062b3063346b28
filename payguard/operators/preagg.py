"""Pre-aggregates: results that a job refreshes whole, or that every change of their rows corrects. Averages are kept as sums and counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.functions.columns import day_of, ratio
from payguard.operators.running import written
from payguard.sources.snapshots import Snapshots


def daily_revenue(decided: DataFrame) -> DataFrame:
    """Successful transactions by day and currency. score_points and scored give the average score at any grain."""
    points = F.round(F.col("fraud_score") * 10000).cast("bigint")
    return decided.filter("status = 'succeeded'").groupBy(F.to_date("created_at").alias("day"), "currency").agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("gross_amount_cents"), F.sum(points).alias("score_points"), F.count("fraud_score").alias("scored"))


def star_revenue(fact: DataFrame, geography: DataFrame) -> DataFrame:
    """Successful facts by day, region and currency: full_date, region, currency, txn_count, revenue_eur, fraud_count. Facts of an unknown place have no region and are left out."""
    rows = fact.filter("status = 'succeeded'").join(geography.select("geo_key", "region"), "geo_key")
    out = rows.groupBy("date_key", "region", "currency").agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount_eur").cast("decimal(28,2)").alias("revenue_eur"), F.count_if("is_fraud").alias("fraud_count"))
    return out.select(day_of("date_key").alias("full_date"), "region", "currency", "txn_count", "revenue_eur", "fraud_count")


def merchant_sums(decided: DataFrame) -> DataFrame:
    """Transactions by merchant: txn_count, gmv_cents of successful ones, points and scored, which give the average score."""
    points = F.round(F.col("fraud_score") * 10000).cast("bigint")
    return decided.filter("merchant_id IS NOT NULL").groupBy("merchant_id").agg(F.count(F.lit(1)).alias("txn_count"), F.sum(F.when(F.col("status") == "succeeded", F.col("amount"))).alias("gmv_cents"), F.sum(points).alias("points"), F.count("fraud_score").alias("scored"))


def with_merchants(merchants: DataFrame, sums: DataFrame) -> DataFrame:
    """All merchants with their merchant_sums(), also those without a transaction: 0 and an average score of 0."""
    rows = merchants.select("merchant_id", "name", "tier").join(sums, "merchant_id", "left")
    zero = {"txn_count": F.coalesce("txn_count", F.lit(0)), "gmv_cents": F.coalesce("gmv_cents", F.lit(0))}
    return rows.withColumns(zero | {"avg_fraud_score": F.coalesce(ratio("points", F.col("scored") * 10000, 4), F.lit(0.0))}).drop("points", "scored")


def merchant_stats(merchants: DataFrame, decided: DataFrame) -> DataFrame:
    """with_merchants() of the transactions."""
    return with_merchants(merchants, merchant_sums(decided))


def refresh(store: Snapshots, tables: dict[str, DataFrame]) -> int:
    """Replace the stored results; readers see the old ones until all new ones are there."""
    return store.commit(tables)


@dataclass(frozen=True)
class Maintained:
    """An aggregate of transactions by some columns whose other columns are sums or counts, the first of which counts rows."""

    rows: Callable[[DataFrame], DataFrame]
    by: tuple[str, ...]

    def sums(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in (*self.by, CELL)]

    def keyed(self, df: DataFrame) -> DataFrame:
        """With the group as one column, which the stored table has as its key."""
        return df.withColumn(CELL, F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in self.by))))


CELL = "cell"
MAINTAINED = {"daily_revenue": Maintained(daily_revenue, ("day", "currency")), "merchant_sums": Maintained(merchant_sums, ("merchant_id",))}


def build_maintained(transactions: DataFrame) -> dict[str, DataFrame]:
    """First contents of the maintained tables; commit them with the keys maintained_keys()."""
    return {name: m.keyed(m.rows(transactions)) for name, m in MAINTAINED.items()}


def maintained_keys() -> dict[str, str]:
    return dict.fromkeys(MAINTAINED, CELL)


def maintain(store: Snapshots) -> int:
    """Build the maintained tables of a root's transactions; from then on every change of rows corrects them. If rows change meanwhile, they are built again."""

    def step(base: int) -> int:
        return store.commit(build_maintained(store.current("transactions", base)), base, keys=maintained_keys(), unchanged=("transactions",))

    return store.retry(step)


def signed(m: Maintained, old: DataFrame, new: DataFrame) -> DataFrame:
    """What a change of rows adds to each group: sums over the new images less those over the old ones. Groups that stay as they are are left out."""
    before, after = m.rows(old), m.rows(new)
    sums = m.sums(after)
    less = before.select(*m.by, *((-F.col(c)).alias(c) for c in sums))
    both = after.unionByName(less).groupBy(*m.by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(after.schema[c].dataType).alias(c) for c in sums))
    return m.keyed(both.filter(" OR ".join(f"{c} <> 0" for c in sums)))


def corrections(store: Snapshots, old: DataFrame, new: DataFrame, base: int) -> dict[str, DataFrame]:
    """Changes of the maintained tables that version `base` has, for rows whose images `old` become `new`; commit them with the rows. A group without rows left is removed."""
    out = {}
    for name, m in MAINTAINED.items():
        if name not in store.names(base):
            continue
        delta = written(signed(m, old, new), "corrections")  # as many rows as groups are touched
        kept = store.rows_of(name, delta, base)
        sums = m.sums(delta)
        both = kept.unionByName(delta.select(*kept.columns)).groupBy(CELL, *m.by).agg(*(F.sum(c).cast(delta.schema[c].dataType).alias(c) for c in sums))
        out[name] = both.withColumn("_deleted", F.col(sums[0]) == 0)
    return out
