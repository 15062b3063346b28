"""Hourly pre-aggregates with sketches, which merge over any range of hours.

A KLL sketch holds the distribution of durations, HyperLogLog sketches hold
distinct customers, cards and countries. Each is a few KB whatever the number
of rows, and merging hours gives what sketching all their rows at once would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch, and the share of rows by which a quantile's rank may be off with it (with 99 % confidence).
QUANTILE_K, RANK_ERROR = 400, 0.0104
#: Bits of the distinct-count sketch, and the share by which its estimate may be off (three standard errors).
DISTINCT_BITS, DISTINCT_ERROR = 12, 0.05
DISTINCT = ("customers", "cards", "countries")


def hourly(rows: DataFrame) -> DataFrame:
    """Pre-aggregate of rows (created_at, duration_ms, customer_id, fingerprint, ip_country) by hour: requests, total_tenths, durations, customers, cards, countries. Rows without a duration are left out."""
    tenths = F.round(F.col("duration_ms") * 10).cast("bigint")
    known = rows.filter("duration_ms IS NOT NULL").groupBy(F.date_trunc("hour", "created_at").alias("hour"))
    counted = {"customers": F.col("customer_id"), "cards": F.col("fingerprint"), "countries": F.col("ip_country")}
    return known.agg(F.count(F.lit(1)).alias("requests"), F.sum(tenths).alias("total_tenths"), F.kll_sketch_agg_bigint(tenths, QUANTILE_K).alias("durations"), *(F.hll_sketch_agg(c, DISTINCT_BITS).alias(n) for n, c in counted.items()))


def merged(hours: DataFrame, *by: Column | str) -> DataFrame:
    """Hours, or merged hours, of each group merged into one row."""
    return hours.groupBy(*by).agg(F.sum("requests").alias("requests"), F.sum("total_tenths").alias("total_tenths"), F.kll_merge_agg_bigint("durations").alias("durations"), *(F.hll_union_agg(n).alias(n) for n in DISTINCT))


def read_out(sketched: DataFrame, share: float = 0.95) -> DataFrame:
    """Quantile of the durations in milliseconds and distinct counts beside requests and total_tenths."""
    quantile = (F.kll_sketch_get_quantile_bigint("durations", F.lit(share)) / F.lit(10.0)).alias("quantile_ms")
    rest = [c for c in sketched.columns if c not in ("durations", *DISTINCT)]
    return sketched.select(*rest, quantile, *(F.hll_sketch_estimate(n).alias(n) for n in DISTINCT))
