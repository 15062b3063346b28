"""Drift between two samples: Smirnov's two-sample test on exact values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.operators.running import prefix_sums, written


def values() -> dict[str, Column]:
    """Feature and its exact whole-number value; amounts stand for their logarithm, which keeps their order."""
    return {
        "amount_log": F.greatest(F.coalesce(F.col("amount"), F.lit(0)), F.lit(0)).cast("bigint"),
        "is_high_risk_country": F.col("is_high_risk_country").cast("bigint"),
        "is_pos_device": F.col("is_pos_device").cast("bigint"),
        "velocity_1h": F.col("velocity_1h").cast("bigint"),
        "velocity_24h": F.col("velocity_24h").cast("bigint"),
    }


def distances(counts: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Smirnov's distance of two samples in each group, from counts (by..., value, a, b) of equal values: by..., distance, critical (at level alpha), n_reference, n_current, drifted.

    Cumulative counts over the distinct values are range-dealt, so no task holds all values of a group.
    """
    counts = written(counts, "drift-counts")
    sums, totals = prefix_sums(counts, by, ["value"], {"a_before": F.col("a"), "b_before": F.col("b")}, "drift")
    sums = sums.join(F.broadcast(totals.withColumnsRenamed({"a_before": "n_reference", "b_before": "n_current"})), by)  # a row for each group
    sums = sums.withColumns({c: F.col(c).cast("double") for c in ("a", "b", "a_before", "b_before")})  # products of counts pass 64 bits
    gap = F.abs((F.col("a_before") + F.col("a")) * F.col("n_current") - (F.col("b_before") + F.col("b")) * F.col("n_reference"))
    out = sums.groupBy(*by).agg(F.max(gap).alias("gap"), F.max("n_reference").alias("n_reference"), F.max("n_current").alias("n_current"))
    area = F.nullif(F.col("n_reference").cast("double") * F.col("n_current"), F.lit(0.0))
    level = math.sqrt(-math.log(alpha / 2) / 2)
    out = out.withColumns({"distance": F.coalesce(F.col("gap") / area, F.lit(0.0)), "critical": F.lit(level) * F.sqrt((F.col("n_reference") + F.col("n_current")) / area)})
    return out.select(*by, "distance", "critical", "n_reference", "n_current", F.coalesce(F.col("distance") > F.col("critical"), F.lit(False)).alias("drifted"))


def drift(reference: DataFrame, current: DataFrame, alpha: float = 0.05, columns: dict[str, Column] | None = None) -> DataFrame:
    """One row for each behavioural feature: distance (between the distributions), critical (at level alpha), n_reference, n_current, drifted.

    For a flag the distance is the total variation, too.
    """
    names = columns or values()
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), c.alias("value")) for k, c in names.items()))).alias("x")
    both = reference.select(pairs, F.lit(1).alias("r")).unionByName(current.select(pairs, F.lit(0).alias("r"))).select("x.*", "r")
    return distances(both.groupBy("feature", "value").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b")), ["feature"], alpha)


def summary(rows: DataFrame) -> dict:
    """drift_share, dataset_drift, drifted_columns and columns_tested of drift() rows; a row for each feature reaches the driver."""
    found = rows.orderBy("feature").collect()
    share = sum(r["drifted"] for r in found) / len(found) if found else 0.0
    return {"drift_share": share, "dataset_drift": share >= 0.5, "drifted_columns": sum(r["drifted"] for r in found), "columns_tested": [r["feature"] for r in found]}
