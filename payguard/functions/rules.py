"""Additive fraud rules and the decision, as column expressions.

Scores are sums of basis points, so 0.1 + 0.35 + 0.40 is 0.85 exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds and points (of 10,000) of the rules. The defaults are fixed values that results depend on."""

    base: int = 1000
    high_amount: int = 100_000
    small_amount: int = 200
    small_devices: tuple[str, ...] = ("pos", "mobile")
    risky_countries: tuple[str, ...] = ("RU", "NG", "KP", "IR", "VE", "BY")
    velocity_1h: int = 10
    velocity_24h: int = 50
    points: tuple[int, int, int, int, int] = (3500, 1500, 4000, 2500, 1500)
    review: int = 6000
    block: int = 8500
    model_version: str = "rule-based-v1"


#: Rule names, in the order of RuleConfig.points; fixed values.
NAMES = ("R1_high_amount", "R2_card_testing", "R3_high_risk_geo", "R4_velocity_1h", "R5_velocity_24h")


def conditions(cfg: RuleConfig) -> tuple[Column, ...]:
    """Whether each rule fires; false where a value that it needs is null."""
    amount = F.coalesce(F.col("amount"), F.lit(0))
    found = (
        amount > cfg.high_amount,
        (amount > 0) & (amount < cfg.small_amount) & F.col("device_type").isin(*cfg.small_devices),
        F.col("ip_country").isin(*cfg.risky_countries),
        F.col("velocity_1h") > cfg.velocity_1h,
        F.col("velocity_24h") > cfg.velocity_24h,
    )
    return tuple(F.coalesce(c, F.lit(False)) for c in found)


def decision(score: Column, cfg: RuleConfig) -> Column:
    """block, review or allow for a score between 0 and 1."""
    points = F.round(score * 10000)
    return F.when(points >= cfg.block, "block").when(points >= cfg.review, "review").otherwise("allow")


def score_rules(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Add fraud_score (double), decision, rules_triggered and model_version to rows that have amount, device_type, ip_country, velocity_1h and velocity_24h."""
    fired = conditions(cfg)
    total = sum((F.when(c, F.lit(p)).otherwise(F.lit(0)) for c, p in zip(fired, cfg.points, strict=True)), F.lit(cfg.base))
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in zip(fired, NAMES, strict=True))))
    df = df.withColumns({"fraud_score": F.least(total, F.lit(10000)) / F.lit(10000.0), "rules_triggered": names, "model_version": F.lit(cfg.model_version)})
    return df.withColumn("decision", decision(F.col("fraud_score"), cfg))


def alerts(df: DataFrame) -> DataFrame:
    """Rows to review or block."""
    return df.filter(F.col("decision").isin("review", "block"))
