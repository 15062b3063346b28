"""Scoring with the current model, or with the rules where there is none."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.functions import rules
from payguard.functions.features import FEATURES, feature_columns


def score_model(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add fraud_score: the model's probability of fraud, four digits."""
    columns = df.columns
    wanted = feature_columns(df.withColumns({f"_{c}": F.col(c) for c in ("velocity_1h", "velocity_24h")}))
    scored = model.transform(wanted).withColumn("fraud_score", F.round(vector_to_array("probability")[1], 4))
    back = {c: F.col(f"_{c}") for c in ("velocity_1h", "velocity_24h")}
    return scored.withColumns(back).select(*[c for c in columns if c != "fraud_score"], "fraud_score")


def score(df: DataFrame, cfg: rules.RuleConfig, model: PipelineModel | None = None, version: str | None = None) -> DataFrame:
    """Add fraud_score, decision, rules_triggered (empty for a model) and model_version."""
    if model is None:
        return rules.score_rules(df, cfg)
    out = score_model(df, model)
    return out.withColumns({"rules_triggered": F.array().cast("array<string>"), "model_version": F.lit(version), "decision": rules.decision(F.col("fraud_score"), cfg)})


__all__ = ["FEATURES", "score", "score_model"]
