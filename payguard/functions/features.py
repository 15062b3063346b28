"""The feature columns that training and serving share."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.functions.rules import RuleConfig

#: Order of the feature vector; a fixed value.
FEATURES = ("amount_log", "hour_of_day", "day_of_week", "is_high_risk_country", "is_pos_device", "velocity_1h", "velocity_24h")
#: Features whose drift matters; calendar features always differ between windows.
BEHAVIOURAL = ("amount_log", "is_high_risk_country", "is_pos_device", "velocity_1h", "velocity_24h")


def feature_columns(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Add the FEATURES as floats; null inputs count as 0 or not risky."""
    flag = {"is_high_risk_country": F.col("ip_country").isin(*cfg.risky_countries), "is_pos_device": F.col("device_type") == "pos"}
    number = {"amount_log": F.log1p(F.coalesce(F.col("amount"), F.lit(0)).cast("double")), "hour_of_day": F.hour("created_at"), "day_of_week": F.weekday("created_at"), "velocity_1h": F.col("velocity_1h"), "velocity_24h": F.col("velocity_24h")}
    columns = number | {k: F.coalesce(c, F.lit(False)).cast("int") for k, c in flag.items()}
    return df.withColumns({k: F.coalesce(columns[k].cast("float"), F.lit(0.0).cast("float")) for k in FEATURES})


def assemble(df: DataFrame, output: str = "features") -> DataFrame:
    """The FEATURES as one vector."""
    return VectorAssembler(inputCols=list(FEATURES), outputCol=output).transform(df)
