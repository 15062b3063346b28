"""Model monitoring: served performance, drift, reasons, retraining; one record for each cycle."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.columns import confusion_counts, has_key, json_boolean
from payguard.ml import drift as drifts
from payguard.ml import store
from payguard.ml.dataset import LEAST_TRAINING, LEAST_WINDOW, current_window, temporal_split, training_set
from payguard.ml.train import TrainConfig, run_training
from payguard.operators.running import written

RECORD = "checked_at timestamp, model_version string, status string, reason string, drift struct<drift_share: double, dataset_drift: boolean, drifted_columns: int, columns_tested: array<string>>, n_reference bigint, n_current bigint, performance struct<precision: double, recall: double, f1: double, n: bigint>, performance_skipped string, alert_reasons array<string>, retrain_triggered boolean, retrain_skipped_reason string, model_metric_before double, model_metric_after double, rolled_back boolean"


@dataclass(frozen=True)
class MonitorConfig:
    minutes: int = 30
    drift_share: float = 0.3
    least_recall: float = 0.7
    least_precision: float = 0.5
    interval_seconds: int = 120
    cooldowns: int = 3


def served_rows(logs: DataFrame, version: str | None = None) -> DataFrame:
    """Log rows whose truth is known: is_fraud and predicted (block)."""
    meta = F.col("payload.metadata")
    rows = logs.filter(has_key(meta, "is_fraud_pattern")) if version is None else logs.filter((F.col("payload.model_version") == version) & has_key(meta, "is_fraud_pattern"))
    return rows.select("created_at", json_boolean(meta, "is_fraud_pattern").alias("is_fraud"), (F.col("payload.decision") == "block").alias("predicted"))


def rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 beside n, tp, fp, fn; 0 where a denominator is."""

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)})


def served_performance(logs: DataFrame, version: str | None, as_of: datetime, minutes: int, least: int = LEAST_WINDOW) -> dict | None:
    """precision, recall, f1 and n of what was decided in the last minutes; None with fewer than `least` rows."""
    rows = served_rows(logs, version).filter((F.col("created_at") > F.lit(as_of - timedelta(minutes=minutes))) & (F.col("created_at") <= F.lit(as_of)))
    r = rates(rows.agg(*confusion_counts())).first()
    return {k: r[k] for k in ("precision", "recall", "f1", "n")} if r["n"] >= least else None


def reasons(share: float, performance: dict | None, has_model: bool, cfg: MonitorConfig) -> list[str]:
    """Why a cycle is an alert; empty where it is not."""
    out = []
    if share > cfg.drift_share:
        out.append(f"drift_share {share:.2f} over {cfg.drift_share}")
    if performance is not None and performance["recall"] < cfg.least_recall:
        out.append(f"recall {performance['recall']:.2f} under {cfg.least_recall}")
    if performance is not None and performance["precision"] < cfg.least_precision:
        out.append(f"precision {performance['precision']:.2f} under {cfg.least_precision}")
    if not has_model:
        out.append("no trained model")
    return out


def monitor_once(spark: SparkSession, transactions: DataFrame, logs: DataFrame, root: str, as_of: datetime, version: str | None, last_retrain: datetime | None = None, cfg: MonitorConfig = MonitorConfig(), training: TrainConfig = TrainConfig()) -> DataFrame:
    """One cycle as one RECORD row; append it to the monitoring table. It may retrain, with a rollback where that is worse."""
    store.use_checkpoints(spark, root)
    known = transactions.filter(F.col("created_at") <= F.lit(as_of))
    record = dict.fromkeys(f.name for f in spark.createDataFrame([], RECORD).schema) | {"checked_at": as_of, "model_version": version, "alert_reasons": [], "retrain_triggered": False}
    reference, _ = temporal_split(training_set(known))
    current = current_window(known, F.lit(as_of), cfg.minutes)
    record |= {"n_reference": reference.count(), "n_current": current.count()}
    if record["n_reference"] < LEAST_TRAINING or record["n_current"] < LEAST_WINDOW:
        return spark.createDataFrame([record | {"status": "skipped", "reason": "too few rows"}], RECORD)
    record["drift"] = drifts.summary(drifts.drift(reference, current))
    record["performance"] = served_performance(logs, version, as_of, cfg.minutes)
    if record["performance"] is None:
        record["performance_skipped"] = "no trained model" if version is None else "too few served rows"
    found = reasons(record["drift"]["drift_share"], record["performance"], version is not None, cfg)
    record |= {"status": "alert" if found else "ok", "alert_reasons": found}
    if found:
        if last_retrain is not None and (as_of - last_retrain).total_seconds() <= cfg.cooldowns * cfg.interval_seconds:
            record["retrain_skipped_reason"] = "cooldown"
        else:
            done = run_training(spark, known, root, training)
            record["retrain_triggered"] = True
            record |= {k: done.get(k) for k in ("model_metric_before", "model_metric_after", "rolled_back")}
    return spark.createDataFrame([record], RECORD)


def skew(logs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Served velocity against the one recomputed from all transactions: rows, equal_1h, equal_24h."""
    from payguard.functions.velocity import served

    again = served(transactions.filter("customer_id IS NOT NULL")).select("txn_id", "velocity_1h", "velocity_24h")
    both = logs.select("txn_id", "payload.velocity_1h", "payload.velocity_24h").toDF("txn_id", "s1", "s24").join(again, "txn_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("s1") == F.col("velocity_1h")).alias("equal_1h"), F.count_if(F.col("s24") == F.col("velocity_24h")).alias("equal_24h"))


def skew_by_feature(logs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Distributions of served against recomputed velocity, of the same transactions, for each model version and feature: rows, equal, distance, critical, skewed.

    Transactions are joined one to one, so equal counts tell of single rows
    and the distance of the distribution that the model saw. A transaction
    that was logged more than once counts with its least log row.
    """
    from payguard.functions.velocity import served

    names = ("velocity_1h", "velocity_24h")
    again = served(transactions.filter("customer_id IS NOT NULL")).select("txn_id", *(F.col(n).alias(f"now_{n}") for n in names))
    once = logs.groupBy("txn_id").agg(F.min(F.struct("payload.model_version", *(f"payload.{n}" for n in names))).alias("x")).select("txn_id", "x.*")
    both = once.join(again, "txn_id")
    pair = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("bigint").alias("was"), F.col(f"now_{n}").cast("bigint").alias("now")) for n in names))
    rows = written(both.select(F.coalesce("model_version", F.lit("")).alias("model_version"), F.inline(pair)), "skew")
    sides = rows.select("model_version", "feature", F.explode(F.array(F.struct(F.col("now").alias("value"), F.lit(1).alias("r")), F.struct(F.col("was").alias("value"), F.lit(0).alias("r")))).alias("x")).select("model_version", "feature", "x.*")
    counts = sides.filter("value IS NOT NULL").groupBy("model_version", "feature", "value").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    equal = rows.groupBy("model_version", "feature").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("was") == F.col("now")).alias("equal"))
    found = drifts.distances(counts, ["model_version", "feature"]).withColumnRenamed("drifted", "skewed")
    return equal.join(found, ["model_version", "feature"]).select("model_version", "feature", "rows", "equal", "distance", "critical", "skewed")


def consistency(logs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Scored transactions without a log row, log rows without a transaction, transactions logged more than once."""
    scored = transactions.filter("fraud_score IS NOT NULL").select("txn_id")
    missing = scored.join(logs.select("txn_id"), "txn_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    orphans = logs.select("txn_id").join(transactions.select("txn_id"), "txn_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    double = logs.groupBy("txn_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("double"))
    return missing.crossJoin(orphans).crossJoin(double)  # one row each
