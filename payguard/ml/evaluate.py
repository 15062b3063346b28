"""Exact classification measures on distributed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payguard.functions.columns import confusion_counts


def confusion(df: DataFrame, threshold: float, score: str = "fraud_score", label: str = "label") -> dict[str, float]:
    """Counts, precision, recall and F1 at a threshold; 0 where a denominator is."""
    r = df.select((F.col(score) >= threshold).alias("predicted"), (F.col(label) == 1).alias("is_fraud")).agg(*confusion_counts()).first()
    precision, recall = r["tp"] / max(1, r["tp"] + r["fp"]), r["tp"] / max(1, r["tp"] + r["fn"])
    return {"n": r["n"], "tp": r["tp"], "fp": r["fp"], "fn": r["fn"], "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}


def ranking(df: DataFrame, score: str = "fraud_score", label: str = "label", digits: int = 4) -> DataFrame:
    """ROC AUC and average precision (a step sum), exact with ties, in one row: roc_auc, average_precision.

    Scores are grouped first, to `digits`: the windows see one row for each
    distinct score, 10**digits + 1 at most, whatever the number of rows.
    Counts are doubles, exact to 2**53, as their products pass 64 bits.
    """
    grouped = df.groupBy(F.round(score, digits).alias("s")).agg(F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count_if(F.col(label) != 1).cast("double").alias("n"))
    down = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    c = grouped.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    total = c.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum((F.col("tp") - F.col("p") / 2) * F.col("n")).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    return total.select((F.col("area") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("roc_auc"), (F.col("steps") / F.nullif(F.col("P"), F.lit(0))).alias("average_precision"))


def evaluate(scored: DataFrame, block: float = 0.85) -> dict[str, float]:
    """Measures at 0.5 and at the block threshold, and of the ranking."""
    half, high, rank = confusion(scored, 0.5), confusion(scored, block), ranking(scored).first()
    return {"n_test": half["n"], "n_test_fraud": half["tp"] + half["fn"], "precision": half["precision"], "recall": half["recall"], "f1": half["f1"], "precision_at_block": high["precision"], "recall_at_block": high["recall"], "f1_at_block": high["f1"], "roc_auc": rank["roc_auc"], "average_precision": rank["average_precision"]}


def precision_at_base_rate(recall: float, false_positive_rate: float, base_rate: float) -> float:
    """Precision that the same recall and false-positive rate give where fraud is as frequent as base_rate."""
    hits = recall * base_rate
    return hits / (hits + false_positive_rate * (1 - base_rate)) if hits else 0.0
