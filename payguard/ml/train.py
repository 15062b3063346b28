"""Training: weighted boosted trees with an early stop on the newest rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.features import FEATURES
from payguard.ml import store
from payguard.ml.dataset import LEAST_TRAINING, temporal_split, training_set
from payguard.ml.evaluate import evaluate
from payguard.ml.scoring import score_model
from payguard.ml.staged import staged_average_precision


@dataclass(frozen=True)
class TrainConfig:
    """Trees and their least number, below which all rows are trained on without an early stop; the numbers are the reference's."""

    trees: int = 600
    least_trees: int = 100
    first_trees: int = 100
    patience: int = 30
    depth: int = 5
    step: float = 0.05
    subsample: float = 0.8
    validation: float = 0.15
    seed: int = 42


def _classifier(cfg: TrainConfig, trees: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=cfg.depth, stepSize=cfg.step, subsamplingRate=cfg.subsample, featureSubsetStrategy=str(cfg.subsample), seed=cfg.seed)


def best_prefix(averages: list[float], patience: int) -> tuple[int, bool]:
    """How many trees to keep by the average precision after each tree, the first best one's, and whether `patience` trees came after it."""
    best = 0
    for i, x in enumerate(averages):
        if x > averages[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def train(df: DataFrame, cfg: TrainConfig = TrainConfig()) -> tuple[PipelineModel, dict]:
    """Fit on rows with the feature columns, label and created_at; the model and its parameters. Fraud weighs as much as the rest together.

    Trees grow on the oldest rows until `patience` of them have not raised the
    average precision of the newest ones; the trees up to the best one are
    kept. Boosting with one seed gives the same first trees however many
    follow, so it is done for 100 trees, then twice as many, up to the limit.
    If fewer than least_trees are kept, so many are grown on all rows. A
    checkpoint folder cuts the lineage of many trees.
    """
    old, new = temporal_split(df, cfg.validation)
    r = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n")).first()
    weight = r["n"] / r["p"] if r["p"] else 1.0

    def weighted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("weight", F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0)))

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    size, averages, stopped = min(cfg.first_trees, cfg.trees), [], False
    while True:
        model = Pipeline(stages=[assembler, _classifier(cfg, size)]).fit(weighted(old))
        grown = model.stages[-1].getNumTrees
        averages += staged_average_precision(model.stages[-1], new, len(averages), grown)
        best, stopped = best_prefix(averages, cfg.patience)
        if stopped or size >= cfg.trees or grown < size:
            break
        size = min(2 * size, cfg.trees)
    found = {"best_trees": best, "best_average_precision": averages[best - 1], "stopped_early": stopped, "forced_least_trees": best < cfg.least_trees}
    if best < cfg.least_trees:
        model = Pipeline(stages=[assembler, _classifier(cfg, cfg.least_trees)]).fit(weighted(df))
    elif best < grown:
        model = Pipeline(stages=[assembler, _classifier(cfg, best)]).fit(weighted(old))
    return model, found | {"trees": model.stages[-1].getNumTrees, "scale_pos_weight": weight, "depth": cfg.depth, "step": cfg.step, "seed": cfg.seed}


def run_training(spark: SparkSession, transactions: DataFrame, root: str, cfg: TrainConfig = TrainConfig()) -> dict:
    """Train on the oldest four fifths, measure on the rest, store, accept or roll back; the record. Too few rows: skipped."""
    store.use_checkpoints(spark, root)
    df = training_set(transactions).persist()
    try:
        n = df.count()
        if n < LEAST_TRAINING:
            return {"skipped": f"{n} rows, {LEAST_TRAINING} are needed"}
        old, new = temporal_split(df)
        model, params = train(old, cfg)
        meta = params | {"n_train": n - new.count()} | evaluate(score_model(new, model))
        version = store.save(spark, root, model, meta)
        return meta | {"version": version} | store.accept_or_rollback(spark, root, version)
    finally:
        df.unpersist()
