"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of word hashes (whole words and word beginnings) is learned from one
part of the labelled rows; trees and the calibration are fitted on the others,
so that lexicon features are as strong in training as they are elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm.common import as_row, bound_batches, free_name, materialize, text_slices
from payguard.llm.labels import labelled_texts, remainder, sample_labels
from payguard.llm.lexicon import features, units
from payguard.llm.textstats import Batch, column_of

#: Labelled rows that the model is fitted on, at most (on average, as rows are chosen by hash).
SAMPLE = 12_000
#: Entries of the lexicon, at most.
LEXICON = 2_000


def _unit_counts(rows: DataFrame) -> DataFrame:
    """Documents, and toxic ones, of each unit. rows: text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            b = Batch(batch["text"])
            label = batch["label"].to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(b.n)), b.n)
            pairs = [np.unique(np.stack([u[u > 0], row[u > 0].astype(np.uint64)]), axis=1) for u in units(*b.plain())]
            unit, owner = np.concatenate(pairs, axis=1)
            value, inverse = np.unique(unit, return_inverse=True)
            docs, bad = np.bincount(inverse, minlength=len(value)), np.bincount(inverse, weights=label[owner.astype(np.int64)], minlength=len(value))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(bad.astype(np.int64))], ["unit", "docs", "bad"])

    return rows.select("text", "label").mapInArrow(run, "unit bigint, docs bigint, bad bigint").groupBy("unit").agg(F.sum("docs").alias("docs"), F.sum("bad").alias("bad"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of the `size` units that speak most for label 1."""
    n, bad = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    bad = bad or 0
    least = max(3, bad // 150)
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("docs") - F.col("bad") + 0.5) / F.lit(n - bad + 1.0))
    top = _unit_counts(rows).filter(F.col("bad") >= least).withColumn("odds", odds).filter("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "unit").limit(size).collect()
    value = np.array([r["unit"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], np.array([r["odds"] for r in top], np.float64)[order]


#: Columns of the scorer's own; documents' columns lie in a struct beside them, so none can clash.
_COLUMNS = {"featuresCol": "features", "labelCol": "label", "predictionCol": "tree_label"}


@dataclass
class Model:
    """A fitted scorer. Without labels of both kinds, trees and calibration are None and base, the share of label 1, is every text's score."""

    lexicon: np.ndarray
    weight: np.ndarray
    trees: object
    calibration: object
    base: float

    def with_score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """docs with a column `name` (with underscores after it where docs has that): the calibrated score, 0 to 1.

        All columns of docs stay, whatever their names. Null and empty texts
        have zero features and get the score of those; equal texts get equal
        scores; repeated rows stay; an empty table stays empty.
        """
        bound_batches(docs.sparkSession)
        name = free_name(docs, name)
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.base))
        rows = docs.select(as_row(docs), array_to_vector(_column(self.lexicon, self.weight)).alias("features"))
        scored = self.calibration.transform(_raw(self.trees, rows))
        return scored.select("row.*", F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)).alias(name))


def _column(lexicon: np.ndarray, weight: np.ndarray) -> Column:
    return column_of(lambda text: features(text, lexicon, weight))(F.col("text"))


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """rows with raw, the trees' probability."""
    return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])


def _grow(rows: DataFrame) -> GBTClassificationModel:
    return GBTClassifier(**_COLUMNS, maxIter=20, maxDepth=3, stepSize=0.3, seed=7).fit(rows.repartition(4, "doc_id").sortWithinPartitions("doc_id"))


def _calibrate(scored: DataFrame) -> IsotonicRegressionModel:
    """The isotonic fit of labels on raw scores."""
    return IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(scored.select("label", "raw"))


#: Toxic rows from which on a fifth of the sample is set apart for the calibration.
ENOUGH = 100


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most about `sample` labelled rows. docs: doc_id, text; labels: doc_id, toxic; usable: which label rows may be learned from.

    The lexicon comes from one half of the rows, the trees from the other,
    and the calibration always is isotonic, on scores of rows that those
    trees have not seen: with ENOUGH toxic rows a part set apart, with fewer
    the scores that two trees, each from half of the rows, give the other
    half. Where a half lacks one of the labels all steps use all rows. Null
    texts count as empty, null labels and null doc_ids are left out, of
    equal texts one stands for all (see labelled_texts); an empty table, or
    labels of one kind alone, give a constant score.
    """
    usable = F.lit(True) if usable is None else usable
    rows = labelled_texts(docs, sample_labels(labels, "toxic", usable, sample), "toxic-sample")
    halves = {bool(r["late"]): (r["n"], r["bad"]) for r in rows.groupBy((F.col("part") >= 0.5).alias("late")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).collect()}
    split = all(0 < halves.get(late, (0, 0))[1] < halves[late][0] for late in (False, True)) if len(halves) == 2 else False
    lexicon, weight = learn_lexicon(rows.filter("part < 0.5") if split else rows)
    vectors = (rows.filter("part >= 0.5") if split else rows).select("doc_id", "label", "part", array_to_vector(_column(lexicon, weight)).alias("features"))
    vectors = materialize(vectors, "toxic-vectors")
    n, bad = vectors.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not bad or bad == n:
        return Model(lexicon, weight, None, None, float((bad or 0) / n) if n else 0.0)
    base = float(bad / n)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5 if bad >= ENOUGH else 2)) == 0
    one, two = vectors.filter(apart), vectors.filter(~apart)
    if bad >= ENOUGH:
        trees = _grow(two)
        return Model(lexicon, weight, trees, _calibrate(_raw(trees, one)), base)
    trees = _grow(vectors)
    counts = [x.agg(F.count(F.lit(1)), F.sum("label")).first() for x in (one, two)]
    if all(0 < (b or 0) < k for k, b in counts):
        unseen = _raw(_grow(one), two).unionByName(_raw(_grow(two), one))
    else:
        unseen = _raw(trees, vectors)  # too few rows to hold any back
    return Model(lexicon, weight, trees, _calibrate(unseen), base)


THRESHOLD = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; a third of the labels is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = fit(docs, labels, remainder(3) != 1).with_score(docs)
    return scored.select("doc_id", (F.coalesce(remainder(3) == 1, F.lit(False))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
