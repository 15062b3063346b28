"""Scores of a boosted model after each of its trees, and how well each of them ranks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payguard.functions.features import FEATURES

#: Scores are told apart to a ten-thousandth, as they are served; trees that are counted in one pass.
LEVELS, AT_ONCE = 10_000, 100
_SPLIT, _LEAF, _TREE = re.compile(r"If \(feature (\d+) <= (\S+)\)"), re.compile(r"Predict: (\S+)"), re.compile(r"Tree (\d+) \(weight (\S+)\):")


@dataclass
class Tree:
    """A regression tree as arrays: feature (-1 at leaves), threshold, the child where the value is not above it, the other child, prediction."""

    weight: float
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.feature[node] >= 0).any():
            at = np.flatnonzero(inner)
            here = node[at]
            down = x[at, self.feature[here]] <= self.threshold[here]
            node[at] = np.where(down, self.low[here], self.high[here])
        return self.value[node]


def trees_of(model: GBTClassificationModel) -> list[Tree]:
    """The trees of a model without categorical features, from its description, which has all digits."""
    out: list[Tree] = []
    for part in re.split(r"(?=Tree \d+ \(weight)", model.toDebugString)[1:]:
        lines = part.strip().splitlines()
        nodes: list[list] = []

        def read(at: int) -> tuple[int, int]:
            """The number of the node described from a line on, and the line after it."""
            number = len(nodes)
            line = lines[at].strip()
            if (leaf := _LEAF.match(line)):
                nodes.append([-1, 0.0, 0, 0, float(leaf[1])])
                return number, at + 1
            split = _SPLIT.match(line)
            nodes.append([int(split[1]), float(split[2]), 0, 0, 0.0])
            nodes[number][2], at = read(at + 1)
            nodes[number][3], at = read(at + 1)  # after "Else"
            return number, at

        read(1)
        feature, threshold, low, high, value = zip(*nodes, strict=True)
        out.append(Tree(float(_TREE.match(lines[0])[2]), np.array(feature), np.array(threshold), np.array(low), np.array(high), np.array(value)))
    return out


def staged_average_precision(model: GBTClassificationModel, rows: DataFrame, start: int, stop: int) -> list[float]:
    """Average precision on labelled rows with only the first start + 1, start + 2, ..., stop trees; 0 without a positive row.

    Rows are counted by (trees, score to four digits, label) inside the tasks,
    so what is shuffled is bounded by the trees and the scores, not the rows.
    """
    out: list[float] = []
    for first in range(start, stop, AT_ONCE):
        out += _averages(model, rows, first, min(first + AT_ONCE, stop))
    return out


def _averages(model: GBTClassificationModel, rows: DataFrame, start: int, stop: int) -> list[float]:
    trees = rows.sparkSession.sparkContext.broadcast(trees_of(model)[:stop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((stop - start, 2, LEVELS + 1), np.int64)
        for batch in batches:
            x = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in FEATURES], axis=1)
            label = (batch["label"].to_numpy(zero_copy_only=False) == 1).astype(np.int64)
            margin = np.zeros(len(x))
            for i, tree in enumerate(trees.value):
                margin += tree.weight * tree.predict(x)
                if i >= start:
                    score = np.rint(LEVELS / (1 + np.exp(-2 * margin))).astype(np.int64)
                    counts[i - start] += np.bincount(label * (LEVELS + 1) + score, minlength=2 * (LEVELS + 1)).reshape(2, -1)
        tree, level = np.nonzero(counts.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(level), pa.array(counts[tree, 1, level]), pa.array(counts[tree, 0, level])], ["tree", "level", "p", "n"])

    found = rows.select(*FEATURES, "label").mapInArrow(run, "tree bigint, level bigint, p bigint, n bigint")
    counts = found.groupBy("tree", "level").agg(F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    down = Window.partitionBy("tree").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # LEVELS + 1 rows at most
    steps = counts.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    average = F.coalesce(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("p"), F.lit(0.0)), F.lit(0.0))
    got = {r["tree"]: r["ap"] for r in steps.groupBy("tree").agg(average.alias("ap")).collect()}
    return [got.get(i, 0.0) for i in range(stop - start)]
