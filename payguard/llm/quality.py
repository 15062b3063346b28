"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded; gated
attention, learned from document labels alone, weighs the passages; the score
is a logistic function of the weighted representation. The network is small
and is fitted on a bounded sample; scoring is an Arrow function of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm import words as W
from payguard.llm.common import bound_batches, free_name, text_slices
from payguard.llm.labels import labelled_texts, remainder, sample_labels
from payguard.llm.textstats import Batch, column_of

PASSAGE = 64
#: Labelled documents that the network is fitted on, at most (on average), with all of their passages.
SAMPLE = 6_000
HIDDEN, GATE = 24, 12
#: Numbers that describe a passage.
WIDTH = 18


def passages(b: Batch, size: int = PASSAGE) -> np.ndarray:
    """Word offsets of the passages of all rows; a last passage of under half the size joins the one before. Rows without words have none."""
    counts = np.maximum((b.n + size // 2) // size, (b.n > 0).astype(np.int64))
    first = np.repeat(b.rows[:-1], counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.append(first + step * size, b.rows[-1]).astype(np.int64), np.repeat(np.arange(len(b.n)), counts)


def encode(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the passages and their WIDTH numbers."""
    cut, row = passages(b)
    if not len(row):
        return row, np.zeros((0, WIDTH))
    n = np.diff(cut).astype(float)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(float), cut[:-1]) / n

    size = b.ends - b.starts
    upper, lower, digit, high = b.count(65, 90), b.count(97, 122), b.count(48, 57), b.count(128, 255)
    mark = size - upper - lower - digit - high
    last, first = b.buffer[b.ends - 1], b.buffer[b.starts]
    word = W.hashes(b.buffer, b.starts, b.ends, lower=True)
    owner = np.repeat(np.arange(len(row)), np.diff(cut))
    text = np.repeat(np.arange(len(b.n)), b.n)
    again = np.zeros(len(word), np.bool_)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    distinct = _first_of(owner, word)
    whole = _first_of(text, word)
    at, who = W.valid(b.rows, 5)
    seen = np.zeros(len(word), np.bool_)
    if len(at):
        seen[at] = ~_first_of(who, W.rolling(word, 5)[at])
    common = np.isin(size, (1, 2, 3))
    lengths = mean(size)
    columns = [lengths / 8, np.sqrt(np.maximum(mean(size.astype(float) ** 2) - lengths**2, 0)) / 4, mean(upper) / lengths, mean((upper > 1) & (lower == 0)), mean((first >= 65) & (first <= 90)), mean(mark) / lengths, mean(mark >= 3), mean((size == mark)), mean(np.isin(last, (46, 33, 63))), mean(last == 44), mean(digit > 0), mean(high) / lengths, mean(distinct), mean(whole), mean(again), mean(seen), mean(common), np.log1p(n) / 4]
    return row, np.stack(columns, axis=1)


def _first_of(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its group."""
    key = W.mix(value ^ W.mix(group.astype(np.uint64)))
    out = np.zeros(len(key), np.bool_)
    out[np.unique(key, return_index=True)[1]] = True
    return out


@dataclass
class Model:
    """Weights of the network: standardisation, encoder, attention (value and gate), output. base is a constant score where there are no usable labels."""

    weights: dict[str, np.ndarray] | None
    base: float

    def score(self, text: pa.Array) -> np.ndarray:
        """Scores (n x 1) of whole texts; texts without words have one empty passage."""
        b = Batch(text)
        row, x = encode(b)
        if self.weights is None:
            return np.full((len(text), 1), self.base)
        missing = np.flatnonzero(b.n == 0)
        row, x = np.append(row, missing), np.concatenate([x, np.zeros((len(missing), WIDTH))])
        return forward(self.weights, x, row, len(text))["p"][:, None]


def forward(w: dict[str, np.ndarray], x: np.ndarray, row: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Scores p of n bags, and what the gradient needs. Each bag has a passage at least."""
    x = np.clip((x - w["mean"]) / w["std"], -8, 8)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = np.clip((t * g) @ w["a"], -30, 30)
    a = np.exp(e)
    total = np.bincount(row, a, n)
    a = a / total[row]
    z = np.stack([np.bincount(row, a * h[:, k], n) for k in range(h.shape[1])], axis=1)
    p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["c"][0], -30, 30)))
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p}


def gradient(w: dict[str, np.ndarray], s: dict[str, np.ndarray], row: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss."""
    d = (s["p"] - y) / len(y)
    dz = d[:, None] * w["o"]
    dh = s["a"][:, None] * dz[row]
    de = s["a"] * ((s["h"] - s["z"][row]) * dz[row]).sum(axis=1)
    dt, dg = de[:, None] * w["a"] * s["g"] * (1 - s["t"] ** 2), de[:, None] * w["a"] * s["t"] * s["g"] * (1 - s["g"])
    dh = (dh + dt @ w["V"].T + dg @ w["U"].T) * (1 - s["h"] ** 2)
    return {"o": s["z"].T @ d, "c": np.array([d.sum()]), "a": (s["t"] * s["g"]).T @ de, "V": s["h"].T @ dt, "U": s["h"].T @ dg, "W": s["x"].T @ dh, "b": dh.sum(axis=0)}


def train(x: np.ndarray, row: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the log loss. row: each passage's bag, ascending."""
    rng = np.random.default_rng(seed)
    w = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-3, "W": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE**-0.5, GATE), "o": np.zeros(HIDDEN), "c": np.zeros(1)}
    learned = [k for k in w if k not in ("mean", "std")]
    m, v, t = {k: np.zeros_like(w[k]) for k in learned}, {k: np.zeros_like(w[k]) for k in learned}, 0
    cut = np.searchsorted(row, np.arange(len(y) + 1))
    steps = max(1, len(y) // batch)
    for epoch in range(max(epochs, 600 // steps)):
        for part in np.array_split(rng.permutation(len(y)), steps):
            n = cut[part + 1] - cut[part]
            at = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in part])
            bag = np.repeat(np.arange(len(part)), n)
            g = gradient(w, forward(w, x[at], bag, len(part)), bag, y[part])
            t += 1
            for k in learned:
                g[k] = g[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if epoch >= 30 and t > 3000:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most about `sample` labelled rows. docs: doc_id, text; labels: doc_id, quality; usable: which label rows may be learned from.

    Passages are encoded on the executors; their numbers, about 1 byte for
    each word of the sampled texts, come to the driver. Null texts count as
    empty, null labels and null doc_ids are left out, of equal texts one
    stands for all (see labelled_texts); an empty table, or labels of one
    kind alone, give a constant score.
    """
    usable = F.lit(True) if usable is None else usable
    rows = labelled_texts(docs, sample_labels(labels, "quality", usable, sample), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            b = Batch(batch["text"])
            row, x = encode(b)
            doc_ids, out = batch["doc_id"].cast(pa.int64()).to_pylist(), []
            for r, label in enumerate(batch["label"].to_pylist()):
                own = x[row == r] if b.n[r] else np.zeros((1, WIDTH))
                out.append((doc_ids[r], label, own.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "label", "x"])

    # In order of doc_id, so that the same table gives the same weights; a bounded number of labelled documents.
    bags = sorted(rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, x binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in bags], float)
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.0)
    x = [np.frombuffer(r["x"], np.float32).astype(float).reshape(-1, WIDTH) for r in bags]
    return Model(train(np.concatenate(x), np.repeat(np.arange(len(x)), [len(k) for k in x]), y), float(y.mean()))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column `name` (with underscores after it where docs has that), 0 to 1; all columns of docs stay.

    Null texts count as empty, equal texts get equal scores, repeated rows
    stay, an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, name), column_of(model.score)(F.col("text"))[0])


THRESHOLD = 0.3


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the labels is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = with_score(docs, fit(docs, labels, remainder(5) != 0))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
