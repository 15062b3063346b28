"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Toxic documents go; one document of each near-duplicate group stays; documents
that hold a benchmark item go; secrets are cut out of the texts; what is left
is packed into training sequences of token ids. All stages but the last return the columns
that they were given, whatever their names.

In every stage a null text counts as empty: it is scored as an empty text,
links with nothing, contains nothing and stays null. Rows of a null doc_id
stay and are packed. Rows of one doc_id are one document to the near-duplicate
stage, which keeps one of them; all other stages take rows one by one. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm import decontam, near_dup, packing, secrets, toxicity
from payguard.llm.common import Rounds, bound_batches, free_name, scratch
from payguard.llm.labels import remainder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; the scorer learns from the labels of the documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder(3) != 1)
    name = free_name(docs, "toxicity")
    return model.with_score(docs, name).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least doc_id."""
    return near_dup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = free_name(docs, "hits")
    return decontam.with_hits(docs, items, name).filter(F.size(name) == 0).drop(name)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret in a text is replaced by its kind in brackets, and n_chars follows."""
    out = docs.withColumn("text", secrets.redacted_column(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids, with their ids as little-endian 32-bit numbers: those of a sequence by offset are its training sequence."""
    return packing.pack(docs, packing.default_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. Each stage's result replaces the one before, so only the last one is left."""
    docs, rounds = spark.read.parquet(f"{sf_dir}/documents.parquet"), Rounds(spark, "pipeline", keep=True)
    bound_batches(spark)
    for _, stage in STAGES:
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = rounds.put(stage(spark, docs, sf_dir))
    return docs
