"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.llm.common import materialize


def sample_labels(labels: DataFrame, target: str, usable: Column, limit: int) -> DataFrame:
    """About `limit` of the usable labelled rows, chosen by a hash of doc_id: doc_id, label, part (0 to 1, even). Null labels are left out."""
    rows = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    share = min(1.0, limit / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(target)), F.lit(1 << 20)) / (1 << 20)
    return rows.filter(place < share).select("doc_id", F.col(target).cast("int").alias("label"), (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) / 1000).alias("part"))


def labelled_texts(docs: DataFrame, sample: DataFrame, name: str) -> DataFrame:
    """Texts of the sampled rows, written out. The sample's size is bounded, so it is sent to all tasks.

    Each text is there once: of equal texts, the row of the least (doc_id,
    label) stands for all, so copies that are labelled differently or often
    do not outweigh others, and the same table gives the same sample.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    once = rows.groupBy("text").agg(F.min(F.struct("doc_id", "label", "part")).alias("row")).select("row.*", "text")
    return materialize(once.repartition(8, "doc_id").sortWithinPartitions("doc_id"), name)


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus
