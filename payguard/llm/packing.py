"""Packing documents into training sequences by cutting-stock column generation.

A document of n ids fills whole sequences as far as it can; the rest (under
one sequence) is the piece that patterns combine. Only a histogram of rests
reaches the driver. Ranks within a length, counted on the executors, tell
each document its pattern, sequence and place.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payguard.llm.common import bound_batches, materialize, prefix_sums, text_slices
from payguard.llm.cutting_stock import plan

CAPACITY = 1024
#: Lengths are rounded up to a multiple of this for patterns: the linear program has CAPACITY / UNIT rows at most.
UNIT = 4
END_ID = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken, which gives the same ids several times as fast.

    Strings of added tokens have those tokens' ids where the call allows them.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def encode_function(vocabulary: str) -> Callable[[str], np.ndarray]:
    """The ids that the tokenizers library gives a text with add_special_tokens=False.

    Texts that tiktoken cannot do so go to the library itself: those with
    added tokens that it does not find as the library does (with flags, or one
    that begins another), and those on which its expression fails, as it does
    on a million blanks on end.
    """
    with open(vocabulary, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    names = [t["content"] for t in added]
    fast = encoder(vocabulary).encode_to_numpy
    alike = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")) and not any(a != b and a.startswith(b) for a in names for b in names)

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def encode(text: str) -> np.ndarray:
        if alike or not any(x in text for x in names):
            try:
                return fast(text, allowed_special="all", disallowed_special=())
            except ValueError:  # too many steps back
                pass
        return np.array(library().encode(text, add_special_tokens=False).ids, np.int64)

    return encode


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Ids of each (doc_id, text) row, ended by id 0: doc_id, doc_tokens, crcs (of each run of `capacity` ids and the rest), ids.

    ids holds the same runs of little-endian 32-bit ids where with_ids is set, else null. Null
    text is empty (one id, the end), strings of added tokens get those tokens'
    ids, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_function(vocabulary)
        for batch in text_slices(batches):
            counts, crcs, ids = [], [], []
            for text in batch["text"].to_pylist():
                got = np.append(encode(text or ""), END_ID).astype("<u4")
                data = got.tobytes()
                counts.append(len(got))
                crcs.append([zlib.crc32(data[i : i + 4 * capacity]) for i in range(0, len(data), 4 * capacity)])
                ids.append([data[i : i + 4 * capacity] for i in range(0, len(data), 4 * capacity)] if with_ids else None)
            columns = [batch["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "crcs", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, doc_tokens bigint, crcs array<bigint>, ids array<binary>")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Pack (doc_id, text) rows; one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every id lies in one piece; a sequence holds `capacity` ids at most, from
    offset 0 on without a gap. ids (with_ids) are the piece's, as little-endian
    32-bit numbers. Equal rows are
    packed one by one; null doc_ids are packed too; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    # Ids stay where they are until the pieces' places are known: rows are numbered as they are written, and joined by that.
    written = materialize(tokenize(docs, vocabulary, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), "tokens")
    tokens = written.drop("ids")
    rest = F.col("doc_tokens") % capacity
    tokens = tokens.withColumns({"bin": F.ceil(rest / unit).cast("int"), "whole": F.floor(F.col("doc_tokens") / capacity)})
    ranked, totals = prefix_sums(tokens, ["bin"], ["doc_id", "doc_tokens", "row"], {"rank": F.lit(1).cast("long"), "whole_before": F.col("whole")}, "ranks")
    histogram = {r["bin"]: r for r in totals.collect()}  # capacity / unit + 1 rows at most

    lengths = np.array(sorted(b for b in histogram if b), np.int64)
    demand = np.array([histogram[b]["rank"] for b in lengths], np.int64)
    slots, first, taken = [], 0, dict.fromkeys(lengths.tolist(), 0)
    for counts, times in plan(lengths, demand, capacity // unit):
        place = 0
        for b, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            if n:
                slots.append((b, taken[b], taken[b] + n * times, n, first, place))
                taken[b] += n * times
                place += n
        first += times
    # A bin's ranks are cut into as many blocks as it has slots, so that a rank meets the few slots of its block alone.
    of_bin = Counter(s[0] for s in slots)
    width = {b: max(1, -(-histogram[b]["rank"] // n)) for b, n in of_bin.items()}
    slots = [(b, block, lo, hi, *rest) for b, lo, hi, *rest in slots if lo < histogram[b]["rank"] for block in range(lo // width[b], (min(hi, histogram[b]["rank"]) - 1) // width[b] + 1)]
    bins = []
    for b, r in sorted(histogram.items()):
        bins.append((b, first, width.get(b, 1)))
        first += r["whole_before"]
    # Both tables have a few rows for each bin and pattern, so their size does not follow the input's.
    slots = F.broadcast(spark.createDataFrame(slots, "bin int, block bigint, lo bigint, hi bigint, n bigint, first bigint, place bigint"))
    bins = F.broadcast(spark.createDataFrame(bins, "bin int, whole_first bigint, width bigint"))

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"]
    step = F.col("rank") - F.col("lo")
    rests = ranked.filter("bin > 0").join(bins, "bin").withColumn("block", F.call_function("div", F.col("rank"), F.col("width"))).join(slots, ["bin", "block"]).filter("rank >= lo AND rank < hi")
    rests = rests.select("doc_id", (F.col("whole") * capacity).alias("start"), rest.alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", (F.col("first") + F.floor(step / F.col("n"))).alias("sequence_id"), (F.col("place") + step % F.col("n")).alias("at"), "row")
    before = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a sequence has `capacity` pieces at most
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    wholes = ranked.filter("whole > 0").join(bins, "bin").select("doc_id", "doc_tokens", "row", F.col("whole_first") + F.col("whole_before"), F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int")))).toDF("doc_id", "doc_tokens", "row", "first", "at", "ids_crc32")
    wholes = wholes.select("doc_id", (F.col("at").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "row")
    pieces = rests.select(*columns).union(wholes.select(*columns))
    if not with_ids:
        return pieces.drop("row").withColumn("ids", F.lit(None).cast("binary"))
    runs = written.select("row", F.posexplode("ids")).toDF("row", "run", "ids")
    return pieces.withColumn("run", (F.col("start") / capacity).cast("int")).join(runs, ["row", "run"]).drop("row", "run")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary()).drop("ids")
