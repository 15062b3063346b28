"""Benchmark decontamination: containment search for short test items inside long documents.

Items are partitioned by the size of their shingle set (powers of two; items
of fewer than five words, whose one shingle is their whole word sequence, by
their number of words). Each partition has a MinHash index: the least hashes
of its items, as many as its largest item needs so that HITS of them, or all
that there are, lie in every document that holds a share `threshold` of the
item. The partition's greatest index value bounds the sketch of a document:
only its hashes up to there are compared. A Jaccard-based MinHash would miss
short items in long documents; this misses none. Candidates are confirmed by
the exact containment of their shingles, word for word.

Small sets of items are one index, which is sent to all tasks, and documents
are not shuffled. Larger ones are a table of distinct texts. A document that
contains an item shares one at least of the item's values that the fewest
documents have, all but as many as it must share; sketches are joined with
those alone, so that a phrase that is everywhere makes no candidates. A
document's text meets all of its candidates at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.llm import words as W
from payguard.llm.common import as_row, bitmap_of, bound_batches, chunked, free_name, in_bitmap, materialize, text_buffer, text_slices

SHINGLE = 5
THRESHOLD = 0.75
#: Index values of an item that a document which contains it shares, where the item has so many; one value alone would make every common phrase a candidate.
HITS = 3
#: Bytes of item texts up to which the index is sent to all tasks.
SENT_BYTES = 8 << 20
HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("shingles", T.LongType())]))
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("shingles", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.translate(bytes(W._LOWER)).split()


def shingles_of(words: list[bytes], width: int = SHINGLE) -> set[bytes]:
    """The exact shingles of `width` words."""
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def partition_of(n_words: int, n: int) -> int:
    """The size partition of an item of n shingles: 1 to 4 for so many words, from 5 on by the power of two."""
    return n_words if n_words < SHINGLE else SHINGLE - 1 + n.bit_length()


def index_size(n: int, threshold: float = THRESHOLD) -> int:
    """Least hashes of an item of n shingles that its partition's index holds: what the partition's largest item may lack, and HITS more."""
    largest = (1 << n.bit_length()) - 1
    return min(n, _lacking(largest, threshold) + HITS)


def _lacking(n: int, threshold: float) -> int:
    """Shingles of n that a document with a share `threshold` of them may lack."""
    return n - math.ceil(threshold * n - 1e-9)


def _run_hashes(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and their rows. Runs of other widths have other hashes."""
    at, row = W.valid(rows, width)
    return (W.mix(W.rolling(hashes, width)[at] + np.uint64(width)), row) if len(at) else (np.zeros(0, np.uint64), row)


class Item:
    """One item: its exact shingles and its least hashes."""

    def __init__(self, item_id: int | None, text: str | None, threshold: float) -> None:
        data = (text or "").encode()
        words = words_of(data)
        self.item_id, self.width = item_id, min(SHINGLE, len(words))
        self.exact = shingles_of(words, self.width) if words else set()
        self.partition = partition_of(len(words), len(self.exact))
        self.needed, self.values = 0, np.zeros(0, np.uint64)  # needed: of the values, how many lie in every document that contains the item
        if self.exact:
            buffer, offsets = text_buffer(pa.array([text]))
            starts, ends, rows = W.split(buffer, offsets)
            got = np.unique(_run_hashes(W.hashes(buffer, starts, ends, lower=True), rows, self.width)[0])
            self.values = got[: index_size(len(self.exact), threshold)]
            self.needed = max(1, len(self.values) - _lacking(len(self.exact), threshold))

    def within(self, words: list[bytes], have: dict[int, set[bytes]], threshold: float) -> dict | None:
        """The hit of this item in a document's words; have: the document's shingles by width, filled as needed."""
        if self.width not in have:
            have[self.width] = shingles_of(words, self.width)
        shared = len(self.exact & have[self.width])
        return {"item_id": self.item_id, "shared": shared, "shingles": len(self.exact)} if shared >= threshold * len(self.exact) - 1e-9 else None


class Partition:
    """The index of one size partition: its values, ascending, whose items they are, and the greatest of them."""

    def __init__(self, width: int, items: list[tuple[int, Item]]) -> None:
        value = np.concatenate([i.values for _, i in items])
        owner = np.repeat([k for k, _ in items], [len(i.values) for _, i in items])
        order = np.argsort(value, kind="stable")
        self.width, self.value, self.owner, self.bound = width, value[order], owner[order], value.max()


class Index:
    """The indexes of all partitions."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.items = [i for i in (Item(*x, threshold) for x in items) if i.exact]
        self.needed = np.array([i.needed for i in self.items], np.int64)
        groups: dict[int, list[tuple[int, Item]]] = {}
        for k, i in enumerate(self.items):
            groups.setdefault(i.partition, []).append((k, i))
        self.partitions = [Partition(members[0][1].width, members) for _, members in sorted(groups.items())]

    def search(self, text: pa.Array) -> list[list[dict]]:
        """The contained items of each text, by their place. Texts are hashed once."""
        buffer, offsets = text_buffer(text)
        starts, ends, rows = W.split(buffer, offsets)
        hashes = W.hashes(buffer, starts, ends, lower=True)
        runs = {w: _run_hashes(hashes, rows, w) for w in {p.width for p in self.partitions}}
        pairs = []
        for p in self.partitions:
            value, row = runs[p.width]
            sketch = np.flatnonzero(value <= p.bound)
            value, row = value[sketch], row[sketch]
            lo = np.searchsorted(p.value, value, "left")
            found = np.flatnonzero(p.value[np.minimum(lo, len(p.value) - 1)] == value)
            value, row, lo = value[found], row[found], lo[found]
            n = np.searchsorted(p.value, value, "right") - lo
            place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            # A value that a document has twice counts once.
            hit = np.unique(np.stack([np.repeat(row, n), p.owner[place], place], axis=1), axis=0)
            pair, hits = np.unique(hit[:, :2], axis=0, return_counts=True)
            pairs.append(pair[hits >= self.needed[pair[:, 1]]])
        out: list[list[dict]] = [[] for _ in range(len(text))]
        last, words, have = -1, [], {}
        for doc, k in sorted(map(tuple, np.concatenate(pairs).tolist())) if pairs else ():
            if doc != last:
                last, words, have = doc, words_of(buffer[offsets[doc] : offsets[doc + 1]].tobytes()), {}
            hit = self.items[k].within(words, have, self.threshold)
            if hit:
                out[doc].append(hit)
        return out


def _column(spark: SparkSession, index: Index, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(index)
    return F.arrow_udf(lambda x: pa.array(chunked(sent.value.search, x), _HITS), HIT)(text)


def _joined_hits(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Hits by text (key, hits), for more items than one index should hold. docs: key, text, a row for each text; items: item_id, text."""
    spark = docs.sparkSession
    ids = materialize(items.withColumn("item", F.sha2("text", 256).cast("binary")), "items")
    items = materialize(ids.groupBy("item").agg(F.first("text").alias("text")), "item-texts")
    chunks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SENT_BYTES))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            owner, width, needed, value = [], [], [], []
            for k, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                i = Item(None, text, threshold)
                owner += [k] * len(i.values)
                width += [i.width] * len(i.values)
                needed += [i.needed] * len(i.values)
                value.append(i.values.view(np.int64))
            columns = [pa.array(np.concatenate(value)), pa.array(owner, pa.binary()), pa.array(width, pa.int32()), pa.array(needed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["value", "item", "width", "needed"])

    table = materialize(items.select("item", "text").mapInArrow(index, "value bigint, item binary, width int, needed int"), "item-index")
    widths = sorted(r[0] for r in table.select("width").distinct().collect())  # five at most
    bitmap = spark.sparkContext.broadcast(bitmap_of(table, "value"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            buffer, offsets = text_buffer(batch["text"])
            starts, ends, rows = W.split(buffer, offsets)
            hashes, keys = W.hashes(buffer, starts, ends, lower=True), batch["key"]
            for width in widths:
                value, row = _run_hashes(hashes, rows, width)
                keep = np.flatnonzero(in_bitmap(bitmap.value, value))
                pair = np.unique(np.stack([value[keep], row[keep].astype(np.uint64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), keys.take(pa.array(pair[1].astype(np.int64)))], ["value", "key"])

    sketches = materialize(docs.mapInArrow(sketch, "value bigint, key binary"), "sketches")
    pairs = materialize(sketches.join(_rarest(table, sketches), "value").select("key", "item").distinct(), "item-candidates")
    # A document's candidates in pieces of bounded size, each with the document's text.
    chunk = F.pmod(F.xxhash64("item"), F.lit(chunks))
    asked = pairs.join(items, "item").groupBy("key", chunk.alias("chunk")).agg(F.collect_list(F.struct("item", F.col("text").alias("item_text"))).alias("items"))
    both = asked.join(docs, "key").select("key", "items", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out = []
            for key, asked, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, have = words_of(text.encode()), {}
                for x in asked:
                    hit = Item(None, x["item_text"], threshold).within(words, have, threshold)
                    if hit:
                        out.append((key, x["item"], hit["shared"], hit["shingles"]))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "item", "shared", "shingles"])

    found = both.mapInArrow(confirm, "key binary, item binary, shared bigint, shingles bigint").join(ids.select("item", "item_id"), "item")
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item_id", "shared", "shingles"))).alias("hits"))  # items of one text


def _rarest(table: DataFrame, sketches: DataFrame) -> DataFrame:
    """(value, item): of each item's values all but needed - 1, those that the fewest texts have. Who has `needed` of an item's values has one of these."""
    frequency = sketches.groupBy("value").agg(F.count(F.lit(1)).alias("texts"))
    by_item = Window.partitionBy("item")
    counted = table.join(frequency, "value", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    ranked = counted.withColumns({"place": F.row_number().over(by_item.orderBy("texts", "value")), "size": F.count(F.lit(1)).over(by_item)})  # as many as an item's shingles at most
    return ranked.filter("place <= size - needed + 1 AND texts > 0").select("value", "item")


def with_hits(docs: DataFrame, items: DataFrame, name: str = "hits", threshold: float = THRESHOLD, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """docs with a column `name`: the items (item_id, shared, shingles) of which a share `threshold` of the shingles lies in the text.

    docs has a column text, items item_id and text. An item of 1 to 4 words
    is one shingle, and a document with that run of words contains it. Null
    and empty items are never found; null texts contain nothing; repeated
    items are each reported; a null item_id stays null. All columns of docs
    stay (`name` gets underscores where docs has it already).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = items.select("item_id", "text").filter("text IS NOT NULL")
    name = free_name(docs, name)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= sent_bytes:
        index = Index([tuple(r) for r in items.collect()], threshold)  # sent_bytes of text at most
        return docs.withColumn(name, _column(spark, index, F.col("text")))
    rows = docs.select(as_row(docs), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).cast("binary").alias("key"))
    texts = rows.groupBy("key").agg(F.first(F.coalesce(F.col("row.text"), F.lit(""))).alias("text"))
    found = _joined_hits(materialize(texts, "texts"), items, threshold)
    none = F.array().cast(HIT)
    return rows.join(found, "key", "left").select("row.*", F.coalesce("hits", none).alias(name))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Pairs of documents and contained items: doc_id, item_id, shared, shingles, containment. A null doc_id stays null; other columns are left out."""
    hits = with_hits(docs.select("doc_id", "text"), items, "hits", threshold, sent_bytes).select("doc_id", F.explode("hits").alias("hit"))
    return hits.select("doc_id", "hit.item_id", "hit.shared", "hit.shingles", (F.col("hit.shared") / F.col("hit.shingles")).alias("containment"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
k AS (SELECT DISTINCT least(len(ws), 5) AS k FROM w WHERE kind = 1 AND len(ws) > 0),
s AS (
  SELECT DISTINCT kind, id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g
  FROM (SELECT kind, id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM w, k WHERE len(ws) >= k AND (kind = 0 OR least(len(ws), 5) = k))),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id),
i AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM s d JOIN s b ON d.g = b.g AND d.k = b.k AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, k::BIGINT AS shared, n::BIGINT AS shingles, k / n AS containment
FROM i JOIN n ON n.id = item_id WHERE 4 * k >= 3 * n
"""
