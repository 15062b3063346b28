"""Exact substring deduplication by super-k-mer partitioning.

A window is 50 consecutive words. Its minimiser is the least hash of the
8-word runs inside it; consecutive windows that share a minimiser travel as
one packed string to the minimiser's bucket, where windows are compared word
for word. Equal windows have equal minimisers, so they always meet.

A first pass writes minimisers and places alone, a few bytes a run. Only
minimisers that occur in two documents can hold a repeated window; a join
decides which places these are, and only their strings are packed and sent.
A minimiser with very many windows would make a bucket too large for one task;
its strings are counted by a partial aggregation, and only the windows of
different strings are compared, as 128-bit digests. The path is the same at
every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm import words as W
from payguard.llm.common import bitmap_of, bound_batches, in_bitmap, materialize, scratch, text_buffer, text_slices

WINDOW = 50
GRAM = 8
#: Windows of a minimiser above which it is hot, and windows of one packed string, at most.
HOT, RUN = 8_000, 64


def _normal(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each row's words joined by one space, and the bytes and offsets of all rows together."""
    buffer, offsets = text_buffer(batch["text"])
    data = buffer.tobytes()
    rows = [b" ".join(data[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return rows, np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def super_kmers(buffer: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of consecutive windows of one row with one minimiser, RUN windows at most.

    Arrays: row, minimiser (int64), at (the first window's word within its
    row), n (windows), lo, hi (bytes of the run's words).
    """
    starts, ends, rows = W.split(buffer, offsets)
    at, row = W.valid(rows, window)
    none = np.zeros(0, np.int64)
    if not len(at):
        return dict.fromkeys(("row", "minimiser", "at", "n", "lo", "hi"), none)
    least = W.sliding_min(W.rolling(W.hashes(buffer, starts, ends), gram), window - gram + 1)[at]
    new = np.ones(len(at), np.bool_)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    # Long runs are cut by their windows' place in the run, so that equal runs are cut alike.
    new[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % RUN == 0] = True
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    first = at[head]
    return {"row": row[head], "minimiser": least[head].view(np.int64), "at": first - rows[row[head]], "n": n, "lo": starts[first], "hi": ends[first + n + window - 2]}


def _word_starts(packed: bytes) -> list[int]:
    spaces = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    return [0, *(spaces + 1).tolist(), len(packed) + 1]


def _windows(packed: bytes, n: int, window: int) -> list[bytes]:
    """The n windows of a packed string."""
    at = _word_starts(packed)
    return [packed[at[i] : at[i + window] - 1] for i in range(n)]


def _minimisers(docs: DataFrame, window: int) -> DataFrame:
    """Runs of windows without their words: minimiser, doc_id, text_key, at, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, buffer, offsets = _normal(batch)
            found = super_kmers(buffer, offsets, window)
            ids, keys = (batch[c].to_numpy(zero_copy_only=False)[found["row"]].astype(np.int64) for c in ("doc_id", "text_key"))
            columns = [pa.array(found["minimiser"]), pa.array(ids), pa.array(keys), pa.array(found["at"].astype(np.int32)), pa.array(found["n"].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["minimiser", "doc_id", "text_key", "at", "n"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "minimiser bigint, doc_id bigint, text_key bigint, at int, n int")


def _chosen(runs: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """For each text that has them, the places of its runs whose minimiser is shared, and which of those are hot. A text's places are as many as its words at most."""
    known = counts.select("minimiser", (F.col("n") > hot).alias("hot"))
    return runs.select("minimiser", "doc_id", "text_key", "at").join(known, "minimiser").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "hot")).alias("places"))


_SENT = "hot boolean, k1 bigint, doc_id bigint, text_key bigint, at int, n int, packed binary"


def _send(docs: DataFrame, window: int, chosen: DataFrame) -> DataFrame:
    """Super-k-mers at the chosen places, packed, with their minimiser (k1). A bitmap keeps texts without any out of the shuffle; the join decides about the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, buffer, offsets = _normal(batch)
            found = super_kmers(buffer, offsets, window)
            places = batch["places"]
            of = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            inner = places.flatten()
            wanted = of << 32 | inner.field("at").to_numpy().astype(np.int64)
            order = np.argsort(wanted)
            wanted, many = wanted[order], inner.field("hot").to_numpy(zero_copy_only=False)[order]
            have = found["row"] << 32 | found["at"]
            place = np.searchsorted(wanted, have)
            keep = np.flatnonzero((place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == have))
            row, minimiser, at, n, lo, hi = (found[k][keep] for k in ("row", "minimiser", "at", "n", "lo", "hi"))
            data = buffer.tobytes()
            ids, keys = (batch[c].to_numpy(zero_copy_only=False)[row].astype(np.int64) for c in ("doc_id", "text_key"))
            packed = pa.array([data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
            columns = [pa.array(many[place[keep]]), pa.array(minimiser), pa.array(ids), pa.array(keys), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), packed]
            yield pa.RecordBatch.from_arrays(columns, ["hot", "k1", "doc_id", "text_key", "at", "n", "packed"])

    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(chosen, "text_key"))
    rows = docs.select("doc_id", "text_key", "text").mapInArrow(_marked(bitmap), "doc_id bigint, text_key bigint, text string")
    return rows.join(chosen, ["doc_id", "text_key"]).mapInArrow(run, _SENT)


def _frequent_repeats(rows: DataFrame, window: int) -> DataFrame:
    """Repeats among hot minimisers' super-k-mers. Equal strings are one, of their least document; its windows, RUN at most, meet those of other strings by digest, if those have earlier documents. A row for each super-k-mer, never for each of its windows, is joined with what its string has found."""
    rows = rows.withColumn("key", F.unhex(F.sha2("packed", 256)))
    strings = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("packed").alias("packed")), "strings")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "packed"):
            found = [_windows(p, p.count(b" ") + 2 - window, window) for p in batch["packed"].to_pylist()]
            n = np.array([len(f) for f in found])
            digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for f in found for w in f), np.int64).reshape(-1, 2)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            columns = [batch["key"].take(owner), pa.array(place.astype(np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch["low"].take(owner)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "i", "w1", "w2", "low"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, at, n, low, earlier in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_key", "at", "n", "low", "earlier")), strict=True):
                flags = [low < doc] * n
                for e in earlier or ():
                    flags[e["i"]] = e["first"] < doc
                out += [(doc, key, *r) for r in _ranges(flags, at)]
            yield _found(out)

    windows = materialize(strings.select("key", "low", "packed").mapInArrow(cut, "key binary, i int, w1 bigint, w2 bigint, low bigint"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("low").alias("first"), F.max("low").alias("last")).filter("first < last").drop("last")
    first = materialize(first, "first-documents")
    earlier = windows.join(first, ["w1", "w2"]).filter("first < low").groupBy("key").agg(F.collect_list(F.struct("i", "first")).alias("earlier"))  # RUN at most
    found = strings.select("key", "low", "high").join(earlier, "key", "left").filter("low < high OR earlier IS NOT NULL").drop("high")
    found = materialize(found, "frequent")  # so that the join deals both sides itself, and splits a very frequent string
    return rows.select("key", "doc_id", "text_key", "at", "n").join(found, "key").filter("low < doc_id OR earlier IS NOT NULL").drop("key").mapInArrow(ranges, _FOUND)


def _ranges(flags: list[bool], at: int) -> Iterator[tuple[int, int]]:
    """(first window, windows) of each run of set flags."""
    start = None
    for i, flag in enumerate([*flags, False]):
        if flag and start is None:
            start = i
        elif not flag and start is not None:
            yield at + start, i - start
            start = None


def _repeats(rows: list[tuple[int, int, int, int, bytes]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """Of one minimiser's rows (doc_id, text_key, at, n, packed): the windows that start in a document of a smaller id."""
    least: dict[bytes, int] = {}
    for doc, _, _, _, packed in rows:
        if least.get(packed, doc) >= doc:
            least[packed] = doc
    first: dict[bytes, int] = {}
    cut = {packed: _windows(packed, packed.count(b" ") + 2 - window, window) for packed in least} if len(least) > 1 else {}
    for packed, doc in least.items():
        for w in cut.get(packed, ()):
            if first.get(w, doc) >= doc:
                first[w] = doc
    for doc, key, at, n, packed in rows:
        if len(least) == 1:
            if least[packed] < doc:
                yield doc, key, at, n
        else:
            for start, count in _ranges([first[w] < doc for w in cut[packed]], at):
                yield doc, key, start, count


_FOUND = "doc_id bigint, text_key bigint, at int, n int"


def _bucket_repeats(sent: DataFrame, window: int) -> DataFrame:
    """Compare the packed strings of each bucket; a task holds one minimiser's rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list) -> list[tuple[int, int, int, int]]:
            return list(_repeats(rows, window)) if len(rows) > 1 else []

        held, minimiser = [], None
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("k1", "doc_id", "text_key", "at", "n", "packed")]
            for k, *row in zip(*columns, strict=True):
                if k != minimiser:
                    out += result(held)
                    held, minimiser = [], k
                held.append(tuple(row))
            yield _found(out)
        yield _found(result(held))

    dealt = sent.filter("NOT hot").select("k1", "doc_id", "text_key", "at", "n", "packed").repartition("k1").sortWithinPartitions("k1")
    return dealt.mapInArrow(run, _FOUND)


def _found(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "at", "n"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Windows whose words also start in a document of a smaller doc_id: rows (doc_id, text_key, at, n), n windows from word `at` on.

    docs: doc_id (not null), text_key (a hash of the text), text. The result
    does not depend on hot.
    """
    runs = materialize(_minimisers(docs, window), "runs")
    counts = runs.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"))
    counts = materialize(counts.filter("low < high").select("minimiser", "n"), "minimisers")
    chosen = materialize(_chosen(runs, counts, hot), "places")
    sent = materialize(_send(docs, window, chosen), "super-k-mers")
    found = _bucket_repeats(sent, window)
    return found.unionByName(_frequent_repeats(sent.filter("hot"), window)) if not counts.filter(F.col("n") > hot).isEmpty() else found


def kept_texts(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Remove each word that a repeated window covers: doc_id, n_words, n_removed, kept (the other words, joined by one space).

    One row for each row of (doc_id, text); null text has no words. Rows of a
    null doc_id are compared with nothing and stay whole; rows of equal doc_id
    never remove each other's words. Other columns are left out.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        found = materialize(repeated_windows(docs.filter("doc_id IS NOT NULL"), window, hot), "repeats", keep=True)
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(found, "text_key"))
    ranges = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))  # as long as the document at most

    # The bitmap keeps texts without repeats out of the shuffle; the join decides about the rest.
    marked = docs.mapInArrow(_marked(bitmap), "doc_id bigint, text_key bigint, text string").join(ranges, ["doc_id", "text_key"], "left")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    clean = docs.mapInArrow(_clean(bitmap), schema)
    return clean.unionByName(marked.mapInArrow(_cut(window), schema))


def _marked(bitmap):
    """Passes on the rows that may have repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, batch["text_key"].to_numpy())))

    return run


def _clean(bitmap):
    """Results of the rows that have no repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            batch = batch.filter(pa.array(~in_bitmap(bitmap.value, batch["text_key"].to_numpy())))
            if batch.num_rows:
                rows = _normal(batch)[0]
                counts = [r.count(b" ") + 1 if r else 0 for r in rows]
                yield _kept(batch["doc_id"], counts, [0] * len(rows), rows)

    return run


def _cut(window: int):
    """Removes the words in each row's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts, removed, kept = [], [], []
            for row, ranges in zip(_normal(batch)[0], batch["ranges"].to_pylist(), strict=True):
                found = row.split()
                counts.append(len(found))
                if ranges:
                    drop = np.zeros(len(found) + 1, np.int64)
                    for r in ranges:
                        drop[r["at"]] += 1
                        drop[r["at"] + r["n"] + window - 1] -= 1
                    found = [found[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                removed.append(counts[-1] - len(found))
                kept.append(b" ".join(found))
            yield _kept(batch["doc_id"], counts, removed, kept)

    return run


def _kept(ids: pa.Array, counts: list[int], removed: list[int], kept: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows that smaller doc_ids have."""
    kept = kept_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 49), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
hit AS (SELECT a.doc_id, a.p FROM win a JOIN (SELECT s, min(doc_id) AS m FROM win GROUP BY s) b ON a.s = b.s AND b.m < a.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
kept AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) u ANTI JOIN gone USING (doc_id, i)
  GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
