"""Shared pieces of the training-data operators.

Tables between steps are written to the folder that all executors share and
read again, which cuts lineage: a lost executor costs a re-read, no more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.operators import running
from payguard.operators.running import Rounds, new_path, prefix_sums, scratch, shared_dir

__all__ = ["Rounds", "new_path", "prefix_sums", "scratch", "shared_dir"]
#: Bytes of text that one vectorised step holds at a time inside a task.
CHUNK_BYTES = 1 << 19
#: Rows of one Arrow batch between Spark and Python, at most.
BATCH_ROWS = 2000
#: Bits (as a power of two) of a membership bitmap that is sent to every task: at least and at most, 128 KB and 16 MB.
LEAST_BITS, MOST_BITS = 20, 27
#: Nodes of a graph whose neighbours' minima are sent to every task, at most.
HUBS = 10_000
_BLOCK = 32768  # bits that one bitmap_construct_agg row holds


def bound_batches(spark: SparkSession) -> None:
    """Keep this session's Arrow batches at BATCH_ROWS rows or what it has set below that; Spark's default of 10,000 long texts is too much for a small executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again; see scratch() for keep."""
    bound_batches(df.sparkSession)
    return running.written(df, name, keep)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it as long as df has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(df: DataFrame) -> Column:
    """All columns of df as one struct, under which no name can clash; `row.*` gives them back."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `limit` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 row offsets into them; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def bitmap_bits(keys: int) -> int:
    """Size of a bitmap for so many keys: 16 bits a key up to MOST_BITS, beyond which it lets more through."""
    return min(max(math.ceil(math.log2(max(1, keys))) + 4, LEAST_BITS), MOST_BITS)


def bitmap_of(values: DataFrame, column: str) -> np.ndarray:
    """Membership bitmap of a bigint column, sized by its rows, 16 MB at most.

    Built by partial aggregation on the executors. A test on it may say yes
    wrongly, never no wrongly; what it lets through must still be decided.
    """
    bits = bitmap_bits(values.count())
    slot = F.expr(f"CAST({column} & {(1 << bits) - 1}L AS BIGINT)")
    rows = values.select((F.floor(slot / F.lit(_BLOCK))).cast("long").alias("block"), (slot % _BLOCK).alias("bit"))
    blocks = rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in blocks:
        at = row["block"] * (_BLOCK // 8)
        piece = np.frombuffer(bytes(row["bits"]), np.uint8)
        size = min(len(piece), len(out) - at)
        out[at : at + size] = piece[:size]
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 or uint64 keys the bitmap may hold."""
    slot = keys.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_column(bitmap: np.ndarray, spark: SparkSession, column: Column) -> Column:
    """Whether the bitmap may hold a bigint column's value; false for null."""
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(bitmap)

    def run(keys: pa.Array) -> pa.Array:
        values = keys.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(in_bitmap(sent.value, values) & ~keys.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "boolean")(column)


def _with_least(edges: DataFrame, least: DataFrame, most: int | None) -> DataFrame:
    """edges (a, b) with m of their a, from least (a, m, n). Nodes of more than `most` edges, HUBS at most, are sent to all tasks, so that no task gets a hub's edges."""
    if most is None:
        return edges.join(least, "a")
    hubs = F.broadcast(least.filter(F.col("n") > most).select("a", "m"))
    rest = edges.join(hubs, "a", "left_anti").join(least.filter(F.col("n") <= most).select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(rest)


def _state(now: DataFrame) -> tuple:
    """Number of edges, greatest number of edges to one smaller node, and a checksum of all edges."""
    by = now.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    return tuple(by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.sum("s")).first())


def components(edges: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Connected components of undirected bigint edges (a, b): rows (id, component), the smallest id reachable. Edges with a null are left out.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each
    round is written out, so lineage stays flat, and replaces the one before.
    No group is collected: a node's neighbours meet in a partial min, and the
    joins send what belongs to hubs to the edges' own tasks.
    """
    rounds = Rounds(edges.sparkSession, name, keep)
    now = rounds.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        most = max(64, math.ceil(2 * state[0] / HUBS))
        if state[1] <= most:
            most = None  # no hub
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both, low, most).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = rounds.put(small.filter("a <> b").distinct())
        seen, state = state, _state(now)
        if state == seen:
            found = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
            return found.union(found.select("component", "component").distinct())


def chunked(function: Callable[[pa.Array], list], text: pa.Array) -> list:
    """function over pieces of at most CHUNK_BYTES of text, one row at least; the results' rows joined."""
    out, start, offsets = [], 0, text_buffer(text)[1]
    while start < len(text):
        stop = min(max(int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1, start + 1), len(text))
        out += function(text.slice(start, stop - start))
        start = stop
    return out
