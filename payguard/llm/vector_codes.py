"""Vector codes: each vector as four indices into codebooks of its parts, fitted in whole numbers.

Equal parts of one position are one row with a weight. These rows are dealt in
lexicographic order, so that each task holds a stretch of the trie over the
parts' components, and walks it depth first: a node's distances to all
codebook entries are its parent's and one more square, computed once for all
parts with that prefix. At the leaves the nearest entry gets the part's weight
and weighted components. Only the codebooks, whose size is fixed, go to the
driver and to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm.common import bound_batches, materialize

#: Components are floor(SCALE * x); a vector has PARTS parts; a codebook has ENTRIES entries at most and is fitted in ROUNDS rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components from here on cannot be told apart by a double and are taken for non-finite.
TOO_LARGE = 1 << 52
#: Leaves of the trie that are visited at a time.
LEAVES = 512


class Trie:
    """Distances of lexicographically sorted parts to the entries of a codebook, a block of leaves at a time.

    The last node's distances at each depth are kept from block to block, as
    the stack of a depth-first walk.
    """

    def __init__(self, codebook: np.ndarray) -> None:
        self.codebook = codebook
        self.path: np.ndarray | None = None
        self.stack: list[np.ndarray] = []

    def visit(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part, ties to the lower index, and its squared distance."""
        width = leaves.shape[1]
        kind = self._kind(leaves)
        new = np.ones((len(leaves), width), np.bool_)  # whether a part has another prefix of this length than the one before it
        new[1:] = np.logical_or.accumulate(leaves[1:] != leaves[:-1], axis=1)
        known = self.path is not None and self.stack[0].dtype == kind
        if known:
            new[0] = np.logical_or.accumulate(leaves[0] != self.path)
        above, node = np.zeros((1, len(self.codebook)), kind), np.zeros(len(leaves), np.int64)
        stack = []
        for depth in range(width):
            at = np.flatnonzero(new[:, depth])
            step = leaves[at, depth].astype(kind)[:, None] - self.codebook[:, depth].astype(kind)[None, :]
            below = above[node[at]] + step * step
            if not new[0, depth]:
                below = np.concatenate([self.stack[depth][None, :], below])
            node = np.cumsum(new[:, depth]) - new[0, depth]
            stack.append(below[-1])
            above = below
        self.path, self.stack = leaves[-1], stack
        best = above.argmin(axis=1)
        return best[node], above[np.arange(len(above)), best][node]

    def _kind(self, leaves: np.ndarray) -> type:
        """The narrowest type that no distance passes; plain integers where 64 bits could be passed."""
        most = max(int(np.abs(x).max()) for x in (leaves, self.codebook))
        bound = leaves.shape[1] * (2 * most) ** 2
        return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of each part: the trie over the distinct ones, and back to all rows."""
    distinct, inverse = np.unique(parts, axis=0, return_inverse=True)
    trie = Trie(codebook)
    found = [trie.visit(distinct[i : i + LEAVES]) for i in range(0, len(distinct), LEAVES)]
    code, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    inverse = inverse.reshape(-1)
    return code[inverse], distance[inverse]


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the kept rows, x the whole-number components, padded with zeros to a multiple of PARTS.

    Rows whose vector is null or holds null, non-finite or too large
    components are left out; so are those whose vector has another length
    than the kept one of the least vec_id, as they have no parts in common.
    """
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < TOO_LARGE // SCALE), F.lit(False)))
    rows = embeddings.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), x.cast("array<bigint>").alias("x"))
    least = rows.agg(F.min_by(F.size("x"), F.struct(F.col("vec_id").isNull(), "vec_id", "x"))).first()[0]
    if not least:
        return rows.filter("false")
    return rows.filter(F.size("x") == least).withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), -least % PARTS)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distinct_parts(vectors: DataFrame) -> DataFrame:
    """(position, part, weight) of all parts, dealt and sorted in lexicographic order; written."""
    spark = vectors.sparkSession
    width = F.size("x") / PARTS
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("x", (i * width + 1).cast("int"), width.cast("int")))
    counted = vectors.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(counted.repartitionByRange(n, "position", "part").sortWithinPartitions("position", "part"), "vector-parts")


def first_codebooks(vectors: DataFrame, entries: int) -> list[np.ndarray]:
    """The parts of the `entries` smallest vec_ids. Ids are found first, so that few vectors go to the driver; repeated ids are taken in the order of their vectors, null ids last."""
    ids = [r[0] for r in vectors.select("vec_id").filter("vec_id IS NOT NULL").orderBy("vec_id").limit(entries).collect()]
    some = vectors.filter(F.col("vec_id") <= ids[-1]) if len(ids) == entries else vectors
    rows = some.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    whole = np.array([r[0] for r in rows], np.int64)
    return np.split(whole, PARTS, axis=1)


def next_codebooks(parts: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: all parts to their nearest entries, then each used entry to the floor of its parts' mean."""
    spark = parts.sparkSession
    sent = spark.sparkContext.broadcast(codebooks)
    width = codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        tries = [Trie(c) for c in sent.value]
        for batch in batches:
            position, leaves, weight = batch["position"].to_numpy(), _matrix(batch["part"]), batch["weight"].to_numpy()
            for p in np.unique(position).tolist():
                here = np.flatnonzero(position == p)
                for i in range(0, len(here), LEAVES):
                    block = here[i : i + LEAVES]
                    code, _ = tries[p].visit(leaves[block])
                    exact = np.abs(leaves[block]).max(initial=0) * int(weight[block].sum()) < 1 << 62
                    for c in np.unique(code).tolist():
                        mine = block[code == c]
                        x, w = leaves[mine], weight[mine]
                        total = (x * w[:, None]).sum(axis=0) if exact else (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)
                        have = sums.setdefault((p, c), [0, [0] * width])
                        have[0] += int(w.sum())
                        have[1] = [a + int(b) for a, b in zip(have[1], total, strict=True)]
        rows = [(p, c, n, d, s) for (p, c), (n, total) in sums.items() for d, s in enumerate(total)]
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(map(str, c) if t == pa.string() else c, t) for c, t in zip(columns, kinds, strict=True)], ["position", "entry", "n", "dimension", "total"])

    found = parts.mapInArrow(run, "position int, entry int, n bigint, dimension int, total string")
    found = found.groupBy("position", "entry", "dimension").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [c.copy() for c in codebooks]
    for r in found.collect():  # as many as the codebooks' components
        out[r["position"]][r["entry"], r["dimension"]] = int(r["total"]) // r["n"]
    return out


def codebooks_of(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks fitted to whole_vectors()."""
    books = first_codebooks(vectors, entries)
    parts = distinct_parts(vectors)
    for _ in range(rounds):
        books = next_codebooks(parts, books)
    return books


def digest_of(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in codebooks for v in book.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """whole_vectors() with code and error: a trie over each batch's distinct parts, so no vector is moved. An error beyond 64 bits is null."""
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch["x"])
            found = [nearest(part, book) for part, book in zip(np.split(x, PARTS, axis=1), sent.value, strict=True)]
            codes = np.stack([c for c, _ in found], axis=1).tolist()
            errors = [sum(e) for e in zip(*(d.tolist() for _, d in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([bytes(c).hex() for c in codes]), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], ["row", "code", "error"])

    rows = vectors.select(F.struct("vec_id", "label").alias("row"), "x")
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, code string, error bigint")
    return out.select("row.vec_id", "row.label", "code", "error")


def compress(embeddings: DataFrame) -> DataFrame:
    """Codes of all kept rows of (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    See whole_vectors() for the rows left out. Repeated and null vec_ids keep
    a row each; fewer than ENTRIES rows give smaller codebooks; rows of a null
    label count together; an empty table gives an empty one. Other columns
    are not read. label_error is null where a label's sum passes 64 bits.
    """
    bound_batches(embeddings.sparkSession)
    vectors = materialize(whole_vectors(embeddings.select("vec_id", "embedding", "label")), "vectors")
    if vectors.isEmpty():
        return vectors.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    books = codebooks_of(vectors)
    coded = materialize(encode(vectors, books), "vector-codes")
    by_label = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql() -> str:
    """CTEs a0, b1, a1, ... : assignments to the codebooks b0, b1, ..., each from the one before."""
    out = []
    for k in range(ROUNDS + 1):
        square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, position, any_value(x) AS x, min({{'d': {square}::BIGINT, 'e': entry}}) AS best FROM parts JOIN b{k} USING (position) GROUP BY vec_id, position)")
        if k < ROUNDS:
            out.append(f"""
m{k} AS (SELECT position, best.e AS entry, dim, floor_div(sum(x[dim])::BIGINT, count(*)) AS v FROM a{k}, (SELECT unnest(range(1, len(x) + 1)) AS dim FROM parts LIMIT (SELECT len(x) FROM parts LIMIT 1)) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT position, entry, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT position, entry, list(v ORDER BY dim) AS c FROM m{k} GROUP BY ALL) n USING (position, entry))""")
    return ",".join(out)


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS MATERIALIZED (SELECT vec_id, position, v[position * len(v) // {PARTS} + 1 : (position + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(position)),
b0 AS MATERIALIZED (
  SELECT position, entry, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{_rounds_sql()},
whole AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY position) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), whole
""".replace("floor_div(sum(x[dim])::BIGINT, count(*))", "(sum(x[dim])::BIGINT - ((sum(x[dim])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)")
