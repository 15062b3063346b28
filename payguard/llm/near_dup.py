"""Near-duplicate groups by HyperMinHash.

Each document's shingle set becomes 384 registers: the leading-zero count and
10 mantissa bits of the least hash in each of 384 buckets, empty buckets
filled from others. 64 bands of 6 registers find candidates: at a similarity
of 0.75 a pair shares no band with a probability of 4e-6. Within a band's
bucket, sizes and the collision-corrected Jaccard estimate from 64 of the
registers drop pairs that cannot be similar, and what is left is confirmed on
the full sets.

Documents with equal sets are one node. Candidates are kept as spanning edges
of a bucket, never as all its pairs. Buckets and candidate groups of any size
are compared in blocks of bounded size; see _across().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm import words as W
from payguard.llm.common import as_row, bitmap_column, bitmap_of, bound_batches, components, in_bitmap, materialize, scratch, text_buffer, text_slices

BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Registers that travel to the buckets for the estimate: every sixth, so that no band has more than one of them.
SEEN = 64
#: Members of a band's bucket that one task compares with each other; larger buckets are cut into blocks of this size.
BUCKET = 4096
#: The same for candidate groups, whose members have their full sets, and bytes of those.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Groups whose numbers are sent to all tasks, at most; a row each.
SENT = 100_000
#: Pivots of a group that is cut into blocks, on average.
PIVOTS = 8
_EMPTY = np.iinfo(np.uint64).max
_U = np.uint64
_TRIES = np.stack([(W.mix(np.arange(REGISTERS, dtype=_U) * _U(977) + _U(1_000_003 * t)) % _U(REGISTERS)).astype(np.int64) for t in range(1, 65)])
_RANK = W.mix(np.arange(REGISTERS * REGISTERS, dtype=_U) + _U(1 << 40)).reshape(REGISTERS, REGISTERS)
#: Chance that unequal minima of a bucket give equal registers, 0.1699 * 2**-bits for sets of like size (Yu and Weber, 2017).
COLLISION = 0.1699 * 2.0**-MANTISSA


def registers(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash registers (n x 384, uint16) of the sets of rows 0 to n-1; sets without members have zeros."""
    least = np.full(n * REGISTERS, _EMPTY, _U)
    bucket = ((hashes >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    np.minimum.at(least, row * REGISTERS + bucket, W.mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(1))
    least = least.reshape(n, REGISTERS)
    filled = least.copy()
    some = (least != _EMPTY).any(axis=1)
    r, j = np.nonzero((least == _EMPTY) & some[:, None])
    for tries in _TRIES:
        if not len(r):
            break
        got = least[r, tries[j]]
        hit = got != _EMPTY
        filled[r[hit], j[hit]] = got[hit]
        r, j = r[~hit], j[~hit]
    for doc in np.unique(r).tolist():  # sets of few members: of the buckets that have one, that of the least rank
        todo, have = j[r == doc], np.flatnonzero(least[doc] != _EMPTY)
        filled[doc, todo] = least[doc, have[_RANK[todo][:, have].argmin(axis=1)]]
    zeros = 63 - np.floor(np.log2(np.maximum(filled, _U(1)).astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63).astype(_U)
    mantissa = (filled << np.minimum(zeros + _U(1), _U(63))) >> _U(64 - MANTISSA)
    out = ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)
    out[~some] = 0
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 40-bit key of each band (n x 64), short because each one is shuffled; a chance collision costs a comparison, no more.

    A band's registers lie far apart, so that a filled run is not one band.
    """
    parts = regs.astype(_U).reshape(len(regs), ROWS, BANDS)
    key = np.arange(BANDS, dtype=_U) << _U(50)
    for k in range(ROWS):
        key = W.mix(key ^ parts[:, k]) if k == 0 else W.mix((key << _U(7) | key >> _U(57)) ^ parts[:, k])
    return key >> _U(24)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers among the SEEN ones, corrected for equal registers of unequal minima."""
    return (equal / SEEN - COLLISION) / (1 - COLLISION)


def least_estimate(size: np.ndarray, threshold: float) -> np.ndarray:
    """What the estimate of a pair at the threshold stays above, but for one in ten million; small sets, whose registers repeat each other, vary more."""
    return threshold - 5.2 * np.sqrt(threshold * (1 - threshold) / np.minimum(np.maximum(size, 1), SEEN))


_SIGNATURE = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, registers binary, bands array<bigint>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit set fingerprint, registers for the estimate and band keys of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n = batch.num_rows
            row, got = W.shingles(*text_buffer(batch["text"]))
            f1, f2 = np.zeros(n, _U), np.zeros(n, _U)
            np.add.at(f1, row, W.mix(got + _U(11)))
            np.add.at(f2, row, W.mix(got ^ _U(0xC0FFEE0DDBA11CAD)))
            regs = registers(row, got, n)
            bands = band_keys(regs).view(np.int64)
            seen = [x.tobytes() for x in np.ascontiguousarray(regs[:, :: REGISTERS // SEEN])]
            columns = [batch["doc_id"].cast(pa.int64()), pa.array(np.bincount(row, minlength=n)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(seen, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f1", "f2", "registers", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNATURE)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """Batches regrouped so that rows of one key, which lie together, are not cut; each item is a list of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        if held and keys[0] != last:
            yield held
            held = []
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield [*held, batch.slice(0, cut)]
            held = []
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield held


def shingle_sets(docs: DataFrame, wanted) -> DataFrame:
    """Sorted shingle hashes, 8 bytes each, of the rows whose doc_id the bitmap may hold: node, members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch["doc_id"].to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                row, got = W.shingles(*text_buffer(batch["text"]))
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                data = [got[lo:hi].tobytes() for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(data, pa.binary())], ["node", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "node bigint, members binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Exact sizes of the intersections of sorted sets: left x right, or left x left."""
    sets = left + (right or [])
    if len(sets) == 2:
        both = np.concatenate(sets)
        both.sort()
        n = int((both[1:] == both[:-1]).sum())
        return np.array([[n]]) if right else np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    everything = np.concatenate(sets) if sets else np.zeros(0, _U)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    new = np.ones(len(everything), np.bool_)
    new[1:] = everything[1:] != everything[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, np.bool_)
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    n, k = len(left), len(sets)
    out = np.zeros((n, k - n if right is not None else n), np.float64)
    for lo in range(0, int(column.max(initial=-1)) + 1, 8192):
        here = slice(*np.searchsorted(column, [lo, lo + 8192]))
        block = np.zeros((k, 8192), np.float32)
        block[owner[here], column[here] - lo] = 1
        out += block[:n] @ (block[n:] if right is not None else block).T
    out = out.round().astype(np.int64)
    if right is None:
        np.fill_diagonal(out, [len(s) for s in left])
    return out


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * inter >= percent * (a[:, None] + b[None, :] - inter)


def _labels(link: np.ndarray) -> np.ndarray:
    """Component (least position) of each row of a symmetric link matrix."""
    label = np.full(len(link), -1)
    for i in range(len(link)):
        if label[i] < 0:
            label[i], front = i, [i]
            while front:
                new = np.flatnonzero(link[front.pop()] & (label < 0))
                label[new] = i
                front += new.tolist()
    return label


def _labels_across(link: np.ndarray) -> np.ndarray:
    """Component (least position) of each row, then of each column, of a matrix of links between two sides."""
    left, right = np.full(len(link), -1), len(link) + np.arange(link.shape[1])
    free = np.ones(link.shape[1], np.bool_)
    for i in range(len(link)):
        front = np.array([i]) if left[i] < 0 else np.zeros(0, np.int64)
        while len(front):
            left[front] = i
            reached = np.flatnonzero(link[front].any(axis=0) & free)
            free[reached], right[reached] = False, i
            front = np.flatnonzero(link[:, reached].any(axis=1) & (left < 0))
    return np.concatenate([left, right])


class NearRegisters:
    """Links of pairs that may reach the threshold, by size and estimate. Payload: 4 bytes of size, then the registers."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def load(self, payload: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(b"".join(payload.to_pylist()), np.uint8).reshape(len(payload), 4 + 2 * SEEN)
        return np.ascontiguousarray(rows[:, :4]).view(">u4")[:, 0].astype(np.int64), np.ascontiguousarray(rows[:, 4:]).view(np.uint16)

    def pairs(self, loaded: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j are linked, one by one."""
        size, regs = loaded
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        return (low >= self.threshold * high - 1e-9) & (estimate((regs[i] == regs[j]).sum(axis=1)) >= least_estimate(high, self.threshold))

    def spanning(self, loaded: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Component (least position) of each row; a row that is reached is not compared again with those before."""
        label, left = np.arange(len(rows)), np.arange(len(rows))
        while len(left) > 1:
            root, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                near = self.pairs(loaded, np.full(len(left), rows[front.pop()]), rows[left])
                label[left[near]] = root
                front += left[near].tolist()
                left = left[~near]
        return label

    def matrix(self, loaded: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether rows of left and right are linked, each with each."""
        out = np.zeros((len(left), len(right)), np.bool_)
        step = max(1, 65_536 // len(right))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            out[at : at + step] = self.pairs(loaded, np.repeat(some, len(right)), np.tile(right, len(some))).reshape(len(some), len(right))
        return out


class EqualShare:
    """Links of pairs of sets whose similarity is `percent` or more, exactly. Payload: the sorted shingle hashes."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def load(self, payload: pa.ChunkedArray) -> list[np.ndarray]:
        return [np.frombuffer(x, _U) for x in payload.to_pylist()]

    def pairs(self, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.array([self.matrix(sets, np.array([a]), np.array([b]))[0, 0] for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.bool_)

    def spanning(self, sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        return _labels(self.matrix(sets, rows, rows))

    def matrix(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = [sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()]
        same = len(left) == len(right) and bool((left == right).all())
        return linked(intersections(a, None if same else b), np.array([len(x) for x in a]), np.array([len(x) for x in b]), self.percent)


def _edges(groups: DataFrame, links: NearRegisters | EqualShare) -> DataFrame:
    """Edges (a, b) that connect what is linked within each group. groups: g (bigint), side (0: all with all; 1 against 2), node, payload; a group fits a task.

    b is the first of what a is connected with: of side 1 before side 2, then by node, so that overlapping groups give the same edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, "g"):
            table = pa.Table.from_batches(group)
            key, side, node = (table[c].to_numpy() for c in ("g", "side", "node"))
            loaded = links.load(table["payload"])
            start = np.append(0, np.flatnonzero(np.diff(key)) + 1)
            length = np.diff(np.append(start, len(key)))
            # Most groups are pairs, which are compared all at once.
            pair = start[length == 2]
            pair = pair[(side[pair] == 0) | (side[pair] != side[pair + 1])]
            hit = pair[links.pairs(loaded, pair, pair + 1)] if len(pair) else pair
            a, b = [node[hit + 1]], [node[hit]]
            for lo, n in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
                rows = np.arange(lo, lo + n)
                if side[lo] == 0:
                    label = links.spanning(loaded, rows)
                else:
                    middle = int(np.searchsorted(side[lo : lo + n], 2))
                    if middle in (0, n):
                        continue
                    label = _labels_across(links.matrix(loaded, rows[:middle], rows[middle:]))
                other = np.flatnonzero(label != np.arange(n))
                a.append(node[lo + other])
                b.append(node[lo + label[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return groups.select("g", "side", "node", "payload").repartition("g").sortWithinPartitions("g", "side", "node").mapInArrow(run, "a bigint, b bigint").filter("a <> b").distinct()


def _sent(groups: DataFrame) -> DataFrame:
    """A row for each group, sent to all tasks while there are SENT at most; then a join by key would put each large group in a task. Beyond, there are keys enough for all tasks, and joins split a large one."""
    return F.broadcast(groups) if groups.count() <= SENT else groups


def _across(members: DataFrame, blocks: DataFrame, links: NearRegisters | EqualShare) -> DataFrame:
    """Edges that connect what is linked within groups that are too large for a task.

    members: key, node, payload; blocks: key, k (members), cells (how many
    blocks the group is cut into). All members are first compared with a few
    pivots; what is connected with the pivot that has most members needs no
    more comparison. Each other member is compared with all, block against
    block, so no link is lost and no task has more than two blocks.
    """
    blocks = _sent(blocks)
    cells = members.join(blocks, "key")
    place = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("cells").cast("int") - 1)).alias("p")
    pivots = cells.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")) < PIVOTS)
    first = cells.select(F.xxhash64("key", place).alias("g"), F.lit(2).alias("side"), "node", "payload")
    first = first.unionByName(pivots.select("key", "node", "payload", each).select(F.xxhash64("key", "p").alias("g"), F.lit(1).alias("side"), "node", "payload"))
    found = materialize(_edges(first, links), "pivot-edges")

    # Which members lie outside is found on ids alone; payloads are joined once, and only where some do.
    near = found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("pivot"))
    ids = cells.select("key", "k", "cells", "node").join(near, "node", "left")
    parts = ids.filter("pivot IS NOT NULL").groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("main"), F.max("n").alias("n"))
    ids = ids.join(_sent(main), "key", "left")
    ids = ids.select("key", "node", "cells", F.coalesce((F.col("pivot") != F.col("main")) & (F.col("node") != F.col("main")), F.col("node") != F.coalesce("main", F.lit(-1))).alias("apart"), F.greatest(F.lit(1), F.ceil((F.col("k") - F.coalesce("n", F.lit(0))) * F.col("cells") / F.col("k"))).cast("int").alias("strips"))
    ids = materialize(ids, "large-ids")
    if not ids.filter("apart").limit(1).count():
        return found
    todo = ids.join(_sent(ids.filter("apart").select("key").distinct()), "key", "left_semi")
    todo = materialize(members.join(todo, ["key", "node"]), "large-groups")
    outside = todo.filter("apart").select("key", F.pmod(F.xxhash64("node", F.lit(2)), F.col("strips")).cast("int").alias("u"), each, F.lit(1).alias("side"), "node", "payload")
    against = todo.select("key", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("u"), place.alias("p"), F.lit(2).alias("side"), "node", "payload")
    rest = outside.unionByName(against).select(F.xxhash64("key", "u", "p").alias("g"), "side", "node", "payload")
    return found.unionByName(_edges(rest, links))


def _shared(block: int):
    """Of rows sorted by key, those whose key is another row's too, with the number of their block: each holds `block` rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None  # the last row, where its key has not come twice yet
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch["key"].to_numpy(), batch["node"].to_numpy()
            start = np.append(0, np.flatnonzero(np.diff(key)) + 1)
            length = np.diff(np.append(start, len(key)))
            before = np.zeros(len(key), np.int64)
            first = int(length[0])
            goes_on = last is not None and key[0] == last
            if goes_on:
                before[:first] = seen
            place = before + np.arange(len(key)) - np.repeat(start, length)
            keep = np.repeat(length > 1, length)
            if goes_on:
                keep[:first] = True
                if held is not None:
                    yield _rows([held[0]], [held[1]], [0])
            held = None
            seen = (seen if goes_on and len(length) == 1 else 0) + int(length[-1])
            last = key[-1]
            if seen == 1:
                held = (int(key[-1]), int(node[-1]))
            yield _rows(key[keep], node[keep], place[keep] // block)

    return run


def _rows(key, node, block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(block, pa.int64())], ["key", "node", "block"])


def candidates(nodes: DataFrame, threshold: float, block: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect, within each band bucket, all pairs that may reach the threshold. nodes: node, n_shingles, registers, bands.

    Most buckets have one member; only the others' members are joined with
    their registers. A bucket's members are numbered as they stream by, and
    compared in blocks.
    """
    dealt = nodes.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    shared = materialize(dealt.mapInArrow(_shared(block), "key bigint, node bigint, block bigint"), "buckets")
    payload = nodes.select("node", F.concat(F.unhex(F.lpad(F.hex("n_shingles"), 8, "0")), "registers").alias("payload"))
    links = NearRegisters(threshold)
    near = _edges(shared.join(payload, "node").select(F.xxhash64("key", "block").alias("g"), F.lit(0).alias("side"), "node", "payload"), links)
    large = shared.filter("block > 0").groupBy("key").agg(F.count(F.lit(1)).alias("more"), (F.max("block") + 1).alias("cells")).select("key", (F.col("more") + block).alias("k"), "cells")
    if not large.limit(1).count():
        return near
    large = materialize(large, "large-buckets")
    members = materialize(shared.join(_sent(large.select("key")), "key").join(payload, "node").select("key", "node", "payload"), "large-members")
    return near.unionByName(_across(members, large, links))


def near_duplicates(docs: DataFrame, percent: int = 75, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """Groups of documents connected by links of `percent` similarity or more; one row for each row of (doc_id, text).

    Result: doc_id, n_shingles, component_id (the least doc_id reachable),
    kept (doc_id = component_id). Null or wordless texts link with nothing.
    Rows of a null doc_id link with nothing, have a null component_id and are
    kept. Rows of one doc_id are one document. Other columns are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    found = materialize(signatures(docs), "signatures")
    named = found.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    with scratch(spark):
        nodes = materialize(nodes, "nodes", keep=True)
        with scratch(spark):
            groups = components(candidates(nodes, percent / 100, bucket), "candidates", keep=True).select(F.col("id").alias("node"), F.col("component").alias("key"))
        groups = materialize(groups.join(nodes.select("node", "n_shingles"), "node"), "candidate-groups")
        sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(8 * F.sum("n_shingles") / block_bytes)).alias("cells"))
        wanted = spark.sparkContext.broadcast(bitmap_of(groups, "node"))
        sets = shingle_sets(docs.filter("doc_id IS NOT NULL"), wanted).join(groups.select("node", "key").join(sizes, "key"), "node")
        sets = materialize(sets, "sets")
        links = EqualShare(percent)
        edges = _edges(sets.filter("cells = 1").select(F.col("key").alias("g"), F.lit(0).alias("side"), "node", F.col("members").alias("payload")), links)
        large = sets.filter("cells > 1")
        if large.limit(1).count():
            edges = edges.unionByName(_across(large.select("key", "node", F.col("members").alias("payload")), large.select("key", "k", "cells").distinct(), links))
        parts = components(edges, "links", keep=True).withColumnsRenamed({"id": "node"})
    classes = nodes.select("f1", "f2", "n_shingles", "node").join(parts, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the near duplicates: of each group the row of the least doc_id stays, with all its columns, whatever their names and types.

    Of repeated rows of one doc_id, the one whose JSON form is least stays.
    Rows of a null doc_id and of texts without words stay. An empty table
    stays empty. Only rows that a bitmap of the affected doc_ids marks are
    shuffled.
    """
    found = near_duplicates(docs, percent).filter("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).filter("n > 1 OR NOT kept")
    gone = materialize(gone, "near-duplicates")
    rows = docs.select(as_row(docs))
    marked = rows.withColumn("maybe", bitmap_column(bitmap_of(gone, "doc_id"), docs.sparkSession, F.col("row.doc_id").cast("bigint")))
    tested = marked.filter("maybe").withColumn("doc_id", F.col("row.doc_id")).join(gone, "doc_id", "left")
    once = tested.filter("n IS NULL OR (kept AND n = 1)").select("row")
    repeated = tested.filter("kept AND n > 1").groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return marked.filter("NOT maybe").select("row").unionByName(once).unionByName(repeated).select("row.*")


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)
"""
