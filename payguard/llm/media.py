"""Media columns: content-addressed payloads in tar shards.

Each payload is stored once per shard under its digest. Rows carry digest,
shard, offset and length; range reads of the header alone fill the metadata
columns, and range reads of the whole entry give the payload back.

The stored form is an 8-bit greyscale PNG of 64 samples a row, so a payload is
a positive multiple of 64 bytes and the file is lossless and compressed.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm.common import CHUNK_BYTES, bound_batches, materialize, new_path, text_buffer, text_slices

WIDTH = 64
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, the IHDR chunk's length, name, body and checksum.
HEADER_BYTES = len(_SIGNATURE) + 4 + 4 + 13 + 4


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode_png(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as an 8-bit greyscale PNG, each row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict:
    """Width, height and bit depth from the first bytes of a PNG."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return {"width": width, "height": height, "bit_depth": depth}


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that encode_png made; checksums are verified."""
    at, body = len(_SIGNATURE), []
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + chunk):
            raise ValueError("a PNG chunk is damaged")
        if name == b"IDAT":
            body.append(chunk)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a PNG row is filtered")
    return lines[:, 1:].tobytes()


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def feature(payload: bytes) -> str:
    """Byte statistics of a payload: mean, deviation, distinct values, entropy in bits, mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).sum() / max(1, len(x) - 1)
    return f"mean={x.mean():.4f};std={x.std():.4f};distinct={len(p)};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};step={step:.4f}"


class ShardWriter:
    """Tar shards of one task, named by its place and attempt. A retried task writes files of other names, and only its rows are kept."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        task = TaskContext.get()
        self.task = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        self.file, self.name, self.at, self.shards = None, "", 0, 0
        self.placed: dict[bytes, tuple[str, int, int]] = {}

    def put(self, data: bytes) -> tuple[bytes, str, int, int]:
        """Store data unless this shard has it: digest, shard, offset of its first byte, length."""
        digest = hashlib.sha256(data).digest()
        if digest not in self.placed:
            if self.file is None or self.at >= SHARD_BYTES:
                self.close()
                self.name = f"{self.task}-{self.shards}.tar"
                self.shards += 1
                self.file, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}"), 0
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.file.write(head + data + bytes(-len(data) % 512))
            self.placed[digest] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return digest, *self.placed[digest]

    def close(self) -> None:
        if self.file is not None:
            self.file.write(bytes(1024))
            self.file.close()
        self.file, self.placed = None, {}


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of (doc_id, text) rows into tar shards under `folder`, a URI that all executors reach.

    Result, a row each: doc_id, n_bytes, digest, shard, offset, length. Null
    text is empty (64 zero bytes), a null doc_id stays null, repeated rows
    repeat, other columns are left out. A task keeps the digests of its open
    shard alone. The rows are written before they are used, so a recomputed
    task cannot point at shards that another attempt has written.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        for batch in text_slices(batches):
            buffer, offsets = text_buffer(batch["text"])
            placed = [writer.put(encode_png(padded(buffer[a:b].tobytes()))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            digests, shards, starts, lengths = zip(*placed, strict=True)
            columns = [batch["doc_id"].cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), pa.array(shards), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, digest binary, shard string, offset bigint, length bigint"), "manifest")


def locations(manifest: DataFrame) -> DataFrame:
    """One place for each digest: the least (shard, offset). Copies meet in a partial min, however many there are."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def dealt(places: DataFrame) -> DataFrame:
    """Entries of one shard lie beside each other, in file order; ranges may split a large shard over tasks."""
    n = max(2, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return places.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], folder: str, head_only: bool) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the bytes of its entries: the header's alone, or whole ones; a shard is opened once as long as its rows lie together. Whole entries come in pieces of a few MB."""
    fs, path = pafs.FileSystem.from_uri(folder)
    name, file = None, None
    for batch in batches:
        start, held, out = 0, 0, []
        for i, (shard, offset, length) in enumerate(zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length")), strict=True)):
            if shard != name:
                if file is not None:
                    file.close()
                name, file = shard, fs.open_input_file(f"{path}/{shard}")
            out.append(file.read_at(min(HEADER_BYTES, length) if head_only else length, offset))
            held += len(out[-1])
            if held > CHUNK_BYTES:
                yield batch.slice(start, i + 1 - start), out
                start, held, out = i + 1, 0, []
        if out:
            yield batch.slice(start), out
    if file is not None:
        file.close()


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


_PLACE = "digest binary, shard string, offset bigint, length bigint"
_META = f"{_PLACE}, width int, height int, bit_depth int"


def header_columns(places: DataFrame, folder: str) -> DataFrame:
    """Places (digest, shard, offset, length) with width, height and bit_depth, from range reads of the header bytes alone. dealt() puts entries of a shard beside each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in _ranges(batches, folder, True):
            heads = [png_header(x) for x in data]
            yield _with(batch, {k: pa.array([h[k] for h in heads], pa.int32()) for k in ("width", "height", "bit_depth")})

    return places.select("digest", "shard", "offset", "length").mapInArrow(run, _META)


def payload_columns(entries: DataFrame, folder: str) -> DataFrame:
    """Entries of header_columns() with digests and features of their payload, from range reads of the whole entries. The payload must have the header's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in _ranges(batches, folder, False):
            payloads = [decode_png(x) for x in data]
            if any(len(p) != w * h * d // 8 for p, w, h, d in zip(payloads, *(batch[c].to_pylist() for c in ("width", "height", "bit_depth")), strict=True)):
                raise ValueError("a payload has another size than its header")
            yield _with(batch, {
                "payload_bytes": pa.array(map(len, payloads), pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                "media_bytes": pa.array(map(len, data), pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in data]),
                "feature": pa.array(map(feature, payloads)),
            })

    columns = ["digest", "shard", "offset", "length", "width", "height", "bit_depth"]
    return entries.select(*columns).mapInArrow(run, f"{_META}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a PNG in tar shards: its place, the header's columns, and what the payload that is read back gives."""
    folder = new_path(spark, "shards")
    manifest = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    found = payload_columns(header_columns(dealt(locations(manifest)), folder), folder)
    return manifest.select("doc_id", "n_bytes", "digest").join(found, "digest").withColumn("digest", F.lower(F.hex("digest")))


def extract(folder: str, shard: str) -> dict[str, bytes]:
    """All entries of one shard by name, through the tar format itself; for tests and small shards."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/{shard}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}
