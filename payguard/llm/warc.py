"""WARC archives whose records are compressed one by one with a common Zstandard dictionary.

The dictionary is built from pieces of the records that will be archived and
lies in a leading skippable frame of every archive, so each archive can be
read by itself; each record is a frame of its own, so one record can be read
by its offset. Of records with equal payloads the one of the least page_id is
a response, the others revisit it and store headers alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm.common import CHUNK_BYTES, bound_batches, materialize, new_path, text_slices

#: Payloads of fewer bytes are never revisited.
LEAST_REVISITED = 100
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 128 << 20
#: The dictionary's bytes, and the pieces that it is built from: their bytes, and how many are taken of all, about.
DICTIONARY_BYTES, PIECE_BYTES, PIECES = 112_640, 4096, 4096
LEVEL = 6
#: Bytes that a reader asks for at a time.
READ_BYTES = 1 << 20
#: Fixed values of the formats: the skippable frame that holds a dictionary, the mark of a dictionary, the profile of a revisit.
_SKIPPABLE, _DICTIONARY = 0x184D2A5D, 0xEC30A437
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, number: int = 0) -> str:
    """A URN that holds the page's number in a custom (version 8) UUID. Pages of no number get their archive's count instead, under another mark."""
    mark, value = (0x1, page_id & (1 << 64) - 1) if page_id is not None else (0x2, number)
    bits = mark << 100 | 8 << 76 | 2 << 62
    return uuid.UUID(int=bits | (value >> 60) << 64 | value & (1 << 60) - 1).urn


def page_of(urn: str) -> int | None:
    """The page's number in a record_id()."""
    bits = uuid.UUID(urn.strip("<>")).int
    if bits >> 100 != 0x1:
        return None
    value = (bits >> 64 & 0xF) << 60 | bits & (1 << 60) - 1
    return value - (1 << 64) if value >> 63 else value


def _target(url: str | None, urn: str) -> str:
    """The URL as a header value: blanks, control and other non-ASCII characters are percent-encoded. A page of no URL has its own URN."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else urn


def _head(version: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([version, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str, number: int = 0) -> bytes:
    """A response of the payload, or a revisit of page refers_to where that is given. Both hold the HTTP header with the payload's size."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))])
    urn = record_id(page_id, number)
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", date), ("WARC-Target-URI", _target(url, urn)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    block = http if refers_to is not None else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}


def decode_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record. Lengths must be right."""
    head, split, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(fields["content-length"])
    if not head.startswith(b"WARC/1.1") or not split or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is damaged")
    if not fields["content-type"].startswith("application/http"):
        return fields, {}, rest[:size]
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def train(pieces: list[bytes]) -> bytes:
    """A Zstandard dictionary of the pieces; empty where they are too few or too plain to build one."""
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 64)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def _loaded(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class ArchiveWriter:
    """Archives of one task, named by its place and attempt. A retried task writes files of other names, and only its rows are kept."""

    def __init__(self, folder: str, dictionary: bytes, date: str) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        task = TaskContext.get()
        self.task = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        self.dictionary, self.date = dictionary, date
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **_loaded(dictionary))
        self.file, self.name, self.at, self.archives = None, "", 0, 0

    def _write(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def put(self, record: bytes) -> tuple[str, int, int]:
        """Store a record: archive, offset and length of its frame."""
        if self.file is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name = f"{self.task}-{self.archives}.warc.zst"
            self.archives += 1
            self.file, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0  # else ".zst" compresses it again
            if self.dictionary:
                self._write(struct.pack("<II", _SKIPPABLE, len(self.dictionary)) + self.dictionary)
            info = b"format: WARC File Format 1.1\r\n"
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, self.name).urn}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
            self._write(self.compressor.compress(_head("WARC/1.1", fields) + info + b"\r\n\r\n"))
        return self.name, *self._write(self.compressor.compress(record))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None


def _frames(file: pa.NativeFile) -> Iterator[bytes]:
    """The records of an archive, in order, read as a stream; the dictionary comes from the archive itself."""
    head, loaded = file.read(8), {}
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _SKIPPABLE:
        dictionary, head = file.read(struct.unpack("<I", head[4:])[0]), b""
        if dictionary[:4] == struct.pack("<I", 0xFD2FB528):
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        if dictionary[:4] != struct.pack("<I", _DICTIONARY):
            raise ValueError("an archive's first frame holds no dictionary")
        loaded = _loaded(dictionary)
    decompressor = zstandard.ZstdDecompressor(**loaded)
    data = head
    while True:
        data = data or file.read(READ_BYTES)
        if not data:
            return
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                break
            data = file.read(READ_BYTES)
            if not data:
                raise ValueError("an archive ends inside a record")
        data = frame.unused_data
        yield b"".join(parts)


def dictionary_of(pages: DataFrame, sizes: DataFrame, date: str) -> bytes:
    """A dictionary of about PIECES pieces of the pages' records, chosen evenly by payload digest and place, built in one task.

    pages: page_id, url, html, digest, n_bytes; sizes: n_bytes of all pages,
    for the share to choose. Equal pieces count once. Few pages are taken whole.
    """
    total = sizes.agg(F.sum(F.ceil((F.col("n_bytes") + 1) / PIECE_BYTES))).first()[0] or 0
    share = max(1, total // PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            keys, pieces = [], []
            for r in batch.to_pylist():
                chosen = range(-int.from_bytes(r["digest"][:8], "big") % share, r["n_bytes"] // PIECE_BYTES + 1, share)
                record = encode_record(r["page_id"], r["url"], r["html"].encode(), r["digest"].hex(), r["n_bytes"], None, date) if chosen else b""
                for i in chosen:
                    pieces.append(record[i * PIECE_BYTES : (i + 1) * PIECE_BYTES])
                    keys.append(hashlib.blake2b(pieces[-1], digest_size=8).digest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pieces, pa.binary())], ["key", "piece"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [p for batch in batches for p in batch["piece"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train(pieces)], pa.binary())], ["dictionary"])

    chosen = pages.mapInArrow(cut, "key binary, piece binary").dropDuplicates(["key"])
    rows = chosen.repartition(1).sortWithinPartitions("key").select("piece").mapInArrow(build, "dictionary binary").collect()
    return bytes(rows[0][0]) if rows else b""


def archive(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of (page_id, url, html) into archives under `folder`, a URI that all executors reach.

    Result, a row each: page_id, archive, offset, length. Null html is an
    empty payload. A row of a null page_id is a response that nothing refers
    to; rows of the least page_id of a payload are all responses, should there
    be several. Equal payloads are found by their SHA-256. Only payloads that
    occur with two page_ids are joined, each with one row, so a payload that
    is everywhere is no hot key of a group. The rows are written before they
    are used, as in media.store().
    """
    spark = pages.sparkSession
    bound_batches(spark)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.unhex(F.sha2("html", 256)), "n_bytes": F.octet_length("html").cast("bigint")})
    sizes = materialize(pages.select("page_id", "digest", "n_bytes"), "warc-sizes")
    dictionary = spark.sparkContext.broadcast(dictionary_of(pages, sizes, date))
    large = sizes.filter(F.col("n_bytes") >= LEAST_REVISITED)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first")
    first = materialize(first, "warc-repeated")
    revisit = F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    rows = pages.join(first, "digest", "left").withColumn("refers_to", revisit)
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "n_bytes", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number = ArchiveWriter(folder, dictionary.value, date), 0
        for batch in text_slices(batches, "html", CHUNK_BYTES):
            placed = []
            for r in batch.to_pylist():
                number += 1
                placed.append(writer.put(encode_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"].hex(), r["n_bytes"], r["refers_to"], date, number)))
            names, starts, lengths = zip(*placed, strict=True)
            yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), pa.array(names), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "archive", "offset", "length"])
        writer.close()

    return materialize(rows.mapInArrow(run, "page_id bigint, archive string, offset bigint, length bigint"), "warc-manifest")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives named in column `archive`: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the payload if asked.

    An archive is read as a stream by one task. A response's digest is that of
    the payload read back, and must be the header's; a revisit has the digest
    and the length that its headers tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as file:
                    for data in _frames(file):
                        fields, http, payload = decode_record(data)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                            raise ValueError(f"a payload in {name} is damaged")
                        refers = fields.get("warc-refers-to")
                        rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, int(http["content-length"]), digest, page_of(refers) if refers else None, payload if kind == "response" else None))
                        held += len(payload) * with_payload
                        if len(rows) >= 2000 or held > CHUNK_BYTES:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    names = archives.select("archive").distinct()
    return names.mapInArrow(run, _RECORD + (", payload binary" if with_payload else ""))


_RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [*re.findall(r"(\w+) \w+", _RECORD), "payload"]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    n = len(names) if with_payload else len(names) - 1
    return pa.RecordBatch.from_arrays(columns[:n], names[:n])


def read_record(folder: str, name: str, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its place, as decode_record() gives it; two range reads, of the dictionary and of the frame."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}") as file:
        kind, size = struct.unpack("<II", file.read_at(8, 0))
        loaded = _loaded(file.read_at(size, 8)) if kind == _SKIPPABLE else {}
        return decode_record(zstandard.ZstdDecompressor(**loaded).decompress(file.read_at(length, offset)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, and what the archives give back."""
    folder = new_path(spark, "warc")
    manifest = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder).drop("url")


#: refers_to has the type that pandas gives a column with nulls.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id > least THEN least::DOUBLE END AS refers_to
FROM m
"""
