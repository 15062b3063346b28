"""Versioned tables: a version shows only once it is committed, so readers never see half a write.

A version is a manifest in root/_versions that names the folders of each table.
A plain table is one folder, which a commit replaces. A keyed table lies in
hash buckets of its key; a commit adds a folder of changed rows, readers lay
the changes over the buckets, and compact() writes the touched buckets anew.
An appended table gets a folder of new rows with each commit, partitioned by a
column, so readers skip partitions. So what a batch writes follows the batch,
not the table.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a keyed table where none are asked for, and folders of changes from which a writer should compact.
BUCKETS, MANY_CHANGES = 16, 8
#: Seconds that replaced versions and unnamed folders are kept, for readers that began before.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has changed the same rows' buckets, tables or marks since they were read."""


def _path(spark: SparkSession, path: str):
    """The file system of a path and the path, through Spark's own access to any store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder and the seconds since 1970 at which each was last changed; empty where there is no folder."""
    fs, p = _path(spark, path)
    return {s.getPath().getName(): s.getModificationTime() // 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move(spark: SparkSession, source: str, path: str) -> bool:
    """Give a file or folder another name, or change nothing where there is one of that name: whether it was moved."""
    fs, beside = _path(spark, source)
    _, target = _path(spark, path)
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, options)
        return True
    except Exception:
        if not fs.exists(target):
            raise
        return False


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with all of its text, or change nothing where there is one: whether it was created."""
    beside = f"{path}.{uuid.uuid4().hex}"
    fs, p = _path(spark, beside)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    if move(spark, beside, path):
        return True
    remove(spark, beside)
    return False


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under root, ascending."""
    return sorted(int(n[:-5]) for n in listed(spark, f"{root}/_versions") if n.endswith(".json"))


def _schema(df: DataFrame) -> dict:
    """Names and types of df, all of which may be null, as later batches may bring nulls."""
    return json.loads(re.sub(r'("nullable"|"containsNull"|"valueContainsNull"):false', r"\1:true", df.schema.json()))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


class Snapshots:
    """Tables under one root; see commit()."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # reading

    def version(self) -> int:
        """The last committed version; 0 where there is none."""
        return (versions(self.spark, self.root) or [0])[-1]

    def manifest(self, number: int) -> dict:
        """A version: its tables, marks and time."""
        return json.loads(_read(self.spark, f"{self.root}/_versions/{number:012d}.json")) if number else {"tables": {}, "marks": {}, "at": 0}

    def _entry(self, name: str, number: int | None) -> dict | None:
        return self.manifest(self.version() if number is None else number)["tables"].get(name)

    def names(self, number: int | None = None) -> list[str]:
        """Tables of the last committed version (or of version `number`)."""
        return sorted(self.manifest(self.version() if number is None else number)["tables"])

    def key(self, name: str, number: int | None = None) -> str | None:
        """The key of a keyed table."""
        return (self._entry(name, number) or {}).get("key")

    def mark(self, name: str, number: int | None = None) -> int | None:
        """A number that was committed together with tables, such as that of the last batch; None where there is none."""
        return self.manifest(self.version() if number is None else number)["marks"].get(name)

    def current(self, name: str, number: int | None = None) -> DataFrame | None:
        """A table of the last committed version (or of version `number`), or None."""
        entry = self._entry(name, number)
        return self._rows(entry) if entry else None

    def rows_of(self, name: str, keys: DataFrame, number: int | None = None, unique: bool = False) -> DataFrame | None:
        """The rows of a keyed table that have a key of `keys` (where `unique`, no key comes twice); only those keys' buckets are read."""
        entry = self._entry(name, number)
        if entry is None:
            return None
        wanted = keys.select(entry["key"])
        return self._rows(entry, self._touched(wanted, entry)).join(wanted if unique else wanted.distinct(), entry["key"], "left_semi")

    def _touched(self, keys: DataFrame, entry: dict) -> list[int]:
        return sorted(r[0] for r in keys.select(_bucket(entry["key"], entry["buckets"]).alias("b")).distinct().collect())

    def _load(self, folders: list[str], schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _rows(self, entry: dict, only: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table, of a keyed one in some buckets only; of each changed key the last change counts."""
        schema = T.StructType.fromJson(entry["schema"])
        if "partition" in entry:
            reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{entry['loads'][0]['folder'].split('/')[0]}")
            return reader.parquet(*(f"{self.root}/{x['folder']}" for x in entry["loads"]))
        if "key" not in entry:
            return self._load([entry["folder"]], schema)
        wanted = set(range(entry["buckets"]) if only is None else only)
        rows = self._load([f for b, f in entry["bases"].items() if int(b) in wanted], schema)
        changes = [c["folder"] for c in entry["changes"] if wanted & set(c["buckets"])]
        if not changes:
            return rows
        key, columns = entry["key"], schema.fieldNames()
        marked = T.StructType([*schema.fields, T.StructField("_deleted", T.BooleanType())])
        found = reduce(DataFrame.unionAll, (self._load([f], marked).withColumn("_place", F.lit(i)) for i, f in enumerate(changes)))
        if only is not None:
            found = found.filter(_bucket(key, entry["buckets"]).isin(*wanted)) if wanted else found.limit(0)
        last = found.drop("_place")  # a folder has a row a key
        if len(changes) > 1:
            last = found.groupBy(key).agg(F.max_by(F.struct(*(f"`{c}`" for c in columns if c != key), "_deleted"), "_place").alias("_row")).select(key, "_row.*")
        return rows.join(last.select(key), key, "left_anti").select(*columns).unionAll(last.filter("NOT _deleted").select(*columns))

    # writing

    def _folder(self, name: str) -> str:
        return f"{name}/{uuid.uuid4().hex}"

    def _write_buckets(self, name: str, df: DataFrame, key: str, buckets: int) -> dict[str, str]:
        folder = self._folder(name)
        rows = df.withColumn("_bucket", _bucket(key, buckets))
        rows.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in listed(self.spark, f"{self.root}/{folder}") if n.startswith("_bucket=")}

    def _write_changes(self, name: str, df: DataFrame, entry: dict) -> dict:
        folder = self._folder(name)
        columns = T.StructType.fromJson(entry["schema"]).fields
        gone = F.coalesce(F.col("_deleted").cast("boolean"), F.lit(False)) if "_deleted" in df.columns else F.lit(False)
        df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in columns), gone.alias("_deleted")).write.parquet(f"{self.root}/{folder}")
        return {"folder": folder, "buckets": self._touched(self._load([folder], T.StructType(columns)), entry)}

    def _write_load(self, name: str, df: DataFrame, by: str) -> dict:
        """A folder of appended rows, one part of each partition or as many as its size asks for."""
        folder = f"{name}/load={uuid.uuid4().hex}"
        df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(f"{self.root}/{folder}")
        return {"folder": folder, "parts": sorted(n.partition("=")[2] for n in listed(self.spark, f"{self.root}/{folder}") if n.startswith(f"{by}="))}

    def loads_since(self, name: str, after: int, number: int | None = None) -> DataFrame | None:
        """Rows that versions after `after` appended to a table, or None."""
        entry = self._entry(name, number) or {"loads": []}
        new = [x for x in entry["loads"] if x["version"] > after]
        return self._rows(entry | {"loads": new}) if new else None

    def commit(self, tables: dict[str, DataFrame] | None = None, base: int | None = None, changes: dict[str, DataFrame] | None = None, keys: dict[str, str] | None = None, marks: dict[str, int] | None = None, buckets: int = BUCKETS, appends: dict[str, tuple[DataFrame, str]] | None = None, unchanged: tuple[str, ...] = ()) -> int:
        """Write tables and then show them all at once as a new version; its number. All other tables stay as they are.

        tables are replaced whole; those that `keys` gives a key, or that have
        one already, are laid out in buckets. changes are whole rows of keyed
        tables, a row a key, which replace the row of that key, or with a true
        `_deleted` remove it. appends are new rows and the column that their
        table is partitioned by. marks are numbers kept beside the tables. base
        is the version that all was computed from, by default the last one. If
        another writer has since changed the same tables, buckets of changed
        keys, partitions or marks, or tables that must be `unchanged`, nothing
        changes and a Conflict is raised; all other changes are kept.
        """
        tables, changes, keys, marks, appends = tables or {}, changes or {}, keys or {}, marks or {}, appends or {}
        old = self.manifest(self.version() if base is None else base)
        new, added, loads = {}, {}, {}
        for name, df in tables.items():
            key = keys.get(name) or old["tables"].get(name, {}).get("key")
            entry = {"schema": _schema(df)}
            if key:
                entry |= {"key": key, "buckets": buckets, "bases": self._write_buckets(name, df, key, buckets), "changes": [], "stamps": {}}
            else:
                entry["folder"] = self._folder(name)
                df.write.parquet(f"{self.root}/{entry['folder']}")
            new[name] = entry
        for name, df in changes.items():
            added[name] = self._write_changes(name, df, old["tables"][name])
        for name, (df, by) in appends.items():
            loads[name] = self._write_load(name, df, by), {"schema": _schema(df), "partition": by, "loads": [], "stamps": {}, "whole": 0}

        def build(now: dict, number: int) -> dict:
            lost = [n for n in (*new, *unchanged) if self._state(now, n) != self._state(old, n)]
            lost += [n for n, c in added.items() if n not in now["tables"] or self._changed(old["tables"][n], now["tables"][n], c["buckets"])]
            lost += [n for n, (x, _) in loads.items() if self._changed(old["tables"].get(n), now["tables"].get(n), x["parts"])]
            lost += [n for n in marks if now["marks"].get(n) != old["marks"].get(n)]
            if lost:
                raise Conflict(f"{', '.join(lost)} changed after version {base}")
            out = now["tables"] | {n: e | {"whole": number} for n, e in new.items()}
            for n, c in added.items():
                if c["buckets"]:
                    out[n] = out[n] | {"changes": [*out[n]["changes"], c], "stamps": out[n]["stamps"] | {str(b): number for b in c["buckets"]}}
            for n, (x, first) in loads.items():
                entry = out.get(n, first)
                if x["parts"] or not entry["loads"]:  # a first load without rows still says that there is such a table
                    out[n] = entry | {"loads": [*entry["loads"], x | {"version": number}], "stamps": entry["stamps"] | {p: number for p in x["parts"]}}
            return {"tables": out, "marks": now["marks"] | marks}

        written = [f for e in new.values() for f in self._folders(e)] + [c["folder"] for c in added.values()] + [x["folder"] for x, _ in loads.values()]
        return self._publish(build, written)

    @staticmethod
    def _state(version: dict, name: str) -> tuple:
        """What differs between two versions of a table whose rows differ."""
        entry = version["tables"].get(name, {})
        return entry.get("whole"), entry.get("stamps")

    @staticmethod
    def _changed(old: dict | None, now: dict | None, touched: list) -> bool:
        """Whether buckets or partitions of a table differ between two versions. A table that is new counts as empty."""
        if old is None or now is None:
            return old is not now and any(str(b) in (old or now)["stamps"] for b in touched)
        return now["whole"] != old["whole"] or any(now["stamps"].get(str(b)) != old["stamps"].get(str(b)) for b in touched)

    def _publish(self, build: Callable[[dict, int], dict], written: list[str]) -> int:
        fs, p = _path(self.spark, f"{self.root}/_versions")
        fs.mkdirs(p)
        while True:
            last = self.version()
            try:
                text = json.dumps(build(self.manifest(last), last + 1) | {"at": int(time.time())})
            except Conflict:
                for folder in written:
                    remove(self.spark, f"{self.root}/{folder}")
                raise
            if create(self.spark, f"{self.root}/_versions/{last + 1:012d}.json", text):
                return last + 1

    def retry(self, step: Callable[[int], int | None], times: int = 5) -> int | None:
        """step(base), which computes from version `base` and commits, again as long as other writers come first."""
        for left in reversed(range(times)):
            try:
                return step(self.version())
            except Conflict:
                if not left:
                    raise

    def compact(self, name: str, least: int = 1) -> bool:
        """Write the buckets that have changes anew, if there are `least` folders of changes: whether it did. Changes that others commit meanwhile stay on top."""
        base = self.manifest(self.version())["tables"][name]
        if len(base.get("changes", [])) < least:
            return False
        touched = sorted({b for c in base["changes"] for b in c["buckets"]})
        bases = self._write_buckets(name, self._rows(base, touched), base["key"], base["buckets"])
        gone = [c["folder"] for c in base["changes"]]

        def build(now: dict, number: int) -> dict:
            entry = now["tables"].get(name, {})
            if entry.get("whole") != base["whole"] or [c["folder"] for c in entry["changes"][: len(gone)]] != gone:
                raise Conflict(f"{name} was compacted or replaced by another writer")
            kept = {b: f for b, f in entry["bases"].items() if int(b) not in touched}
            return now | {"tables": now["tables"] | {name: entry | {"bases": kept | bases, "changes": entry["changes"][len(gone) :]}}}

        self._publish(build, sorted({f.rpartition("/")[0] for f in bases.values()}))
        return True

    # removing

    @staticmethod
    def _folders(entry: dict) -> list[str]:
        """Folders of a table, table/<unique>."""
        return sorted({"/".join(f.split("/")[:2]) for f in Snapshots._parts(entry)})

    @staticmethod
    def _parts(entry: dict) -> list[str]:
        """Folders that hold a table's rows; of a folder of buckets those that are in use."""
        if "loads" in entry:
            return [x["folder"] for x in entry["loads"]]
        return [entry["folder"]] if "folder" in entry else [*entry["bases"].values(), *(c["folder"] for c in entry["changes"])]

    def vacuum(self, older: float = GRACE) -> list[int]:
        """Remove versions that were replaced more than `older` seconds ago, and folders that no version names and no writer has touched for as long; the removed versions.

        A reader of a removed version finishes what it has read, or fails with
        a missing file. Folders of writers that ended before their commit go too.
        """
        found, limit = versions(self.spark, self.root), time.time() - older
        known = {n: self.manifest(n) for n in found}
        old = [n for n, after in zip(found, found[1:]) if known[after]["at"] <= limit]
        for n in old:
            remove(self.spark, f"{self.root}/_versions/{n:012d}.json")
        used: dict[str, set[str]] = {}  # folder and, of buckets that are not all in use, its parts
        for n in found:
            if n in old:
                continue
            for entry in known[n]["tables"].values():
                for f in self._parts(entry):
                    used.setdefault("/".join(f.split("/")[:2]), set()).add(f)
        for name in {t for m in known.values() for t in m["tables"]}:
            for unique, changed in listed(self.spark, f"{self.root}/{name}").items():
                folder = f"{name}/{unique}"
                if folder not in used:
                    if changed <= limit:
                        remove(self.spark, f"{self.root}/{folder}")
                elif folder not in used[folder]:  # some of its buckets have been written anew
                    for part, at in listed(self.spark, f"{self.root}/{folder}").items():
                        if part.startswith("_bucket=") and f"{folder}/{part}" not in used[folder] and at <= limit:
                            remove(self.spark, f"{self.root}/{folder}/{part}")
        return old


# Tables of batches


def put_batch(df: DataFrame, folder: str, batch: int, writer: str = "") -> bool:
    """Add a batch of rows to a table of batches, unless that batch is there: whether it was added.

    The rows appear all at once, as folder/batch=<number>, and are never
    replaced, so that a stream that repeats a batch gives its readers nothing
    new. Then the batch's number is logged beside the table: the log is what
    the next stream reads, see batch_log(). `writer` names the checkpoint; a
    batch of another writer is an error, as its rows are others.
    """
    spark = df.sparkSession
    target, log = f"{folder}/batch={batch}", f"{folder}_batches"
    known, note = f"{log}/{batch:012d}.json", json.dumps({"batch": batch, "writer": writer})
    added = False
    if not exists(spark, target):
        staged = f"{folder}_staged/{uuid.uuid4().hex}"
        df.write.parquet(staged)
        fs, p = _path(spark, folder)
        fs.mkdirs(p)
        added = move(spark, staged, target)
        if not added:
            remove(spark, staged)
    fs, p = _path(spark, log)
    fs.mkdirs(p)
    if not create(spark, known, note) and (there := json.loads(_read(spark, known))["writer"]) != writer:
        raise ValueError(f"batch {batch} of {folder} was written by {there or 'another writer'}")
    return added


def batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream with a row for each batch of a table of batches: batch, writer. A row never comes twice, and a batch never in halves."""
    fs, p = _path(spark, f"{folder}_batches")
    fs.mkdirs(p)
    return spark.readStream.schema("batch bigint, writer string").option("pathGlobFilter", "*.json").json(f"{folder}_batches")


def read_batch(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The rows of one batch."""
    return spark.read.parquet(f"{folder}/batch={batch}")
