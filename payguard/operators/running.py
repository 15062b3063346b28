"""Tables between steps, and exact running totals over groups of any size.

Intermediate tables are written to the folder that all executors share and
read again, which cuts lineage: a lost executor costs a re-read, no more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payguard.sources.snapshots import remove

#: Paths of the scopes that are open, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-payguard-"))
            path = sc.getCheckpointDir()
    return path.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what new_path() and written() make inside, at the end: use results before it ends, or write them with keep."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            remove(spark, path)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """An unused path in the shared folder. It belongs to the innermost scratch(), or with keep to the one around that."""
    path = f"{shared_dir(spark)}/payguard/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again."""
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that each round of a loop writes anew; the one before is removed, so that only the last one takes room."""

    def __init__(self, spark: SparkSession, name: str, keep: bool = False) -> None:
        self.spark, self.name, self.keep, self.path = spark, name, keep, None

    def put(self, df: DataFrame) -> DataFrame:
        """Write df, which may read the last round's table but no later use may, and read it again."""
        old, self.path = self.path, new_path(self.spark, self.name, self.keep)
        df.write.parquet(self.path)
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(self.path)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], name: str, rounds: Rounds | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact running totals within groups, for groups of any size.

    Rows are dealt by range on (group, order), so a hot group spreads over
    many tasks; totals of (group, task) give each task its starting value.
    Adds to each row, per entry k of `sums`, the total of the rows before it
    (exclusive) as column k. Second result: one row per group with the totals.
    Group columns must not be null; `order` must end in a unique key for
    results that do not vary. The dealt rows are written, as a table of
    `rounds` where that is given.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) for c in (*group, *order)]
    dealt = df.repartitionByRange(n, *keys).withColumn("_task", F.spark_partition_id())
    dealt = dealt.withColumns({f"_w_{k}": c for k, c in sums.items()})
    dealt = rounds.put(dealt) if rounds else written(dealt, name)
    parts = dealt.groupBy(*group, "_task").agg(*(F.sum(f"_w_{k}").alias(f"_s_{k}") for k in sums))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({f"_b_{k}": F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)) for k in sums})
    within = Window.partitionBy(*group, "_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_w_{k}").over(within), F.lit(0)) for k in sums})
    joined = inner.join(parts, [*group, "_task"])
    out = joined.select(*df.columns, *((F.col(f"_b_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums))
    totals = parts.groupBy(*group).agg(*(F.sum(f"_s_{k}").alias(k) for k in sums))
    return out, totals
