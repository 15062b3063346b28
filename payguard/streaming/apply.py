"""Change messages applied to a stored copy of their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from payguard.operators.writeback import apply_images
from payguard.sources.changes import ChangeSource, decode, read_changes
from payguard.sources.snapshots import Snapshots


def start_apply(spark: SparkSession, source: ChangeSource, store: Snapshots, checkpoint: str, table: str = "transactions", key: str = "txn_id", trigger: dict | None = None) -> StreamingQuery:
    """Keep `table`, and aggregates maintained beside it, equal to what the change messages say: inserts, updates and deletions, by offset within a key. A repeated batch changes nothing."""

    def process(batch: DataFrame, batch_id: int) -> None:
        apply_images(store, table, decode(batch, keep_deleted=True)[0], key, ("offset",))

    return read_changes(spark, source).writeStream.queryName("apply-changes").foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
