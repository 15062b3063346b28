"""The scoring stream: change messages in; scored events, alerts, write-back and dead letters out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payguard.functions import rules
from payguard.ml import store as models
from payguard.ml.scoring import score
from payguard.operators import writeback
from payguard.sources.changes import ChangeSource, decode, read_changes, unscored
from payguard.sources.snapshots import Snapshots, put_batch, read_batch
from payguard.streaming.velocity_state import state_settings, with_velocity


@dataclass(frozen=True)
class Sinks:
    """Tables of batches for the outputs. tables, where set, holds versions of transactions and indicators for the write-back; progress gets the counters of each batch."""

    events: str
    alerts: str
    dead_letters: str
    tables: str | None = None
    progress: str | None = None


def start_scoring(spark: SparkSession, source: ChangeSource, sinks: Sinks, checkpoint: str, cfg: rules.RuleConfig = rules.RuleConfig(), history: DataFrame | None = None, model_store: str | None = None, trigger: dict | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """Start the scoring query and the dead-letter query.

    The scorer is looked up for each batch: the current model of model_store,
    or the rules where there is none. history: transactions from before the
    stream's start, of which the last day seeds the velocities. trigger: arguments of
    DataStreamWriter.trigger; by default all that is there is processed once.
    """
    trigger = trigger or {"availableNow": True}

    def process(batch: DataFrame, batch_id: int) -> None:
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        found = models.current(model_store) if model_store else None
        model: PipelineModel | None = found[0] if found else None
        scored = score(batch, cfg, model, found[1]["version"] if found else None).withColumn("scored_at", F.current_timestamp())
        put_batch(scored, sinks.events, batch_id, writer)
        # What is stored counts from here on: a repeated batch might be scored by another model.
        stored = read_batch(spark, sinks.events, batch_id)
        put_batch(rules.alerts(stored), sinks.alerts, batch_id, writer)
        set_now = writeback.apply_scores(Snapshots(spark, sinks.tables), stored) if sinks.tables else 0
        if sinks.progress:
            put_batch(counters(stored, set_now), sinks.progress, batch_id, writer)

    good, _ = decode(read_changes(spark, source))
    rows = with_velocity(unscored(good).drop("offset"), history)
    with state_settings(spark):
        main = rows.writeStream.queryName("scoring").foreachBatch(process).option("checkpointLocation", f"{checkpoint}/scoring").trigger(**trigger).start()
    _, dead = decode(read_changes(spark, source))
    letters = dead.writeStream.queryName("dead-letters").format("parquet").option("path", sinks.dead_letters).option("checkpointLocation", f"{checkpoint}/dead-letters").trigger(**trigger).start()
    return main, letters


def counters(scored: DataFrame, written_back: int) -> DataFrame:
    """One row of a batch's counters: scored, alerts, late, written_back, scored_at."""
    return scored.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("decision").isin("review", "block")).alias("alerts"), F.count_if("late").alias("late"), F.lit(written_back).cast("bigint").alias("written_back"), F.max("scored_at").alias("scored_at"))


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rows a second of each batch so far; alerts and write-backs are in the table of counters()."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]
