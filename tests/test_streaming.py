"""Streams against their batch twins."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from payguard.functions import rules, velocity
from payguard.jobs import apply_changes, fan_out, star_revenue, stream_score
from payguard.operators import preagg, star
from payguard.schemas import TABLES
from payguard.sources.changes import RAW, ChangeSource
from payguard.sources.snapshots import Snapshots
from payguard.sources.tables import Tables
from payguard.streaming import fanout, score, velocity_state

from .conftest import SF


def messages(spark, folder, files):
    """The transactions of a day and a half as change messages, dealt by time over files."""
    t = Tables(spark, SF)
    rows = t.transactions.filter("created_at < TIMESTAMP '2024-01-08'")
    body = F.to_json(F.struct("txn_id", "merchant_id", "customer_id", "pm_id", "amount", "currency", "status", "device_type", "ip_country", "metadata", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").alias("created_at")))
    out = rows.select("created_at", body.alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("txn_id").alias("offset"), F.col("created_at").alias("timestamp"))
    out = out.orderBy("created_at").toPandas()
    size = -(-len(out) // files)
    for i in range(files):
        part = spark.createDataFrame(out.iloc[i * size : (i + 1) * size].drop(columns="created_at"))
        part.coalesce(1).write.mode("append").json(folder)
    bad = spark.createDataFrame([("{", "t", 0, 10**6, datetime(2024, 1, 1))], "value string, topic string, partition int, offset bigint, timestamp timestamp")
    bad.write.mode("append").json(folder)
    return rows


def run(spark, folder, root, files_per_batch):
    sinks = score.Sinks(f"{root}/events", f"{root}/alerts", f"{root}/dead")
    queries = score.start_scoring(spark, ChangeSource(path=folder, max_files=files_per_batch), sinks, f"{root}/checkpoint")
    for q in queries:
        assert q.awaitTermination(240) and q.exception() is None
    return sinks


@pytest.fixture(scope="module")
def scored_stream(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("changes"))
    rows = messages(spark, folder, 3)
    root = str(tmp_path_factory.mktemp("one"))
    return rows, folder, run(spark, folder, root, None), root


def test_stream_equals_batch(spark, scored_stream):
    rows, _, sinks, _ = scored_stream
    expected = rules.score_rules(velocity.served(rows.filter("customer_id IS NOT NULL")))
    columns = ["txn_id", "velocity_1h", "velocity_24h", "fraud_score", "decision"]
    got = spark.read.parquet(sinks.events)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    assert spark.read.parquet(sinks.alerts).count() == rules.alerts(expected).count()
    assert [r.raw_value for r in spark.read.parquet(sinks.dead_letters).collect()] == ["{"]


def test_restart_processes_nothing_again(spark, scored_stream):
    _, folder, sinks, root = scored_stream
    before = spark.read.parquet(sinks.events).count()
    run(spark, folder, root, None)
    assert spark.read.parquet(sinks.events).count() == before


def test_history_seeds_the_state(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 12)
    history = spark.createDataFrame([(7, t0 - timedelta(minutes=m)) for m in (10, 20, 100)], "customer_id bigint, created_at timestamp")
    spark.createDataFrame([(1, 7, t0), (2, 8, t0), (3, 7, t0 + timedelta(minutes=5))], "txn_id bigint, customer_id bigint, created_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("txn_id bigint, customer_id bigint, created_at timestamp").parquet(f"{tmp_path}/in")
    with velocity_state.state_settings(spark):
        q = velocity_state.with_velocity(stream, history).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.txn_id: (r.velocity_1h, r.velocity_24h, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (3, 4, False), 2: (1, 1, False), 3: (4, 5, False)}


def test_fan_out_writes_four_tables(spark, scored_stream, tmp_path):
    _, _, sinks, _ = scored_stream
    events = spark.read.parquet(sinks.events)
    tables = fanout.Tables(*(f"{tmp_path}/{n}" for n in ("tl", "logs", "alerts", "features")))
    q = fanout.start_fanout(spark, sinks.events, tables, f"{tmp_path}/c")
    assert q.awaitTermination(240) and q.exception() is None
    n = events.count()
    assert spark.read.parquet(tables.transaction_logs).count() == spark.read.parquet(tables.logs).count() == n
    assert spark.read.parquet(tables.fraud_alerts).count() == rules.alerts(events).count()
    assert Snapshots(spark, tables.features).current("ml_features").count() == events.select("customer_id").distinct().count()


def finish(*queries):
    for q in queries:
        assert q.awaitTermination(300) and q.exception() is None


def test_jobs_write_back_fan_out_and_count(spark, scored_stream, tmp_path):
    _, folder, first, _ = scored_stream
    t = Tables(spark, SF)
    empty = t.transactions.withColumns({"fraud_score": F.lit(None).cast("decimal(5,4)"), "updated_at": F.col("created_at")})
    store = Snapshots(spark, f"{tmp_path}/oltp")
    store.commit({"transactions": empty, "indicators": t.indicators.limit(0), "customers": t.customers})
    old = empty.filter("created_at < TIMESTAMP '2023-01-01'").select(*(F.col(f.name).cast(f.dataType) for f in TABLES["transactions"]))
    old.write.parquet(f"{tmp_path}/history")
    finish(*stream_score.start(spark, folder, f"{tmp_path}/out", tables=f"{tmp_path}/oltp", history=f"{tmp_path}/history"))
    events = spark.read.parquet(f"{tmp_path}/out/events")
    columns = ["txn_id", "velocity_1h", "velocity_24h", "fraud_score", "decision"]
    assert sorted(map(tuple, events.select(columns).collect())) == sorted(map(tuple, spark.read.parquet(first.events).select(columns).collect()))
    n, alerts = events.count(), rules.alerts(events).count()
    assert store.current("transactions").filter("fraud_score IS NOT NULL").count() == n > 0
    assert store.current("indicators").count() == alerts and store.current("customers").count() > 0
    c = spark.read.parquet(f"{tmp_path}/out/progress").agg(F.sum("scored"), F.sum("alerts"), F.sum("written_back")).first()
    assert tuple(c) == (n, alerts, n)
    finish(fan_out.start(spark, f"{tmp_path}/out/events", f"{tmp_path}/docs"))
    features = Snapshots(spark, f"{tmp_path}/docs/features")
    assert features.current("ml_features").count() == events.select("customer_id").distinct().count()
    last = {r.customer_id: r.last for r in events.groupBy("customer_id").agg(F.max("created_at").alias("last")).collect()}
    live = {k for k, v in last.items() if v + timedelta(hours=1) > max(last.values())}
    assert {r.customer_id: r.expires_at for r in features.current("online_features").collect()} == {k: last[k] + timedelta(hours=1) for k in live}


def test_applied_changes_equal_the_table(spark, tmp_path):
    def put(rows):
        body = [(json.dumps({"txn_id": i, "amount": a, "created_at": "2024-01-01T00:00:00Z", "__deleted": d}), "t", 0, o, datetime(2024, 1, 1)) for i, a, d, o in rows]
        spark.createDataFrame(body, RAW).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    put([(1, 10, "false", 1), (2, 20, "false", 2), (3, 30, "false", 3), (1, 11, "false", 4)])
    finish(apply_changes.start(spark, f"{tmp_path}/in", f"{tmp_path}/root"))
    put([(2, 20, "true", 5), (3, 29, "false", 0), (4, 40, "false", 6)])
    finish(apply_changes.start(spark, f"{tmp_path}/in", f"{tmp_path}/root"))
    got = Snapshots(spark, f"{tmp_path}/root").current("transactions")
    assert {r.txn_id: r.amount for r in got.collect()} == {1: 11, 3: 30, 4: 40}


def test_star_revenue_follows_the_facts(spark, tmp_path):
    t, warehouse = Tables(spark, SF), f"{tmp_path}/w"
    for day in ("2024-01-05", "2024-01-06"):
        star.load_day(spark, star.daily_extract(t.decided, t.payment_methods, t.merchants, day), warehouse)
        finish(star_revenue.start(spark, warehouse))
    got = Snapshots(spark, f"{warehouse}/preagg").current("star_revenue")
    expected = preagg.star_revenue(Snapshots(spark, f"{warehouse}/star").current(star.FACTS), star.dim_geography(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.select("full_date").distinct().count() == 2


def test_windowed_counts_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = Tables(spark, SF).scored.select("created_at", "fraud_score", "amount")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = fanout.windowed_counts(stream, "1 day").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.window_start: tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    expected = {r.window_start: tuple(r) for r in fanout.windowed_counts(rows, "1 day").collect()}
    assert got and all(expected[k] == v for k, v in got.items())
    assert set(expected) - set(got) <= {max(expected)}  # the last window stays open
