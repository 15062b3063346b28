"""Jobs, and properties of the plans."""

import pytest
from pyspark.sql import functions as F

from payguard.jobs import daily_load, erase, retain, run_queries
from payguard.jobs.stream_score import source_of
from payguard.operators import documents, star
from payguard.plans import registry
from payguard.schemas import TABLES
from payguard.sources.snapshots import Snapshots
from payguard.sources import changes, tables
from payguard.sources.tables import Tables, read_table
from payguard.streaming import fanout

from .conftest import SF


@pytest.fixture(scope="module")
def oltp(spark, tmp_path_factory):
    """The operational tables as typed Parquet."""
    root, t = str(tmp_path_factory.mktemp("oltp")), Tables(spark, SF)
    for name, df in {"transactions": t.decided, "payment_methods": t.payment_methods.withColumn("is_default", F.lit(True)), "merchants": t.merchants}.items():
        schema = TABLES[name]
        df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{root}/{name}")
    return root


def test_daily_load_job(spark, oltp, tmp_path):
    out = str(tmp_path)
    assert daily_load.load(spark, oltp, out, "2024-01-03", dry_run=True)["fact"] == daily_load.load(spark, oltp, out, "2024-01-03")["fact"] > 0
    assert daily_load.load(spark, oltp, out, "2024-01-03")["fact"] == 0
    assert Snapshots(spark, f"{out}/preagg").current("merchant_stats").count() == Tables(spark, SF).merchants.count()


def test_the_day_filter_reaches_the_scan(spark, oltp):
    rows = star.daily_extract(*(read_table(spark, n, f"{oltp}/{n}") for n in ("transactions", "payment_methods", "merchants")), "2024-01-03")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = rows.select("txn_id", "amount")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "txn_id" in line)
    assert "GreaterThanOrEqual(created_at" in scan and "EqualTo(status,succeeded)" in scan and "device_type" not in scan


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_stay_in_the_jvm(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_run_queries_reports_failures(spark, monkeypatch):
    monkeypatch.setitem(registry.QUERIES, "broken", lambda spark, d: spark.sql("SELECT nothing"))
    got = {r.name: r for r in run_queries.run_queries(spark, SF, ["broken", "dim_date"]).collect()}
    assert got["broken"].error and got["dim_date"].error is None and got["dim_date"].rows > 0


def test_erase_job_needs_known_ids(spark, tmp_path):
    t = Tables(spark, SF)
    store = Snapshots(spark, str(tmp_path))
    store.commit({"customers": t.customers, "payment_methods": t.payment_methods, "transactions": t.transactions})
    known, unknown = (spark.createDataFrame([(i,)], "customer_id bigint") for i in (3, 10**9))
    erase.erase(spark, str(tmp_path), unknown)
    erase.erase(spark, str(tmp_path), known, dry_run=True)
    assert store.current("transactions").filter("customer_id = 3").count() > 0
    erase.erase(spark, str(tmp_path), known)
    assert store.current("transactions").filter("customer_id = 3").count() == 0


def test_retain_job(spark, tmp_path):
    t = Tables(spark, SF)
    store = Snapshots(spark, str(tmp_path))
    store.commit({"transaction_logs": documents.to_transaction_logs(t.scored), "logs": documents.to_logs(t.scored)})
    before = store.current("transaction_logs").count()
    assert retain.retain(spark, str(tmp_path), "2024-04-10") == ["logs", "transaction_logs"]
    assert 0 < store.current("transaction_logs").count() < before
    assert store.current("logs").count() == store.current("transaction_logs").count()


def test_readers_of_other_systems_get_their_options():
    options = tables.jdbc_options("merchants", "jdbc:postgresql://db/x", "merchant_id", 1, 1000, 8)
    assert options == {"url": "jdbc:postgresql://db/x", "dbtable": "merchants", "partitionColumn": "merchant_id", "lowerBound": "1", "upperBound": "1000", "numPartitions": "8"}
    assert changes.topic_options(source_of("kafka:a:9092/txns")) == {"kafka.bootstrap.servers": "a:9092", "subscribe": "txns", "startingOffsets": "earliest"}


def test_scoring_a_window_reads_no_more_than_a_day_before_it(spark):
    t = Tables(spark, SF)
    start = t.as_of(t.transactions) - F.expr("INTERVAL 24 HOURS")
    recent, whole = t.scored_since(start), t.scored.filter(F.col("created_at") >= start)
    assert sorted(map(str, recent.collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, t.decided_since(start).select("txn_id", "decision").collect())) == sorted(map(str, t.decided.filter(F.col("created_at") >= start).select("txn_id", "decision").collect()))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window"):]  # what feeds the windows
    assert "ts" in below and ">=" in below


@pytest.mark.parametrize(("name", "windows", "scans"), [("oltp_served_perf", 2, 5), ("oltp_decisions_by_pm", 2, 8), ("doc_retention_effect", 2, 5), ("dash_velocity", 0, 5), ("olap_region_quarter", 0, 1)])
def test_plans_have_no_more_windows_and_scans_than_they_need(spark, name, windows, scans):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= windows and plan.count("Relation [") <= scans


def test_sources_by_name():
    assert source_of("kafka:a:9092/txns").topic == "txns" and source_of("/data").path == "/data"


def test_replayed_messages_are_dropped_within_the_watermark(spark, tmp_path):
    rows = Tables(spark, SF).transactions.filter("created_at < TIMESTAMP '2024-01-02'").select("txn_id", "created_at", "currency", "amount", "status")
    rows.unionByName(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = fanout.intake_once(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == rows.count()


def test_streamed_daily_revenue_equals_the_batch(spark, tmp_path):
    rows = Tables(spark, SF).transactions.select("created_at", "currency", "amount", "status")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = fanout.daily_revenue(stream).writeStream.outputMode("complete").format("memory").queryName("daily_revenue_stream").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(str, spark.table("daily_revenue_stream").collect())) == sorted(map(str, fanout.daily_revenue(rows).collect()))
