"""Star load, write-back, documents, governance, snapshots and change decoding."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from payguard.jobs import erase, retain
from payguard.operators import documents, governance, star, writeback
from payguard.plans import models
from payguard.sources import changes, snapshots
from payguard.sources.tables import Tables

from .conftest import SF

T0 = datetime(2024, 1, 1, 12)


def test_replayed_day_adds_nothing(spark, tmp_path):
    t = Tables(spark, SF)
    extract = star.daily_extract(t.decided, t.payment_methods, t.merchants, "2024-01-05")
    n = extract.count()
    assert star.load_day(spark, extract, str(tmp_path), dry_run=True) == {"fact": n}
    assert star.load_day(spark, extract, str(tmp_path))["fact"] == n > 0
    assert set(star.load_day(spark, extract, str(tmp_path)).values()) == {0}
    other = star.daily_extract(t.decided, t.payment_methods, t.merchants, "2024-01-06")
    star.load_day(spark, other, str(tmp_path))
    keys = snapshots.Snapshots(spark, f"{tmp_path}/star").current("dim_customer")
    assert keys.count() == keys.select("customer_key").distinct().count() == keys.agg(F.max("customer_key")).first()[0]


def test_dim_date_spans_ten_years(spark):
    d = star.dim_date(spark, "2020-01-01", "2029-12-31")
    assert d.count() == 3653
    assert d.filter("full_date = DATE '2024-01-07'").first().asDict() | {"full_date": None} == {"date_key": 20240107, "full_date": None, "year": 2024, "quarter": 1, "month": 1, "week": 1, "day_of_week": 0, "is_weekend": True}


def test_write_back_is_replay_safe(spark, tmp_path):
    t = Tables(spark, SF)
    empty = t.transactions.withColumns({"fraud_score": F.lit(None).cast("double"), "updated_at": F.col("created_at")})
    store = snapshots.Snapshots(spark, str(tmp_path / "oltp"))
    assert store.current("transactions") is None
    store.commit({"transactions": empty, "indicators": t.indicators.limit(0)})
    writeback.apply_scores(store, t.scored)
    first = (store.current("transactions").filter("fraud_score IS NOT NULL").count(), store.current("indicators").count())
    writeback.apply_scores(store, t.scored.withColumn("fraud_score", F.lit(1.0)).withColumn("decision", F.lit("block")))
    assert (store.current("transactions").filter("fraud_score IS NOT NULL").count(), store.current("indicators").count()) == first
    assert store.vacuum(0) and len(snapshots.versions(spark, str(tmp_path / "oltp"))) == 1


def test_an_uncommitted_version_is_not_read(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path))
    store.commit({"a": spark.range(3)})
    spark.range(9).write.parquet(f"{tmp_path}/a/half")
    assert store.current("a").count() == 3


def test_tables_of_one_root_survive_each_others_writes(spark, tmp_path):
    t = Tables(spark, SF)
    root = str(tmp_path)
    store = snapshots.Snapshots(spark, root)
    empty = t.transactions.withColumns({"fraud_score": F.lit(None).cast("double"), "updated_at": F.col("created_at")})
    store.commit({"customers": t.customers, "payment_methods": t.payment_methods, "transactions": empty, "indicators": t.indicators.limit(0)})
    store.commit({"transaction_logs": documents.to_transaction_logs(t.scored), "logs": documents.to_logs(t.scored)})
    writeback.apply_scores(store, t.scored)
    erase.erase(spark, root, spark.createDataFrame([(3,)], "customer_id bigint"))
    retain.retain(spark, root, "2024-04-10")
    store.vacuum(0)
    assert store.names() == ["customers", "indicators", "logs", "payment_methods", "transaction_logs", "transactions"]
    assert all(store.current(n).count() > 0 for n in store.names())
    assert store.current("transactions").filter("customer_id = 3").count() == 0 < store.current("transactions").filter("fraud_score IS NOT NULL").count()


def test_writers_of_the_same_table_do_not_lose_updates(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path))
    base = store.commit({"a": spark.range(3), "b": spark.range(1)})
    store.commit({"b": spark.range(2)}, base)
    assert store.commit({"a": spark.range(4)}, base) == 3  # another table than the last writer's
    with pytest.raises(snapshots.Conflict):
        store.commit({"a": spark.range(9)}, base)
    assert (store.current("a").count(), store.current("b").count(), store.version()) == (4, 2, 3)


def test_idempotent_intake_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "k", T0), (2, "k", T0 - timedelta(hours=1)), (3, None, T0), (4, None, T0)], "txn_id bigint, idempotency_key string, created_at timestamp")
    assert sorted(r.txn_id for r in writeback.once(df).collect()) == [2, 3, 4]


def test_latest_images_drop_deleted_rows(spark):
    df = spark.createDataFrame([(1, 1, "a", "false"), (1, 2, "b", "false"), (2, 1, "c", "false"), (2, 2, "c", "true")], "id bigint, seq bigint, v string, __deleted string")
    assert [tuple(r) for r in writeback.latest_images(df, "id", ("seq",)).collect()] == [(1, 2, "b")]


def test_changes_are_decoded_or_dead_lettered(spark):
    row = {"txn_id": 1, "customer_id": 7, "amount": 5, "created_at": "2024-01-01T10:00:00Z", "__deleted": "false"}
    values = [json.dumps(row), json.dumps({"payload": {"before": None, "after": row}}), json.dumps({"after": row}), json.dumps({"after": None}), json.dumps(row | {"__deleted": "true"}), "{", None, json.dumps(row | {"created_at": "soon"}), "x" * 900]
    df = spark.createDataFrame([(v, "t", 0, i, T0) for i, v in enumerate(values)], changes.RAW)
    good, dead = changes.decode(df)
    assert [(r.txn_id, r.customer_id, r.amount, r.created_at) for r in good.collect()] == [(1, 7, 5, datetime(2024, 1, 1, 10))] * 3
    letters = {r.offset: r for r in dead.collect()}
    assert sorted(letters) == [5, 6, 7, 8] and len(letters[8].raw_value) == 500 and letters[6].error == "null value"


def test_each_message_is_parsed_once(spark):
    good, dead = changes.decode(spark.createDataFrame([], changes.RAW))
    for df in (good, dead, models.changes(spark, SF)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_merged_changes_are_parsed_once(spark):
    good, _ = changes.decode(spark.createDataFrame([], changes.RAW), keep_deleted=True)
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_messages_are_decoded_by_columns_and_their_keys_only_where_untold(spark):
    good, _ = changes.decode(spark.createDataFrame([], changes.RAW), keep_deleted=True)
    assert "lambda" not in good._jdf.queryExecution().optimizedPlan().toString()
    values = ['{"after": {"txn_id": 1, "fraud_score": %s}}' % x for x in ("NaN", "-INF", "Infinity", "0.5", '"NaN"')] + ['{"after": {"txn_id": 1}', '{"after": {"txn_id": 1, "metadata": "INFO"}}', '{"payload": {}}']
    df = spark.createDataFrame([(v, "t", 0, i, T0) for i, v in enumerate(values)], changes.RAW)
    got = {r.offset: (r.row and r.row.txn_id, r.error is None) for r in changes.parse(df).collect()}
    assert {i for i, (_, fine) in got.items() if fine} == {3, 4, 6, 7} and [got[i][0] for i in (3, 4, 6, 7)] == [1, 1, 1, None]


def test_a_batch_is_written_once_and_equals_a_merge(spark, tmp_path, monkeypatch):
    schema = "id bigint, v string, seq bigint, __deleted string"
    first = [(i, "a", 10, "false") for i in range(20)]
    second = [(1, "b", 11, "false"), (1, "c", 12, "false"), (1, "z", 3, "false"), (2, "old", 9, "false"), (3, "a", 10, "false"), (4, "a", 11, "true"), (5, "a", 9, "true"), (30, "n", 1, None), (31, "n", 1, "false"), (31, "n", 2, "true")]
    store, real, rows = snapshots.Snapshots(spark, str(tmp_path)), writeback.written, []
    monkeypatch.setattr(writeback, "written", lambda df, name, keep=False: (out := real(df, name, keep), rows.append(out.count()))[0])
    want = None
    for batch in (first, first + second, second, [(1, "gone", 13, "true")]):
        images, kept = spark.createDataFrame(batch, schema), len({r[0] for r in batch})
        rows.clear()
        writeback.apply_images(store, "t", images, "id", ("seq",))
        want = spark.createDataFrame(writeback.merge_images(want, images, "id", ("seq",)).collect(), "id bigint, v string, seq bigint")
        assert sorted(store.current("t").collect()) == sorted(want.collect()) and sum(rows) <= kept
    assert len(store.manifest(store.version())["tables"]["t"]["changes"]) == 2  # a repeated batch has none


def test_one_folder_of_changes_needs_no_grouping(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path))
    store.commit({"t": spark.range(9).withColumn("v", F.lit(1))}, keys={"t": "id"})
    for value, grouped in ((2, False), (3, True)):
        store.commit(changes={"t": spark.range(3).select("id", F.lit(value).alias("v"))})
        found = store.current("t")
        assert ("max_by" in found._jdf.queryExecution().optimizedPlan().toString()) == grouped
        assert sorted(map(tuple, found.collect())) == [(i, value if i < 3 else 1) for i in range(9)]


def test_parsed_messages_tell_row_time_error_and_whether_they_count(spark):
    row = {"txn_id": 1, "amount": 5, "created_at": "2024-01-01T10:00:00Z", "__deleted": "true"}
    values = [json.dumps(row), json.dumps({"after": row | {"__deleted": "false", "created_at": None}}), json.dumps({"after": None}), json.dumps(row | {"created_at": "soon"}), json.dumps(row | {"amount": "much"}), "[1]", None]
    df = spark.createDataFrame([(v, "t", 0, i, T0) for i, v in enumerate(values)], changes.RAW)
    got = {r.offset: (r.row and r.row.txn_id, r.instant, r.error, r.kept) for r in changes.parse(df).filter("offset < 4").collect()}
    assert got == {0: (1, datetime(2024, 1, 1, 10), None, False), 1: (1, T0, None, True), 2: (None, T0, None, False), 3: (1, T0, "created_at cannot be read", False)}
    assert {r.offset: r.error for r in changes.parse(df).filter("offset > 3").collect()} == {4: "not a JSON object of the expected types", 5: "not a JSON object of the expected types", 6: "null value"}
    assert [r.offset for r in changes.parse(df, keep_deleted=True).filter("kept").orderBy("offset").collect()] == [0, 1]


def test_own_echo_and_missing_customers_are_dropped(spark):
    df = spark.createDataFrame([(1, 7, None), (2, 7, 0.4), (3, None, None)], "txn_id bigint, customer_id bigint, fraud_score double")
    assert [r.txn_id for r in changes.unscored(df).collect()] == [1]


def test_anonymize_reports_unknown_ids_and_keeps_amounts(spark):
    t = Tables(spark, SF)
    ids = spark.createDataFrame([(1,), (2,), (10**9,)], "customer_id bigint")
    out = governance.anonymize(t.customers, t.payment_methods, t.transactions, ids)
    assert [r.customer_id for r in out["unknown"].collect()] == [10**9]
    assert out["counts"].count() == 2
    assert out["transactions"].agg(F.sum("amount")).first() == t.transactions.agg(F.sum("amount")).first()
    assert out["transactions"].filter("customer_id IN (1, 2)").count() == 0
    assert {r.name for r in out["customers"].filter("customer_id IN (1, 2)").collect()} == {"ANONYMIZED"}
    assert {r.fingerprint for r in out["payment_methods"].filter("customer_id = 1").collect()} == {"REDACTED"}


def test_checks_find_failures(spark):
    tables = {"a": spark.createDataFrame([(1, 1), (1, None), (2, 9)], "id bigint, ref bigint"), "b": spark.createDataFrame([(1,)], "ref bigint")}
    c = governance.Check
    got = governance.run_checks(tables, [c("a", "unique", "id"), c("a", "required", "ref"), c("a", "references", "ref", "b"), c("b", "at_least", least=3)])
    assert [r.failures for r in got.collect()] == [1, 1, 1, 2]


def test_upserts_keep_the_newest_values(spark):
    t = Tables(spark, SF)
    whole = documents.latest_features(t.scored)
    parts = documents.upsert_features(documents.upsert_features(None, t.scored.filter("txn_id % 3 = 0")), t.scored.filter("txn_id % 3 <> 0"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert documents.online_features(t.scored).count() == whole.count()


def test_documents_have_their_fields(spark):
    t = Tables(spark, SF)
    assert documents.to_alerts(t.scored).columns == list(documents.ALERT)
    log = documents.to_logs(t.scored).first()
    assert log.ttl_expires_at - log.created_at == timedelta(days=90)
