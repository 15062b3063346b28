"""Training, measures, drift, monitoring and the model store."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from payguard.functions import rules
from payguard.functions.features import feature_columns
from payguard.ml import dataset, drift, evaluate, monitor, scoring, store, train
from payguard.operators import documents
from payguard.sources.tables import Tables

from .conftest import SF

T0 = datetime(2024, 1, 1)
QUICK = train.TrainConfig(trees=8, least_trees=4, depth=3, step=0.3)


def separable(spark, n=400):
    rows = [(i, 150_000 + i if i % 7 == 0 else 1000 + i, "RU" if i % 7 == 0 else "FR", "pos" if i % 7 == 0 else "desktop", 20 if i % 7 == 0 else 1, 30 if i % 7 == 0 else 2, T0 + timedelta(minutes=i), float(i % 7 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "txn_id bigint, amount bigint, ip_country string, device_type string, velocity_1h bigint, velocity_24h bigint, created_at timestamp, label double")
    return df


def test_separable_rows_are_learned_and_survive_a_reload(spark, tmp_path):
    df = separable(spark)
    model, params = train.train(feature_columns(df), QUICK)
    scored = scoring.score_model(df, model)
    got = evaluate.evaluate(scored)
    assert got["recall"] > 0.9 and got["precision"] > 0.9 and params["trees"] >= 1
    assert abs(got["roc_auc"] - 1) < 1e-9
    root = str(tmp_path)
    assert store.current(root) is None
    version = store.save(spark, root, model, got)
    assert store.accept_or_rollback(spark, root, version)["rolled_back"] is False
    loaded, meta = store.current(root)
    assert meta["version"] == version
    assert scoring.score_model(df, loaded).select("fraud_score").collect() == scored.select("fraud_score").collect()
    worse = store.save(spark, root, model, {"recall_at_block": got["recall_at_block"] - 0.2})
    assert store.accept_or_rollback(spark, root, worse)["rolled_back"] is True
    assert store.current(root)[1]["version"] == version
    served = scoring.score(df, rules.RuleConfig(), loaded, version)
    assert served.select("model_version").distinct().first()[0] == version and served.first().rules_triggered == []


def test_without_a_model_the_rules_score(spark):
    got = scoring.score(separable(spark, 10), rules.RuleConfig())
    assert got.first().model_version == "rule-based-v1"


def test_ranking_is_exact_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "fraud_score double, label int")
    r = evaluate.ranking(df).first()
    assert abs(r.roc_auc - 3.5 / 4) < 1e-12 and abs(r.average_precision - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12


def test_measures_are_zero_without_a_denominator(spark):
    df = spark.createDataFrame([(0.1, 0)], "fraud_score double, label int")
    assert evaluate.confusion(df, 0.5)["f1"] == 0.0


def test_equal_samples_do_not_drift(spark):
    df = feature_columns(separable(spark))
    same = drift.summary(drift.drift(df, df))
    assert same["drift_share"] == 0.0 and len(same["columns_tested"]) == 5
    moved = drift.summary(drift.drift(df, df.withColumn("amount", F.col("amount") * 50).withColumn("is_pos_device", F.lit(1.0))))
    assert moved["drifted_columns"] == 2


def test_shifts_within_a_bin_and_over_63_are_drift(spark):
    df = feature_columns(separable(spark)).withColumns({"amount": F.col("txn_id") % 7 + 1030, "velocity_1h": F.lit(70), "velocity_24h": F.lit(100)})
    moved = df.withColumns({"amount": (F.col("amount") * 1.8).cast("bigint"), "velocity_24h": F.lit(10_000)})
    got = {r.feature: r for r in drift.drift(df, moved).collect()}
    assert {k for k, r in got.items() if r.drifted} == {"amount_log", "velocity_24h"}
    assert got["amount_log"].distance == got["velocity_24h"].distance == 1.0 and got["velocity_1h"].distance == 0.0


def test_drift_distance_is_exact(spark):
    a, b = [i * i % 10_007 for i in range(900)], [i * i % 9001 + i % 5 for i in range(700)]
    frame = lambda x: spark.createDataFrame([(v, 0.0, 0.0, 0, v // 3) for v in x], "amount bigint, is_high_risk_country float, is_pos_device float, velocity_1h bigint, velocity_24h bigint")
    got = {r.feature: r.distance for r in drift.drift(frame(a), frame(b)).collect()}
    for name, x, y in [("amount_log", a, b), ("velocity_24h", [v // 3 for v in a], [v // 3 for v in b])]:
        want = max(abs(sum(v <= t for v in x) * len(y) - sum(v <= t for v in y) * len(x)) for t in {*x, *y}) / (len(x) * len(y))
        assert abs(got[name] - want) < 1e-12


def test_temporal_split_keeps_time_order(spark):
    old, new = dataset.temporal_split(separable(spark), 0.2)
    assert old.agg(F.max("created_at")).first()[0] < new.agg(F.min("created_at")).first()[0]
    assert new.count() == 80


def test_rows_of_the_cutting_instant_are_split_by_id(spark):
    df = spark.createDataFrame([(i * 10**12 - 5 * 10**13, T0 + timedelta(minutes=i // 40)) for i in range(100)], "txn_id bigint, created_at timestamp")
    old, new = dataset.temporal_split(df, 0.25)
    assert sorted(r.txn_id for r in old.collect()) == [i * 10**12 - 5 * 10**13 for i in range(75)] and new.count() == 25


def test_cut_equals_percentile_disc_without_a_buffer_of_all_times(spark, monkeypatch):
    times = [i * i * 7919 % 200_000_000_000 - 90_000_000_000 for i in range(500)] + [5_000_000] * 40 + [5_000_001, 5_000_999, 5_001_000] * 9
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "us bigint").select(F.timestamp_micros("us").alias("created_at"))
    shares = (0.0, 0.15, 0.2, 0.45, 0.46, 0.47, 0.48, 0.5, 0.8, 0.85, 1.0)
    want = df.agg(*(F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY unix_micros(created_at))") for s in shares)).first()
    assert [dataset.time_quantile(df, s) for s in shares] == list(want)
    assert dataset.time_quantile(df.filter("created_at IS NULL"), 0.5) is None
    assert [x.count() for x in dataset.temporal_split(df.limit(0))] == [0, 0]
    seen = []
    monkeypatch.setattr(dataset.F, "expr", lambda s, expr=F.expr: (seen.append(s), expr(s))[1])
    dataset.temporal_split(df)
    assert not any("percentile" in s for s in seen)


def test_monitoring_cycle_records_alerts_and_cooldown(spark, tmp_path):
    t = Tables(spark, SF)
    rows = t.transactions
    logs = documents.to_transaction_logs(t.scored)
    as_of = rows.agg(F.max("created_at")).first()[0]
    cfg = monitor.MonitorConfig(minutes=60 * 24 * 10)
    out = monitor.monitor_once(spark, rows, logs, str(tmp_path), as_of, "rule-based-v1", as_of - timedelta(seconds=10), cfg, QUICK).first()
    assert out.status == "alert" and out.retrain_triggered is False and out.retrain_skipped_reason == "cooldown"
    assert any(r.startswith("recall") for r in out.alert_reasons) and out.performance.n > 30
    out = monitor.monitor_once(spark, rows, logs, str(tmp_path), as_of, "rule-based-v1", None, cfg, QUICK).first()
    assert out.retrain_triggered and out.rolled_back is False and store.current(str(tmp_path)) is not None
    few = monitor.monitor_once(spark, rows.limit(20), logs, str(tmp_path), as_of, None, None, cfg).first()
    assert few.status == "skipped"


def test_default_numbers_of_trees_are_the_references():
    cfg = train.TrainConfig()
    assert (cfg.trees, cfg.least_trees, cfg.depth, cfg.step, cfg.subsample, cfg.validation) == (600, 100, 5, 0.05, 0.8, 0.15)


def test_training_is_skipped_with_few_rows(spark, tmp_path):
    assert "skipped" in train.run_training(spark, Tables(spark, SF).transactions.filter("txn_id < 50"), str(tmp_path))
