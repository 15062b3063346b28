"""Rules, velocity, features and column helpers on hand-written rows."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from payguard.functions import columns, features, rules, velocity

T0 = datetime(2024, 1, 1, 12)


def score(spark, amount, country, device, v1=0, v24=0, cfg=rules.RuleConfig()):
    df = spark.createDataFrame([(amount, country, device, v1, v24)], "amount bigint, ip_country string, device_type string, velocity_1h bigint, velocity_24h bigint")
    return rules.score_rules(df, cfg).first()


def test_high_amount_and_risky_country_block_exactly_at_the_threshold(spark):
    r = score(spark, 150_000, "RU", "web")
    assert (r.fraud_score, r.decision, r.rules_triggered) == (0.85, "block", ["R1_high_amount", "R3_high_risk_geo"])


def test_plain_row_is_allowed(spark):
    r = score(spark, 9_999, "FR", "web", 1)
    assert (r.fraud_score, r.decision, r.rules_triggered) == (0.1, "allow", [])


@pytest.mark.parametrize(("amount", "device", "fires"), [(0, "pos", False), (1, "pos", True), (199, "pos", True), (200, "pos", False), (1, "desktop", False), (None, "pos", False)])
def test_card_testing_edges(spark, amount, device, fires):
    assert ("R2_card_testing" in score(spark, amount, "FR", device).rules_triggered) is fires


@pytest.mark.parametrize(("v1", "v24", "fired"), [(10, 50, []), (11, 50, ["R4_velocity_1h"]), (10, 51, ["R5_velocity_24h"])])
def test_velocity_edges(spark, v1, v24, fired):
    assert score(spark, 9_999, "FR", "web", v1, v24).rules_triggered == fired


def test_score_is_capped(spark):
    assert score(spark, 100_001, "RU", "web", 11, 51).fraud_score == 1.0
    assert score(spark, 100_000, "FR", "web").rules_triggered == []


def times(spark, *minutes):
    return spark.createDataFrame([(i, 1, T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)], "txn_id bigint, customer_id bigint, created_at timestamp")


def test_training_velocity_excludes_the_row_and_its_peers(spark):
    got = {r.txn_id: r.velocity_1h for r in velocity.training(times(spark, 0, 30, 60, 60)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_served_velocity_includes_the_row_and_has_an_open_lower_end(spark):
    got = {r.txn_id: r.velocity_1h for r in velocity.served(times(spark, 0, 30, 60)).collect()}
    assert got == {0: 1, 1: 2, 2: 2}


def test_velocity_does_not_depend_on_input_order(spark):
    df = times(spark, 0, 5, 5, 70, 1000, 1500)
    a = {r.txn_id: (r.velocity_1h, r.velocity_24h) for r in velocity.training(df).collect()}
    b = {r.txn_id: (r.velocity_1h, r.velocity_24h) for r in velocity.training(df.orderBy(F.rand(3))).collect()}
    assert a == b


def test_velocity_equals_brute_force_across_days(spark):
    rows = [(i, i % 3, T0 + timedelta(minutes=(i * i * 37) % 6000)) for i in range(300)]
    df = spark.createDataFrame(rows, "txn_id bigint, customer_id bigint, created_at timestamp")
    for function, inside in ((velocity.served, lambda a, b, s: b - timedelta(seconds=s) < a <= b), (velocity.training, lambda a, b, s: b - timedelta(seconds=s) <= a < b)):
        got = {r.txn_id: (r.velocity_1h, r.velocity_24h) for r in function(df).collect()}
        assert got == {i: tuple(sum(c == k and inside(u, at, s) for _, k, u in rows) for s in (3600, 86400)) for i, c, at in rows}


def test_velocity_counts_run_from_the_start(spark):
    """A frame that slides counts all of its rows again at each row: the square of a customer's daily traffic."""
    for function in (velocity.served, velocity.training):
        plan = function(times(spark, 0, 30))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RangeFrame, ") == plan.count("RangeFrame, unboundedpreceding") >= 4


def test_features_of_nulls(spark):
    df = spark.createDataFrame([(1000, None, None, None, None, T0)], "amount bigint, ip_country string, device_type string, velocity_1h bigint, velocity_24h bigint, created_at timestamp")
    r = features.feature_columns(df).first()
    assert [r[c] for c in features.FEATURES[3:]] == [0, 0, 0, 0]
    assert features.assemble(features.feature_columns(df)).first().features.size == 7


def test_ratios_round_half_up_and_half_to_even(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (5, 0), (1, 3)], "n bigint, d bigint")
    assert [r[0] for r in df.select(columns.ratio("n", "d", 2)).collect()] == [0.13, 0.38, None, 0.33]
    assert [r[0] for r in df.select(columns.ratio_half_even("n", "d", 2)).collect()] == [0.12, 0.38, None, 0.33]


def test_ratios_of_very_large_sums(spark):
    df = spark.createDataFrame([(4 * 10**18, 8 * 10**18)], "n bigint, d bigint")
    assert df.select(columns.ratio("n", "d", 4, 100), columns.ratio_half_even("n", "d", 4, 100)).first()[:] == (50.0, 50.0)


def test_fingerprints_are_sha_256(spark):
    assert spark.range(7, 8).select(columns.fingerprint("id")).first()[0] == hashlib.sha256(b"7").hexdigest()


def test_calendar_parts_of_date_keys(spark):
    r = spark.range(1).select(F.lit(20240229).alias("k")).select(columns.year_of("k"), columns.quarter_of("k"), columns.month_of("k"), columns.day_of("k")).first()
    assert tuple(map(str, r)) == ("2024", "1", "2", "2024-02-29")


def test_json_key_and_boolean(spark):
    df = spark.createDataFrame([('{"k":true}',), ('{"k":null}',), ('{"x":1}',), ("bad",), (None,), ('"{\\"k\\":false}"',)], "m string")
    assert [r[0] for r in df.select(columns.has_key("m", "k")).collect()] == [True, True, False, False, False, False]
    assert [r[0] for r in df.select(columns.json_boolean("m", "k")).collect()] == [True, None, None, None, None, False]


def test_elapsed_days_are_whole_days_of_24_hours(spark):
    df = spark.createDataFrame([(T0, T0 + timedelta(hours=47)), (T0, T0 + timedelta(hours=48))], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(columns.elapsed_days("a", "b")).collect()] == [1, 2]
