"""Incremental velocity state, staged early stop, checks in two scans, skew by distribution."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from payguard.functions import velocity
from payguard.functions.features import FEATURES
from payguard.ml import monitor, staged, train
from payguard.operators import documents, governance
from payguard.sources.tables import Tables
from payguard.streaming import velocity_state

from .conftest import SF

T0 = datetime(2024, 1, 1, 12)
US = 1_000_000


class Map:
    """A state of the stream in memory, which counts what is read and written."""

    def __init__(self):
        self.held, self.moved = {}, 0

    def getValue(self, key):
        found = self.held.get(key)
        self.moved += len(found[0]) if found else 0
        return found

    def updateValue(self, key, value):
        self.held[key] = value
        self.moved += len(value[0])

    def removeKey(self, key):
        self.held.pop(key, None)


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def processor():
    p = velocity_state.VelocityProcessor(["txn_id", "us"])
    p.slices, p.sizes = Map(), Value()
    return p


def run(p, pieces):
    frames = [pd.DataFrame(x, columns=["txn_id", "us"]) for x in pieces]
    out = pd.concat(list(p.handleInputRows((1,), iter(frames), None)))
    return {r.txn_id: (r.velocity_1h, r.velocity_24h, r.late) for r in out.itertuples()}


def test_velocity_state_equals_counting(monkeypatch):
    rng, p, seen = np.random.default_rng(2), processor(), []
    for batch in range(12):
        last = max((t for _, t in seen), default=None)
        rows = [(batch * 100 + i, int((batch * 3 + rng.integers(-2, 6)) * 3600 * US + rng.integers(3600) * US)) for i in range(40)]
        rows[7] = (rows[7][0], rows[6][1])  # a tie
        got = run(p, [rows[:13], rows[13:14], rows[14:]])
        seen += rows
        times = np.array([t for _, t in seen])
        for i, t in rows:
            want = tuple(int(((times > t - s * US) & (times <= t)).sum()) for s in (3600, 86400))
            assert got[i] == (*want, last is not None and t < last)
    assert len(p.slices.held) <= 36 * 12 + 1


def test_velocity_state_drops_what_comes_again():
    p = processor()
    first = run(p, [[(1, 10 * US), (2, 20 * US), (1, 10 * US)]])
    assert first == {1: (1, 1, False), 2: (2, 2, False)}
    assert run(p, [[(2, 20 * US), (3, 30 * US)], [(3, 30 * US)]]) == {3: (3, 3, False)}


def test_velocity_state_costs_what_is_new():
    """200,000 rows of one customer's day in 200 batches: each batch moves a few slices, not the day."""
    p, n = processor(), 200_000
    times = (np.arange(n) * (86_400 * US // n)).tolist()
    moved = []
    for i in range(0, n, 1000):
        before = p.slices.moved
        got = run(p, [list(zip(range(i, i + 1000), times[i : i + 1000], strict=True))])
        moved.append(p.slices.moved - before)
    assert got[n - 1] == (n // 24 + 1, n, False)
    assert max(moved[50:]) < 8 * 8 * n * 300 / 86_400 < 8 * n / 4  # bytes of eight slices, of a day's sixteen hundred KB


def test_history_in_pieces_seeds_the_state():
    p = processor()
    for ts in ([1, 2], [3]):
        p.handleInitialState((1,), pd.DataFrame({"ts": [t * US for t in ts], "txn_id": ts}), None)
    assert run(p, [[(9, 4 * US), (3, 3 * US)]]) == {9: (4, 4, False)}


# ---- early stop


def labelled(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, T0 + timedelta(minutes=i), *(float(x) for x in rng.normal(size=len(FEATURES)).astype(np.float32))) for i in range(n)]
    df = spark.createDataFrame(rows, "txn_id long, created_at timestamp, " + ", ".join(f"{f} float" for f in FEATURES))
    return df.withColumn("label", ((F.col(FEATURES[0]) + F.col(FEATURES[5]) * F.col(FEATURES[6]) + F.rand(3)) > 1.6).cast("double"))


def average_precision(score, label):
    """A step sum over distinct scores."""
    out, tp, fp = 0.0, 0, 0
    for s in sorted(set(score), reverse=True):
        p = sum(y for x, y in zip(score, label, strict=True) if x == s)
        tp, fp = tp + p, fp + sum(x == s for x in score) - p
        out += p * tp / (tp + fp)
    return out / sum(label)


def test_staged_scores_equal_the_models(spark):
    df = labelled(spark, 400).withColumn("weight", F.lit(1.0)).persist()
    cfg = train.TrainConfig(depth=3)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), train._classifier(cfg, 12)]).fit(df)
    got = staged.staged_average_precision(model.stages[-1], df, 0, 12)
    trees, rows = staged.trees_of(model.stages[-1]), df.select(*FEATURES, "label").toPandas()
    x = rows[list(FEATURES)].to_numpy(np.float64)
    margin = np.zeros(len(x))
    for tree, ap in zip(trees, got, strict=True):
        margin += tree.weight * tree.predict(x)
        assert ap == pytest.approx(average_precision(np.rint(1e4 / (1 + np.exp(-2 * margin))).tolist(), rows.label.tolist()))
    probability = [r.probability[1] for r in model.transform(df).select("probability").collect()]
    assert np.allclose(1 / (1 + np.exp(-2 * margin)), probability)
    few = train._classifier(cfg, 5).fit(model.stages[0].transform(df))
    assert [t.value.tolist() for t in staged.trees_of(few)] == [t.value.tolist() for t in trees[:5]]  # a prefix of the longer run


def test_the_best_prefix_has_patience():
    assert train.best_prefix([0.1, 0.3, 0.2, 0.3, 0.29], 30) == (2, False)
    assert train.best_prefix([0.1, 0.3] + [0.2] * 3 + [0.9], 3) == (2, True)
    assert train.best_prefix([0.1, 0.3] + [0.2] * 3 + [0.9], 4) == (6, False)


def test_training_keeps_the_prefix_of_best_average_precision(spark, monkeypatch):
    df = labelled(spark, 500).persist()
    said = []

    def rigged(model, rows, start, stop):  # the log loss of these rows stops elsewhere
        said.append((start, stop))
        return [0.5 + 0.01 * min(i, 7) - 0.001 * max(0, i - 7) for i in range(start, stop)]

    monkeypatch.setattr(train, "staged_average_precision", rigged)
    cfg = train.TrainConfig(trees=20, least_trees=3, first_trees=6, patience=5, depth=2)
    model, found = train.train(df, cfg)
    assert said == [(0, 6), (6, 12), (12, 20)][: len(said)] and found["best_trees"] == 8 == found["trees"] == model.stages[-1].getNumTrees
    assert found["stopped_early"] and not found["forced_least_trees"]
    _, few = train.train(df, train.TrainConfig(trees=20, least_trees=10, first_trees=20, patience=5, depth=2))
    assert few["forced_least_trees"] and few["trees"] == 10


# ---- checks and skew


def test_checks_read_a_table_twice_at_most(spark, tmp_path):
    rows = {"a": [(1, 1, None), (1, None, "x"), (2, 9, "x"), (None, 9, "y")], "b": [(1,), (1,), (None,)]}
    tables = {"a": spark.createDataFrame(rows["a"], "id long, ref int, s string"), "b": spark.createDataFrame(rows["b"], "ref long"), "none": spark.createDataFrame([], "ref long")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    c = governance.Check
    checks = [c("a", "unique", "id"), c("a", "unique", "s"), c("a", "required", "ref"), c("a", "required", "s"), c("a", "references", "ref", "b"), c("a", "at_least", least=6), c("b", "unique", "ref"), c("none", "unique", "ref"), c("a", "references", "ref", "none"), c("none", "at_least", least=1)]
    out = governance.run_checks(tables, checks)
    assert [r.failures for r in out.collect()] == [1, 1, 1, 1, 2, 2, 1, 0, 3, 1]
    assert [(r.table, r.kind, r.column) for r in out.collect()] == [(x.table, x.kind, x.column) for x in checks]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [id") <= 2 and plan.count("Relation [") <= 6


def test_skew_tells_shifted_distributions_from_swapped_rows(spark):
    t = Tables(spark, SF)
    now = velocity.served(t.known)
    swapped = now.withColumns({"velocity_1h": F.lit(1) + F.pmod(F.col("velocity_1h") + 1, F.lit(3)), "model_version": F.lit("m"), "rules_triggered": F.array().cast("array<string>"), "fraud_score": F.lit(0.1), "decision": F.lit("allow")})
    logs = documents.to_transaction_logs(swapped)
    got = {r.feature: r for r in monitor.skew_by_feature(logs.unionByName(logs.limit(50)), t.transactions).collect()}
    n = now.count()
    was, is_ = Counter(r[0] for r in swapped.select("velocity_1h").collect()), Counter(r[0] for r in now.select("velocity_1h").collect())
    distance = max(abs(sum(was[v] for v in was if v <= x) - sum(is_[v] for v in is_ if v <= x)) for x in {*was, *is_}) / n
    assert got["velocity_1h"].rows == n and got["velocity_1h"].distance == pytest.approx(distance) and got["velocity_1h"].skewed
    assert (got["velocity_24h"].equal, got["velocity_24h"].distance, got["velocity_24h"].skewed) == (n, 0.0, False)


def test_unknown_checks_are_errors(spark):
    with pytest.raises(ValueError, match="unknown check"):
        governance.run_checks({"a": spark.range(1)}, [governance.Check("a", "odd", "id")])
