"""Versioned tables by bucket, tables of batches, and jobs that share one root."""

import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from payguard.jobs import daily_load, erase, fan_out, retain, series, stream_score
from payguard.operators import documents, preagg, sketches, star, writeback
from payguard.plans import registry, warehouse
from payguard.sources import snapshots
from payguard.sources.snapshots import Conflict, Snapshots, put_batch, read_batch
from payguard.sources.tables import Tables, read_table, typed
from payguard.streaming import fanout, score

from .conftest import SF
from .test_streaming import finish, messages

T0 = datetime(2024, 1, 1, 12)


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def keyed(spark, root, n=20_000, buckets=16):
    store = Snapshots(spark, str(root))
    store.commit({"a": spark.range(n).select("id", (F.col("id") * 3).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("s"))}, keys={"a": "id"}, buckets=buckets)
    return store


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    store = keyed(spark, tmp_path)
    whole = size(tmp_path / "a")
    changes = spark.createDataFrame([(5, -1, "x", False), (7, 0, "y", True), (10**6, 1, "new", False)], "id long, v long, s string, _deleted boolean")
    base = store.version()
    store.commit(changes={"a": changes}, base=base)
    assert size(tmp_path / "a") - whole < whole / 50
    got = {r.id: r.v for r in store.current("a").filter("id IN (4, 5, 7, 1000000)").collect()}
    assert got == {4: 12, 5: -1, 10**6: 1} and store.current("a").count() == 20_000
    assert store.current("a", base).filter("id = 7").count() == 1
    keys = spark.createDataFrame([(5,), (7,), (8,), (10**6,)], "id long")
    assert {r.id: r.v for r in store.rows_of("a", keys).collect()} == {5: -1, 8: 24, 10**6: 1}
    before = size(tmp_path / "a")
    assert store.compact("a") and not store.compact("a")
    assert size(tmp_path / "a") - before < whole * 0.4  # three buckets of sixteen
    assert {r.id: r.v for r in store.current("a").filter("id IN (4, 5, 7, 1000000)").collect()} == got and store.current("a").count() == 20_000
    store.vacuum(0)
    assert size(tmp_path / "a") < whole * 1.1 and store.current("a").count() == 20_000


def test_changes_of_random_batches_equal_a_dictionary(spark, tmp_path):
    store, rng, want = Snapshots(spark, str(tmp_path)), random.Random(5), {}
    store.commit({"t": spark.createDataFrame([], "id long, v int")}, keys={"t": "id"}, buckets=4)
    for step in range(6):
        batch = {i: None if rng.random() < 0.3 else step for i in rng.sample(range(30), 8)}
        store.commit(changes={"t": spark.createDataFrame([(i, v, v is None) for i, v in batch.items()], "id long, v int, _deleted boolean")})
        want = {i: v for i, v in (want | batch).items() if v is not None}
        if step == 3:
            store.compact("t")
        assert {r.id: r.v for r in store.current("t").collect()} == want


def test_writers_of_other_buckets_do_not_collide(spark, tmp_path):
    store = keyed(spark, tmp_path, 200)
    bucket = {r.id: r.b for r in spark.range(200).select("id", snapshots._bucket("id", 16).alias("b")).collect()}
    a = 0
    b, c = next(i for i in bucket if bucket[i] != bucket[a]), next(i for i in bucket if bucket[i] == bucket[a] and i != a)
    base = store.version()

    def change(i):
        return {"a": spark.createDataFrame([(i, -i, "c")], "id long, v long, s string")}

    store.commit(changes=change(a), base=base)
    store.commit(changes=change(b), base=base)
    with pytest.raises(Conflict):
        store.commit(changes=change(c), base=base)
    assert store.compact("a")
    store.commit(changes=change(c), base=store.version())
    with pytest.raises(Conflict):
        store.commit(marks={"m": 2}, base=store.commit(marks={"m": 1}) - 1)
    assert store.mark("m") == 1 and store.current("a").count() == 200
    tries = []

    def step(base):
        tries.append(base)
        if len(tries) == 1:
            store.commit(changes=change(c))  # another writer comes first
        return store.commit(changes=change(c), base=base)

    store.retry(step)
    assert len(tries) == 2


def test_vacuum_keeps_what_readers_may_need(spark, tmp_path):
    store = keyed(spark, tmp_path, 100)
    old = store.current("a")
    store.commit({"a": spark.range(5).select("id", "id", F.lit("x")).toDF("id", "v", "s")})
    spark.range(3).write.parquet(f"{tmp_path}/a/left-by-a-crash")
    assert store.vacuum() == [] and old.count() == 100 and (tmp_path / "a/left-by-a-crash").exists()
    assert store.vacuum(0) == [1] and not (tmp_path / "a/left-by-a-crash").exists()
    assert store.current("a").count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        spark.createDataFrame(old.rdd).count()


def test_a_batch_is_written_once(spark, tmp_path):
    folder = f"{tmp_path}/events"
    assert put_batch(spark.range(3), folder, 0, "w") and not put_batch(spark.range(9), folder, 0, "w")
    assert read_batch(spark, folder, 0).count() == 3
    with pytest.raises(ValueError, match="written by w"):
        put_batch(spark.range(9), folder, 0, "another checkpoint")
    Path(f"{folder}_batches/{0:012d}.json").unlink()  # as if the writer had stopped before the log
    assert not put_batch(spark.range(9), folder, 0, "w") and Path(f"{folder}_batches/{0:012d}.json").exists()
    assert list(Path(f"{folder}_staged").iterdir()) == []


def test_a_repeated_scoring_batch_is_not_logged_again(spark, tmp_path):
    rows = Tables(spark, SF).scored.limit(20).withColumn("scored_at", F.current_timestamp())
    events, docs = f"{tmp_path}/events", str(tmp_path / "docs")
    for _ in range(2):  # the scoring stream repeats its batch, with other files
        put_batch(rows.repartition(3), events, 0, "q")
        finish(fan_out.start(spark, events, docs))
    put_batch(rows.withColumn("txn_id", -F.col("txn_id") - 1), events, 1, "q")
    finish(fan_out.start(spark, events, docs))
    counts = [spark.read.parquet(f"{docs}/{n}").count() for n in ("transaction_logs", "logs", "fraud_alerts")]
    alerts = rows.filter("decision <> 'allow'").count() * 2
    assert counts == [40, 40, alerts]
    features = Snapshots(spark, f"{docs}/features").current("ml_features").toPandas()
    tables = fanout.Tables(f"{docs}/transaction_logs", f"{docs}/logs", f"{docs}/fraud_alerts", f"{docs}/features")
    finish(fanout.start_fanout(spark, events, tables, f"{tmp_path}/a-lost-checkpoint"))
    assert counts == [spark.read.parquet(f"{docs}/{n}").count() for n in ("transaction_logs", "logs", "fraud_alerts")]
    assert sorted(map(str, features.itertuples(index=False))) == sorted(map(str, Snapshots(spark, f"{docs}/features").current("ml_features").toPandas().itertuples(index=False)))


@pytest.fixture(scope="module")
def shared_root(spark, tmp_path_factory):
    """Scoring, fan-out, series and daily load over one root."""
    root, folder, t = str(tmp_path_factory.mktemp("root")), str(tmp_path_factory.mktemp("in")), Tables(spark, SF)
    rows = messages(spark, folder, 3)
    first = typed(rows.withColumn("fraud_score", F.lit(None)), "transactions")
    Snapshots(spark, f"{root}/oltp").commit({"transactions": first, "indicators": t.indicators.limit(0), "merchants": typed(t.merchants, "merchants"), "payment_methods": typed(t.payment_methods.withColumn("is_default", F.lit(True)), "payment_methods"), "customers": typed(t.customers, "customers")} | preagg.build_maintained(first), keys=writeback.KEYS | preagg.maintained_keys())
    finish(*stream_score.start(spark, folder, f"{root}/out", tables=f"{root}/oltp"))
    finish(fan_out.start(spark, f"{root}/out/events", f"{root}/docs"), series.start(spark, f"{root}/out/events", f"{root}/docs"))
    return root, rows


def test_jobs_share_one_root(spark, shared_root):
    root, rows = shared_root
    oltp = f"{root}/oltp"
    got = read_table(spark, "transactions", f"{oltp}/transactions")
    assert got.count() == rows.count() and got.filter("fraud_score IS NOT NULL").count() == rows.filter("customer_id IS NOT NULL").count()
    day = str(rows.agg(F.min("created_at")).first()[0].date())
    added = daily_load.load(spark, oltp, f"{root}/w", day)
    assert added["fact"] == rows.filter(f"status = 'succeeded' AND to_date(created_at) = DATE '{day}'").count() > 0
    stored = Snapshots(spark, f"{root}/w/preagg").current("daily_revenue")
    assert sorted(map(str, stored.collect())) == sorted(map(str, preagg.daily_revenue(got).select(*stored.columns).collect()))
    with pytest.raises(ValueError, match="no table"):
        read_table(spark, "transactions", root)


def test_erasure_reaches_the_files(spark, tmp_path):
    t, root = Tables(spark, SF), str(tmp_path)
    store = Snapshots(spark, root)
    store.commit({n: getattr(t, n) for n in erase.NAMES})
    name, email = (r := t.customers.filter("customer_id = 3").first()).name, r.email
    card = t.payment_methods.filter("customer_id = 3 AND fingerprint IS NOT NULL").first().fingerprint
    kept = store.current("transactions")

    def held(word):
        import pyarrow.parquet as pq

        return [p for p in Path(root).rglob("*.parquet") if any(word in map(str, c.to_pylist()) for c in pq.ParquetFile(p).read().columns)]

    assert held(name) and held(email) and held(card)
    counts, unknown = erase.erase(spark, root, spark.createDataFrame([(3,)], "customer_id bigint"))
    assert counts.collect()[0].detached == t.transactions.filter("customer_id = 3").count() > 0 and unknown.isEmpty()
    assert not held(name) and not held(email) and not held(card)
    assert store.current("transactions").count() == t.transactions.count() and store.current("transactions").filter("customer_id = 3").isEmpty()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        kept.select("metadata").collect()


def test_retention_reaches_the_files(spark, tmp_path):
    logs = documents.to_transaction_logs(Tables(spark, SF).scored)
    store = Snapshots(spark, str(tmp_path))
    store.commit({"transaction_logs": logs})
    retain.retain(spark, str(tmp_path), "2024-04-10")
    left = spark.read.parquet(f"{tmp_path}/transaction_logs/*")
    assert left.count() == store.current("transaction_logs").count() < logs.count()


# ---- star


def test_facts_are_read_by_partition(spark):
    for name in ("olap_region_quarter", "olap_payment_mix"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan" in line and "date_key" in line)
        assert "PartitionFilters: [isnotnull(month_key" in scan and "GreaterThanOrEqual(date_key" in scan
    store = warehouse.stored_star(spark, SF, "events")
    assert store.version() == warehouse.stored_star(spark, SF, "events").version()
    day = star.of_days(store.current(star.FACTS), [20240105])
    assert len(day.inputFiles()) >= len(day.select("txn_id").inputFiles()) > 0
    scan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "202401" in scan


def test_a_load_reads_the_days_that_it_adds_to(spark, tmp_path):
    t = Tables(spark, SF)
    for day in ("2024-01-05", "2024-01-06"):
        star.load_day(spark, star.daily_extract(t.decided, t.payment_methods, t.merchants, day), str(tmp_path))
    store = Snapshots(spark, f"{tmp_path}/star")
    plan = star.of_days(store.current(star.FACTS), [20240106]).select("date_key", "txn_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date_key" in plan[plan.index("PartitionFilters: [") :].split("]")[0]


def test_two_loads_at_once_give_unique_keys(spark, tmp_path, monkeypatch):
    t, store = Tables(spark, SF), Snapshots(spark, f"{tmp_path}/star")
    first, second = (star.daily_extract(t.decided, t.payment_methods, t.merchants, d) for d in ("2024-01-05", "2024-01-06"))
    commit, calls = Snapshots.commit, []

    def late(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            star.load(Snapshots(spark, f"{tmp_path}/star"), second)  # another writer between reading and writing
        return commit(self, *args, **kwargs)

    monkeypatch.setattr(Snapshots, "commit", late)
    star.load(store, first)
    for name, (natural, surrogate) in star.KEYS.items():
        dim = store.current(f"dim_{name}")
        n = dim.count()
        assert n == dim.select(natural).distinct().count() == dim.select(surrogate).distinct().count() == dim.agg(F.max(surrogate)).first()[0]
    assert store.current(star.FACTS).count() == first.count() + second.count()


# ---- maintained results


def test_corrections_equal_a_recomputation(spark, tmp_path):
    rng = random.Random(7)

    def row(i):
        return (i, rng.choice([1, 2, None]), rng.randrange(1000), rng.choice(["EUR", "USD"]), rng.choice(["succeeded", "failed"]), rng.choice([None, 0.5, 0.9]), T0 + timedelta(days=rng.randrange(3)), rng.randrange(10**6), rng.choice(["true", "false", None]))

    schema = "txn_id long, merchant_id long, amount long, currency string, status string, fraud_score double, created_at timestamp, offset long, __deleted string"
    store = Snapshots(spark, str(tmp_path))
    first = writeback.latest_images(spark.createDataFrame([row(i) for i in range(40)], schema), "txn_id", ("offset",))
    store.commit({"transactions": first} | preagg.build_maintained(first), keys=writeback.KEYS | preagg.maintained_keys())
    for _ in range(3):
        batch = [row(rng.randrange(60)) for _ in range(25)]
        writeback.apply_images(store, "transactions", spark.createDataFrame(batch, schema), "txn_id", ("offset",))
        rows = store.current("transactions")
        for name, m in preagg.MAINTAINED.items():
            want = m.rows(rows)
            zero = {c: F.coalesce(c, F.lit(0)) for c in m.sums(want)}
            assert Counter(map(tuple, store.current(name).select(*want.columns).withColumns(zero).collect())) == Counter(map(tuple, want.withColumns(zero).collect()))
    writeback.apply_scores(store, spark.createDataFrame([(r.txn_id, T0, 0.7, "review", ["R1"], "m") for r in rows.filter("fraud_score IS NULL").limit(5).collect()], "txn_id long, created_at timestamp, fraud_score double, decision string, rules_triggered array<string>, model_version string")) if "indicators" in store.names() else None
    assert store.version() >= 4


def test_maintaining_begins_at_a_version(spark, tmp_path, monkeypatch):
    rows = [(i, 1, 10, "EUR", "succeeded", 0.5, T0, i) for i in range(6)]
    schema = "txn_id long, merchant_id long, amount long, currency string, status string, fraud_score double, created_at timestamp, offset long"
    store, more = Snapshots(spark, str(tmp_path)), spark.createDataFrame([(9, 1, 5, "EUR", "succeeded", 0.5, T0, 9)], schema)
    store.commit({"transactions": spark.createDataFrame(rows, schema)}, keys=writeback.KEYS)
    real, calls = preagg.build_maintained, []

    def slow(df):
        calls.append(1)
        if len(calls) == 1:
            store.commit(changes={"transactions": more})  # rows change while the sums are built
        return real(df)

    monkeypatch.setattr(preagg, "build_maintained", slow)
    preagg.maintain(store)
    assert len(calls) == 2 and store.current("daily_revenue").first().gross_amount_cents == 65
    writeback.apply_images(store, "transactions", more.withColumns({"offset": F.lit(10).cast("long"), "__deleted": F.lit("true")}), "txn_id", ("offset",))
    assert store.current("daily_revenue").first().gross_amount_cents == 60 and store.current("merchant_sums").first().txn_count == 6


def test_scores_correct_the_maintained_sums(spark, shared_root):
    root, _ = shared_root
    store = Snapshots(spark, f"{root}/oltp")
    rows = store.current("transactions")
    for name, m in preagg.MAINTAINED.items():
        want = m.rows(rows)
        zero = {c: F.coalesce(c, F.lit(0)) for c in m.sums(want)}
        assert Counter(map(tuple, store.current(name).select(*want.columns).withColumns(zero).collect())) == Counter(map(tuple, want.withColumns(zero).collect()))


def test_series_count_late_rows_and_keep_them(spark, tmp_path):
    rows = [(i, T0 + timedelta(seconds=37 * i), 0.9 if i % 5 == 0 else 0.1, 100 + i) for i in range(60)]
    late = [(100 + i, T0 - timedelta(minutes=30, seconds=i), 0.9, 7) for i in range(4)]
    schema, events = "txn_id long, created_at timestamp, fraud_score double, amount long", f"{tmp_path}/events"
    for number, batch in enumerate((rows[:30], rows[30:] + late, rows[:0])):
        put_batch(spark.createDataFrame(batch, schema), events, number, "w")
    for _ in range(2):
        finish(series.start(spark, events, str(tmp_path)))
    store = Snapshots(spark, f"{tmp_path}/series")
    everything = spark.createDataFrame(rows + late, schema)
    for name, width in fanout.SERIES.items():
        assert sorted(map(tuple, store.current(name).collect())) == sorted(map(tuple, fanout.windowed_counts(everything, width).collect()))
    assert store.mark("late") == 4 and sorted(r.txn_id for r in spark.read.parquet(f"{tmp_path}/late_events").collect()) == [100, 101, 102, 103]


def test_merged_sketches_equal_direct_ones(spark):
    rows = spark.range(50_000).select((F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 86_400)).alias("created_at"), ((F.col("id") * 7919 % 9973) / 10.0).alias("duration_ms"), (F.col("id") % 3000).alias("customer_id"), F.sha2((F.col("id") % 700).cast("string"), 256).alias("fingerprint"), F.lit("FR").alias("ip_country"))
    hours = sketches.hourly(rows)
    halves = sketches.merged(hours.filter("hour(hour) < 12"), F.lit(1).alias("g")).unionByName(sketches.merged(hours.filter("hour(hour) >= 12"), F.lit(1).alias("g")))
    got = sketches.read_out(sketches.merged(halves, "g")).first()
    exact = sorted(r.duration_ms for r in rows.select("duration_ms").collect())
    n = len(exact)
    assert got.requests == n
    assert abs(sum(x <= got.quantile_ms for x in exact) / n - 0.95) <= sketches.RANK_ERROR + 1e-4
    direct = sketches.read_out(sketches.hourly(rows.withColumn("created_at", F.lit(T0)))).first()
    assert (got.customers, got.cards, got.countries) == (direct.customers, direct.cards, direct.countries)
    assert abs(got.customers - 3000) < 150 and abs(got.cards - 700) < 35 and got.countries == 1


def test_scoring_keeps_the_first_score_of_a_batch(spark, tmp_path):
    """A batch that is scored again by another model leaves what was stored."""
    rows = Tables(spark, SF).scored.limit(5).withColumn("late", F.lit(False)).withColumn("scored_at", F.current_timestamp())
    put_batch(rows, f"{tmp_path}/e", 0, "q")
    put_batch(rows.withColumn("fraud_score", F.lit(1.0)), f"{tmp_path}/e", 0, "q")
    assert sorted(r.fraud_score for r in read_batch(spark, f"{tmp_path}/e", 0).collect()) == sorted(r.fraud_score for r in rows.collect())
    assert score.counters(rows, 3).first().written_back == 3
