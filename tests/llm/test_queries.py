"""Registered queries against their SQL, and the pipeline against its stages."""

import hashlib
import os
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from payguard.llm import decontam, media, near_dup, packing, registry, secrets
from payguard.operators import running

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, same, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df())


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op2_equals_brute_force(spark):
    sizes = {i: len(t.encode()) for i, t in texts(spark).items()}
    want = {i: media.padded(t.encode()) for i, t in texts(spark).items()}
    got = registry.QUERIES["op2_media_columns"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    by_text = {}
    for r in got:
        p = want[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (sizes[r.doc_id], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        form = media.encode_png(p)
        assert (r.media_bytes, r.media_sha256, r.digest, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), hashlib.sha256(form).hexdigest(), media.feature(p))
        assert (r.width, r.height, r.bit_depth, r.length) == (64, len(p) // 64, 8, len(form)) and r.shard and r.offset >= 512
        assert by_text.setdefault(p, r[2:]) == r[2:]


def test_op3_equals_brute_force(spark):
    from .test_operators import base_brute

    got = {r.doc_id: r for r in registry.QUERIES["op3_secret_scan"](spark, SF).collect()}
    found = 0
    for i, t in texts(spark).items():
        base = base_brute(t)
        r = got.pop(i)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(","))
    assert not got


def test_op4_keeps_its_law(spark):
    got = registry.QUERIES["op4_kd_sharding"](spark, SF)
    want, shards = texts(spark), {}
    for r in got.collect():
        t = want.pop(r.doc_id).encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        shards.setdefault(r.shard, []).append(r)
    assert not want and sorted(shards) == list(range(8))
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    sums = [sum(r["size"] for r in m) for m in shards.values()]
    assert max(sums) - min(sums) <= 3 * max(r["size"] for m in shards.values() for r in m)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op5_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in texts(spark).items()}
    pieces, sequences = {}, {}
    for r in registry.QUERIES["op5_packing"](spark, SF).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.length == len(ids) > 0 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for found, total in [(p, len(want[i])) for i, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 1024
    assert 1024 * len(sequences) <= 1.02 * sum(map(len, want.values())) + 1024


def test_pipeline_stages_take_awkward_rows(spark, tmp_path):
    from .test_operators import DOCS

    df = spark.createDataFrame([(i, t, {"k": 1}) for i, t in DOCS], "doc_id bigint, text string, m map<string,int>")
    for name in ("_toxicity", "toxicity", "_hits", "hits", "_n", "_maybe", "score", "features", "row", "lang", "source"):
        df = df.withColumn(name, F.lit(3))
    df = df.withColumn("n_chars", F.length("text"))
    folder = str(tmp_path)
    spark.createDataFrame([(1, 0), (5, 1), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one TWO"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    gone = {"toxicity": 0, "near_duplicates": 5, "decontamination": 3, "secrets": 0}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, folder), stage(spark, df.limit(0), folder)
        assert none.count() == 0 and none.columns == out.columns
        if name in gone:
            assert out.columns == df.columns
            rows = out.collect()
            assert len(rows) == len(DOCS) - gone[name] and all(r.hits == r["_n"] == r.row == 3 and r.m == {"k": 1} for r in rows)
            assert any(r.text is None for r in rows) and any(r.doc_id is None for r in rows)
        else:
            assert out.select("doc_id").distinct().count() == len({str(i) for i, _ in DOCS})


def test_the_pipeline_keeps_no_intermediate_tables(spark):
    store = Path(running.shared_dir(spark).removeprefix("file:")) / "payguard"
    before = set(os.listdir(store)) if store.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    left = {x.split("-")[0] for x in set(os.listdir(store)) - before}
    assert len(left) == 1 == len(set(os.listdir(store)) - before) and out.count() > 0  # the result alone


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    single = stages["near_duplicates"](spark, docs, SF)
    kept = {r.doc_id for r in near_dup.near_duplicates(docs).filter("kept").collect()}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(kept)
    leaked = {r.doc_id for r in decontam.leaks(docs, items).collect()}
    fair = stages["decontamination"](spark, docs, SF)
    assert leaked and {r.doc_id for r in fair.collect()} == {r.doc_id for r in docs.collect()} - leaked
    open_texts = docs.withColumn("text", F.concat("text", F.lit(" token = 04dbebab91ab85687d33eeaaf9ac699e")))
    closed = stages["secrets"](spark, open_texts, SF)
    assert closed.columns == columns and closed.count() == docs.count()
    assert secrets.scan(open_texts).filter("spans <> ''").count() == docs.count() and secrets.scan(closed).filter("spans <> ''").count() == 0
    assert all(r.n_chars == len(r.text) and r.text.endswith(" [assign]") for r in closed.collect())


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() > 0.5 * spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
    from tokenizers import Tokenizer

    t, pieces = Tokenizer.from_file(packing.default_vocabulary()), {}
    for r in out.collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, ids))
    source = texts(spark)
    for i, found in pieces.items():
        ids = [x for _, p in sorted(found) for x in p]
        assert ids[-1] == 0 and (secrets.confirmed_spans(source[i]) or secrets.base_spans(source[i]) or ids[:-1] == t.encode(source[i], add_special_tokens=False).ids)
