"""Model versions: a folder for each, and a record that says which one is current."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from payguard.sources.snapshots import _path, _read as _text, exists

#: A candidate whose key measure is lower by more than this is not accepted.
TOLERANCE = 0.10


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(_text(spark, path))


def _write(spark: SparkSession, path: str, record: dict) -> None:
    """Write beside, then rename: a reader sees the old record or the new one."""
    fs, target = _path(spark, path)
    _, beside = _path(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def use_checkpoints(spark: SparkSession, root: str) -> None:
    """Checkpoints go to the model store, which all executors share, unless the session has a folder for them."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{root}/_checkpoints")


def save(spark: SparkSession, root: str, model: PipelineModel, meta: dict) -> str:
    """Store a candidate; its version. It is not current yet."""
    version = f"gbt-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    model.write().save(f"{root}/{version}/model")
    _write(spark, f"{root}/{version}/meta.json", meta | {"version": version})
    return version


def key_metric(meta: dict) -> float:
    """Recall at the block threshold, else recall."""
    return meta.get("recall_at_block", meta.get("recall", 0.0))


def accept_or_rollback(spark: SparkSession, root: str, version: str, tolerance: float = TOLERANCE) -> dict:
    """Make a candidate current unless it is worse than the current model by more than the tolerance: before, after, rolled_back."""
    after = key_metric(_read(spark, f"{root}/{version}/meta.json"))
    pointer = f"{root}/current.json"
    before = key_metric(_read(spark, f"{root}/{_read(spark, pointer)['version']}/meta.json")) if exists(spark, pointer) else None
    worse = before is not None and before - after > tolerance
    if not worse:
        _write(spark, pointer, {"version": version})
    return {"model_metric_before": before, "model_metric_after": after, "rolled_back": worse}


def current(root: str) -> tuple[PipelineModel, dict] | None:
    """The current model and its record, or None."""
    spark = SparkSession.active()
    if not exists(spark, f"{root}/current.json"):
        return None
    version = _read(spark, f"{root}/current.json")["version"]
    return _load(spark.sparkContext.applicationId, root, version)


@lru_cache(maxsize=2)
def _load(application: str, root: str, version: str) -> tuple[PipelineModel, dict]:
    """A version, which never changes; kept, so that a stream reads a model once and not for each batch."""
    return PipelineModel.load(f"{root}/{version}/model"), _read(SparkSession.active(), f"{root}/{version}/meta.json")
