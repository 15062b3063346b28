"""Training sets and their split by time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.functions import velocity
from payguard.functions.features import feature_columns
from payguard.sources.tables import truth

#: Rows without which nothing is trained or measured.
LEAST_TRAINING, LEAST_WINDOW = 200, 30


def training_set(transactions: DataFrame) -> DataFrame:
    """Labelled rows with velocity from strictly earlier rows, the feature columns and label (double)."""
    rows = truth(velocity.training(transactions.filter("customer_id IS NOT NULL"))).filter("is_fraud IS NOT NULL")
    return feature_columns(rows).withColumn("label", F.col("is_fraud").cast("double"))


def current_window(transactions: DataFrame, as_of, minutes: int) -> DataFrame:
    """training_set() of the last minutes before as_of (a timestamp column); velocity looks back a day further."""
    rows = transactions.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {minutes + 1440} MINUTES"))
    return training_set(rows).filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES"))


#: Steps of a search among times (day, minute, millisecond, microsecond) and among 64-bit ids.
_TIME_STEPS, _ID_STEPS = (86_400_000_000, 60_000_000, 1000, 1), (1 << 48, 1 << 32, 1 << 16, 1)


def _search(values: DataFrame, share: float | None, rank: int | None, steps: tuple[int, ...]) -> tuple[int, int, int] | None:
    """The value of a rank (or of percentile_disc(share)) in the bigint column v, its rank among its equals, and their number; None without rows.

    Rows are counted by the first step's width, then, within the range that
    holds the rank, by the next one's. A step gives the driver a row for each
    day there is, or about 130,000 rows at most.
    """
    rows, before = values.filter("v IS NOT NULL"), 0
    for width in steps:
        # Whole-number division keeps the order, below 0 too.
        counts = sorted(rows.groupBy(F.expr(f"v div {width}L").alias("at")).count().collect())
        if not counts:
            return None
        if rank is None:
            rank = max(1, math.ceil(share * sum(n for _, n in counts)))
        for at, n in counts:
            if before + n >= rank:
                break
            before += n
        rows = rows.filter(F.expr(f"v div {width}L = {at}L"))
    return at, rank - before, n


def time_quantile(df: DataFrame, share: float, ts: str = "created_at") -> int | None:
    """percentile_disc(share) of a column of times, in microseconds; None without rows."""
    found = _search(df.select(F.unix_micros(ts).alias("v")), share, None, _TIME_STEPS)
    return found and found[0]


def temporal_split(df: DataFrame, share: float = 0.2, ts: str = "created_at", tie: str = "txn_id") -> tuple[DataFrame, DataFrame]:
    """The oldest rows and the newest `share`, cut at an exact quantile of (time, tie); without a column `tie`, rows of the cutting instant are all old."""
    us = F.unix_micros(ts)
    found = _search(df.select(us.alias("v")), 1 - share, None, _TIME_STEPS)
    if found is None:
        return df.limit(0), df.limit(0)
    cut, place, equal = found
    old = us <= F.lit(cut)
    if place < equal and tie in df.columns:
        among = _search(df.filter(us == F.lit(cut)).select(F.col(tie).cast("bigint").alias("v")), None, place, _ID_STEPS)
        if among is not None:
            old = (us < F.lit(cut)) | ((us == F.lit(cut)) & F.coalesce(F.col(tie) <= F.lit(among[0]), F.lit(False)))
    return df.filter(old), df.filter(~old)
