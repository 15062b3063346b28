"""How many transactions a customer made in the time before each one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payguard.functions.columns import micros

HOUR, DAY = 3_600, 86_400


def with_velocity(df: DataFrame, name: str, seconds: int, *, key: str | list[str] = "customer_id", ts: str = "created_at", include_current: bool = True, lower_open: bool = True) -> DataFrame:
    """Add `name`: rows of the same key in the trailing time range, as a window frame on event time.

    include_current counts the row itself and others of the same microsecond
    (served velocity); without it the range ends before the row (training
    velocity). lower_open leaves out the instant exactly `seconds` earlier.
    The count is a difference of two running counts, which see each row once;
    a sliding frame would count all of its rows again at each row.
    """
    far = -seconds * 1_000_000 + (1 if lower_open else 0)
    by, start = Window.partitionBy(key).orderBy(micros(ts)), Window.unboundedPreceding
    near, before = by.rangeBetween(start, 0 if include_current else -1), by.rangeBetween(start, far - 1)
    return df.withColumn(name, F.count(F.lit(1)).over(near) - F.when(F.col(ts).isNotNull(), F.count(F.lit(1)).over(before)).otherwise(0))


def _by_day(df: DataFrame, key: str, ts: str, **how: bool) -> DataFrame:
    """velocity_1h and velocity_24h; rows are dealt by key and day, so that no task has more than two days of a key.

    A day's rows also count in the next day's ranges, so their times travel
    there too, alone. One shuffle for both columns.
    """
    day = F.expr(f"(unix_micros({ts}) - pmod(unix_micros({ts}), {DAY * 1_000_000}L)) div {DAY * 1_000_000}L")
    own = df.withColumns({"_own": F.lit(True), "_day": day})
    carried = df.select(key, ts).withColumns({"_own": F.lit(False), "_day": day + 1})
    rows = own.unionByName(carried, allowMissingColumns=True)
    for name, seconds in (("velocity_1h", HOUR), ("velocity_24h", DAY)):
        rows = with_velocity(rows, name, seconds, key=[key, "_day"], ts=ts, **how)
    columns = [c for c in df.columns if c not in ("velocity_1h", "velocity_24h")]
    return rows.filter("_own").select(*columns, "velocity_1h", "velocity_24h")


def served(df: DataFrame, key: str = "customer_id", ts: str = "created_at") -> DataFrame:
    """velocity_1h and velocity_24h as the scorer sees them: the row itself included."""
    return _by_day(df, key, ts, include_current=True, lower_open=True)


def training(df: DataFrame, key: str = "customer_id", ts: str = "created_at") -> DataFrame:
    """velocity_1h and velocity_24h from strictly earlier rows only."""
    return _by_day(df, key, ts, include_current=False, lower_open=False)
