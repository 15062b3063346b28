"""Column helpers: exact ratios and roundings, JSON keys, elapsed time, shares of a total."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(x: ColumnLike | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)


def _scaled(numerator: ColumnLike, denominator: ColumnLike | int, digits: int, factor: int) -> tuple[Column, Column]:
    # Sums of a large table, scaled and doubled, pass 64 bits.
    return _col(numerator).cast("decimal(38,0)") * F.lit(factor * 10**digits), _col(denominator).cast("decimal(38,0)")


def ratio(numerator: ColumnLike, denominator: ColumnLike | int, digits: int, factor: int = 1) -> Column:
    """factor * numerator / denominator of two counts, rounded half up to `digits`; null where the denominator is 0.

    Whole-number arithmetic up to the last step, so no rounding depends on the
    engine. For numerators of 0 or more.
    """
    n, d = _scaled(numerator, denominator, digits, factor)
    return _div(2 * n + d, 2 * d) / F.lit(float(10**digits))


def ratio_half_even(numerator: ColumnLike, denominator: ColumnLike | int, digits: int, factor: int = 1) -> Column:
    """ratio() with exact halves rounded to the even neighbour."""
    n, d = _scaled(numerator, denominator, digits, factor)
    q = _div(n, d)
    twice = 2 * (n - q * d)
    up = (twice > d) | ((twice == d) & (q % 2 == 1))
    return (q + up.cast("bigint")) / F.lit(float(10**digits))


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient; null where b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def cents(column: ColumnLike) -> Column:
    """An amount of cents in units, two digits exactly."""
    return _col(column) / F.lit(100.0)


def has_key(json: ColumnLike, key: str) -> Column:
    """Whether a JSON object has the key, be its value null or not; false for null and for text that is no object."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(json)), key), F.lit(False))


def json_boolean(json: ColumnLike, key: str) -> Column:
    """A boolean under a key; null where it is missing, null or something else. Also reads an object that was encoded twice."""
    text = _col(json)
    inner = F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")
    plain = F.get_json_object(text, f"$.{key}")
    return F.coalesce(plain, F.get_json_object(inner, f"$.{key}")).try_cast("boolean")


def micros(ts: ColumnLike) -> Column:
    return F.unix_micros(_col(ts))


def elapsed_days(since: ColumnLike, as_of: ColumnLike) -> Column:
    """Whole days of 24 hours between two instants."""
    return F.floor((micros(as_of) - micros(since)) / F.lit(86_400_000_000)).cast("int")


def elapsed_hours(since: ColumnLike, as_of: ColumnLike) -> Column:
    return (micros(as_of) - micros(since)) / F.lit(3_600_000_000.0)


def share_of_total(column: ColumnLike) -> Column:
    """A value over the sum of all rows; for results of an aggregation, as one task sees all rows."""
    total = F.sum(_col(column)).over(Window.partitionBy())
    return _col(column) / F.nullif(total, F.lit(0).cast("bigint"))


def date_key(ts: ColumnLike) -> Column:
    """YYYYMMDD as a whole number."""
    day = F.to_date(_col(ts))
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def year_of(key: ColumnLike) -> Column:
    """The year of a date key; with month_of and quarter_of, calendar parts of facts without a calendar that could lack a day."""
    return F.call_function("div", _col(key), F.lit(10000)).cast("int")


def month_of(key: ColumnLike) -> Column:
    return (F.call_function("div", _col(key), F.lit(100)) % 100).cast("int")


def quarter_of(key: ColumnLike) -> Column:
    return F.call_function("div", month_of(key) + 2, F.lit(3)).cast("int")


def day_of(key: ColumnLike) -> Column:
    """The day of a date key."""
    return F.to_date(_col(key).cast("string"), "yyyyMMdd")


def confusion_counts(rows: str = "n") -> list[Column]:
    """Aggregates of rows that have booleans predicted and is_fraud: their number (named `rows`), tp, fp, fn."""
    hit, true = F.col("predicted"), F.col("is_fraud")
    return [F.count(F.lit(1)).alias(rows), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")]


def fingerprint(secret: ColumnLike) -> Column:
    """SHA-256 of a value as lowercase hex: tells equal cards apart from others without their numbers."""
    return F.sha2(_col(secret).cast("string").cast("binary"), 256)


def pseudonym(identifier: ColumnLike) -> Column:
    """The address that an erased customer gets."""
    return F.concat(F.lit("anonymized_"), F.left(F.md5(_col(identifier).cast("string").cast("binary")), F.lit(8)), F.lit("@deleted.invalid"))
