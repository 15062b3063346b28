"""Privacy and data-quality jobs: erasure, retention, restricted views, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.columns import pseudonym

#: Table, rule and days of each retention rule; fixed values. 0 days: the row says when it expires.
RETENTION = (("transaction_logs", "created_at", 90), ("user_interactions", "created_at", 30), ("logs", "ttl_expires_at", 0))
#: Columns of payment methods that analysts see; new columns stay hidden until they are listed.
ANALYST_PAYMENT_METHODS = ("pm_id", "customer_id", "type", "brand", "last4", "is_default", "expires_at", "created_at")


def anonymize(customers: DataFrame, payment_methods: DataFrame, transactions: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Erase the customers in `ids` (customer_id): the three tables after it, counts by id, and unknown ids.

    Transactions stay, without their customer. Nothing is written, so the
    same call is a rehearsal.
    """
    asked = ids.select("customer_id").distinct()
    known = asked.join(customers.select("customer_id"), "customer_id", "left_semi").withColumn("_erase", F.lit(True))
    gone = F.coalesce("_erase", F.lit(False))
    people = customers.join(known, "customer_id", "left").withColumns({"email": F.when(gone, pseudonym("customer_id")).otherwise(F.col("email")), "name": F.when(gone, F.lit("ANONYMIZED")).otherwise(F.col("name")), "country_code": F.when(gone, F.lit(None)).otherwise(F.col("country_code"))})
    cards = payment_methods.join(known, "customer_id", "left").withColumns({"fingerprint": F.when(gone, F.lit("REDACTED")).otherwise(F.col("fingerprint")), "last4": F.when(gone, F.lit(None)).otherwise(F.col("last4"))})
    moved = transactions.join(known, "customer_id", "left").withColumn("_customer", F.col("customer_id")).withColumn("customer_id", F.when(gone, F.lit(None)).otherwise(F.col("customer_id")))
    detached = moved.filter("_erase").groupBy(F.col("_customer").alias("customer_id")).agg(F.count(F.lit(1)).alias("detached"))
    counts = known.select("customer_id").join(detached, "customer_id", "left").select("customer_id", F.coalesce("detached", F.lit(0)).alias("detached"))
    return {"customers": people.select(*customers.columns), "payment_methods": cards.select(*payment_methods.columns), "transactions": moved.select(*transactions.columns), "counts": counts, "unknown": asked.join(customers.select("customer_id"), "customer_id", "left_anti")}


def keeps(as_of, column: str, days: int) -> Column:
    """Whether a retention rule keeps a row at `as_of`."""
    limit = F.col(column) if days == 0 else F.col(column) + F.expr(f"INTERVAL {days} DAYS")
    return limit > as_of


def retained(df: DataFrame, as_of, column: str, days: int) -> DataFrame:
    """Rows that a retention rule keeps at `as_of`."""
    return df.filter(keeps(as_of, column, days))


def retention_report(spark: SparkSession, rules: tuple = RETENTION) -> DataFrame:
    return spark.createDataFrame(list(rules), "collection string, rule string, expire_after_days int")


def analyst_view(df: DataFrame, allowed: tuple[str, ...] = ANALYST_PAYMENT_METHODS) -> DataFrame:
    """Only the allowed columns, as far as df has them."""
    return df.select(*(c for c in allowed if c in df.columns))


@dataclass(frozen=True)
class Check:
    """One expectation about a table: kind is unique, required, references or at_least."""

    table: str
    kind: str
    column: str = ""
    target: str = ""
    least: int = 0


def run_checks(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """One row for each check: table, kind, column, failures, passed.

    A table is read twice at most, however many checks it has: all counts of
    its rows are one aggregate, and all checks that compare keys, of all
    tables, are one aggregate by (check, key), partial before its shuffle.
    """
    unknown = {c.kind for c in checks} - {"unique", "required", "references", "at_least"}
    if unknown:
        raise ValueError(f"unknown check {unknown.pop()}")
    parts, keyed = [], []
    for name, df in tables.items():
        counted, pairs = [], []
        for i, c in enumerate(checks):
            if c.table == name and c.kind == "required":
                counted.append(F.struct(F.lit(i).alias("check"), F.count_if(F.col(c.column).isNull()).alias("failures")))
            elif c.table == name and c.kind == "at_least":
                counted.append(F.struct(F.lit(i).alias("check"), F.greatest(F.lit(c.least) - F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("failures")))
            elif c.kind in ("unique", "references"):
                pairs += [F.struct(F.lit(i).alias("check"), F.col(c.column).cast("string").alias("value"), F.lit(held).alias("target")) for held in (False, True) if name == (c.target if held else c.table)]
        if counted:
            parts.append(df.agg(F.array(*counted).alias("x")).select(F.inline("x")))
        if pairs:
            keyed.append(df.select(F.inline(F.array(*pairs))).filter("value IS NOT NULL"))
    if keyed:
        both = keyed[0]
        for k in keyed[1:]:
            both = both.unionAll(k)
        values = both.groupBy("check", "value").agg(F.count_if(~F.col("target")).alias("n"), F.count_if("target").alias("m"))
        unique = F.col("check").isin([i for i, c in enumerate(checks) if c.kind == "unique"])
        failures = F.sum(F.when(unique, (F.col("n") > 1).cast("bigint")).otherwise(F.when(F.col("m") == 0, F.col("n")).otherwise(0)))
        parts.append(values.groupBy("check").agg(failures.alias("failures")))
    named = F.broadcast(next(iter(tables.values())).sparkSession.createDataFrame([(i, c.table, c.kind, c.column) for i, c in enumerate(checks)], "check int, table string, kind string, column string"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # A check without a row has nothing to compare, so nothing fails.
    out = named.join(found.groupBy("check").agg(F.sum("failures").alias("failures")), "check", "left").orderBy("check")
    return out.select("table", "kind", "column", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), (F.coalesce("failures", F.lit(0)) == 0).alias("passed"))
