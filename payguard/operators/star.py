"""The star schema: dimensions, facts and their incremental, replay-safe load."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.functions.columns import date_key
from payguard.operators.running import prefix_sums, scratch, written
from payguard.sources.snapshots import Snapshots

#: Country, name, region and risk of the geography dimension; fixed values. BY is left out on purpose: see unmatched.
GEOGRAPHY = (
    ("FR", "France", "Europe", False),
    ("US", "United States", "Americas", False),
    ("GB", "United Kingdom", "Europe", False),
    ("DE", "Germany", "Europe", False),
    ("ES", "Spain", "Europe", False),
    ("IT", "Italy", "Europe", False),
    ("NL", "Netherlands", "Europe", False),
    ("BE", "Belgium", "Europe", False),
    ("CA", "Canada", "Americas", False),
    ("JP", "Japan", "Asia", False),
    ("AU", "Australia", "Oceania", False),
    ("BR", "Brazil", "Americas", False),
    ("RU", "Russia", "Europe/Asia", True),
    ("NG", "Nigeria", "Africa", True),
    ("KP", "North Korea", "Asia", True),
    ("IR", "Iran", "Asia", True),
    ("VE", "Venezuela", "Americas", True),
)
FRAUD_AT = 0.85


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row for each day from start to end: date_key, full_date, year, quarter, month, ISO week, day_of_week (0 is Sunday), is_weekend."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("full_date"))
    weekday = F.dayofweek("full_date") - 1
    return days.select(date_key("full_date").alias("date_key"), "full_date", F.year("full_date").alias("year"), F.quarter("full_date").alias("quarter"), F.month("full_date").alias("month"), F.weekofyear("full_date").alias("week"), weekday.alias("day_of_week"), weekday.isin(0, 6).alias("is_weekend"))


def dim_geography(spark: SparkSession, rows: tuple = GEOGRAPHY) -> DataFrame:
    """The geography members, numbered in the order given."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "geo_key bigint, country_code string, country_name string, region string, is_high_risk boolean")


def numbered(members: DataFrame, key: str, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """Members with `name`: start + 1, start + 2, ... without gaps, in the order of a unique bigint key; and how many they are.

    Places are running totals over rows dealt by range, so no task sees all
    members, however many there are, and a replay gives the same numbers.
    """
    placed, total = prefix_sums(members, [], [key], {"_place": F.lit(1).cast("bigint")}, f"numbered-{name}")
    n = total.first()["_place"] or 0
    return placed.select(*members.columns, (F.lit(start + 1) + F.col("_place")).cast("bigint").alias(name)), n


def distinct_members(members: DataFrame, natural: str) -> DataFrame:
    """One row of each member: of repeated ones the least row counts. A null natural key is no member."""
    values = [c for c in members.columns if c != natural]
    known = members.filter(F.col(natural).isNotNull())
    return known.groupBy(natural).agg(F.min(F.struct(*values)).alias("_v")).select(natural, "_v.*") if values else known.distinct()


def insert_missing(dim: DataFrame | None, members: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """Members that the dimension lacks, with new surrogate keys above its highest."""
    once, top = distinct_members(members, natural), 0
    if dim is not None:
        once = once.join(dim.select(natural), natural, "left_anti")
        top = dim.agg(F.max(surrogate)).first()[0] or 0
    return numbered(once, natural, surrogate, top)[0]


def daily_extract(transactions: DataFrame, payment_methods: DataFrame, merchants: DataFrame, day: str | None = None) -> DataFrame:
    """Successful transactions of one day (or all days), with payment method and merchant attributes."""
    rows = transactions.filter("status = 'succeeded'")
    if day is not None:
        first = dt.date.fromisoformat(day)
        rows = rows.filter((F.col("created_at") >= F.lit(first).cast("timestamp")) & (F.col("created_at") < F.lit(first + dt.timedelta(days=1)).cast("timestamp")))
    pm = payment_methods.select("pm_id", F.col("type").alias("pm_type"), F.col("brand").alias("pm_brand"))
    m = merchants.select("merchant_id", F.col("name").alias("merchant_name"), F.col("country_code").alias("merchant_country_code"), F.col("tier").alias("merchant_tier"), F.col("status").alias("merchant_status"))
    return rows.join(pm, "pm_id", "left").join(m, "merchant_id")


def derive_facts(extract: DataFrame, fraud_at: float = FRAUD_AT) -> DataFrame:
    """Fact measures of extracted rows. Amounts are decimals of two digits: no binary rounding. processing_ms is a stand-in derived from txn_id."""
    amount = (F.col("amount").cast("decimal(18,2)") / F.lit(100)).cast("decimal(18,2)")
    fee = F.round(amount * F.lit("0.014").cast("decimal(4,3)"), 4).cast("decimal(18,4)")
    return extract.select("txn_id", "merchant_id", "customer_id", "pm_id", "ip_country", date_key("created_at").alias("date_key"), amount.alias("amount_eur"), F.round(fee, 2).cast("decimal(18,2)").alias("fee_amount"), "currency", "status", "fraud_score", F.coalesce(F.col("fraud_score") >= fraud_at, F.lit(False)).alias("is_fraud"), "device_type", (F.lit(20) + F.pmod(F.col("txn_id") * 7919, F.lit(251)) / 10).alias("processing_ms"), "created_at")


def resolve_keys(facts: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Natural keys replaced by surrogate ones through a left join with each of the dimensions given; an unknown member gives a null key."""
    out = facts
    for name, (natural, surrogate) in KEYS.items():
        if name in dims:
            out = out.join(dims[name].select(natural, surrogate), natural, "left")
    return out.join(dims["geography"].select(F.col("country_code").alias("ip_country"), "geo_key"), "ip_country", "left").drop("merchant_id", "customer_id", "pm_id", "ip_country")


def members(extract: DataFrame) -> dict[str, DataFrame]:
    """Dimension members that extracted rows mention."""
    wallet = F.coalesce(F.col("pm_type"), F.lit("card")) == "wallet"
    return {
        "merchant": extract.select("merchant_id", F.col("merchant_name").alias("name"), F.col("merchant_tier").alias("tier"), F.col("merchant_country_code").alias("country")),
        "customer": extract.select("customer_id"),
        "payment_method": extract.select("pm_id", F.coalesce("pm_type", F.lit("card")).alias("type"), F.col("pm_brand").alias("brand"), wallet.alias("is_digital_wallet")),
    }


KEYS = {"merchant": ("merchant_id", "merchant_key"), "customer": ("customer_id", "customer_key"), "payment_method": ("pm_id", "pm_key")}


def build(extract: DataFrame, only: tuple[str, ...] = tuple(KEYS)) -> dict[str, DataFrame]:
    """Dimensions and facts of a first load: merchant, customer, payment_method, geography, fact. `only` names the numbered dimensions that are wanted."""
    out = {name: insert_missing(None, rows, *KEYS[name]) for name, rows in members(extract).items() if name in only}
    out["geography"] = dim_geography(extract.sparkSession)
    out["fact"] = resolve_keys(derive_facts(extract), out)
    return out


FACTS = "fact_transactions"


def load(store: Snapshots, extract: DataFrame, by: str = "date_key") -> dict[str, int]:
    """Add extracted rows to the stored star: rows added by table. A replay adds none.

    New members and facts show in one version. Surrogate keys are reserved
    through marks of that version, so of two loads at once the second is
    computed again and no key is given twice. Facts are appended, partitioned
    by date_key or month_key; only the partitions of the extract's days are
    read to find facts that are there already.
    """
    spark, added = store.spark, {}
    extract = written(extract, "extract")
    days = sorted(r[0] for r in extract.select(date_key("created_at")).distinct().collect())

    def step(base: int) -> int:
        dims, tables, changes, marks = {"geography": dim_geography(spark)}, {}, {}, {}
        for name, rows in members(extract).items():
            (natural, surrogate), table = KEYS[name], f"dim_{name}"
            once, old = distinct_members(rows, natural), None
            if table in store.names(base):
                once = written(once, f"members-{name}")
                old = store.rows_of(table, once, base)
            top = store.mark(f"{table}-top", base) or 0
            missing = once if old is None else once.join(old.select(natural), natural, "left_anti")
            new, added[name] = numbered(missing, natural, surrogate, top)
            dims[name] = new if old is None else old.unionByName(new)
            if old is None:
                tables[table] = new
            elif added[name]:
                changes[table] = new
            if added[name]:
                marks[f"{table}-top"] = top + added[name]
        facts = resolve_keys(derive_facts(extract), dims)
        facts = facts.groupBy("txn_id").agg(F.min(F.struct(*(c for c in facts.columns if c != "txn_id"))).alias("_f")).select("txn_id", "_f.*")  # of repeated rows, the least
        facts = facts.withColumn("month_key", F.expr("date_key div 100").cast("int"))
        there = store.current(FACTS, base)
        if there is not None and days:
            facts = facts.join(of_days(there, days).select("date_key", "txn_id"), ["date_key", "txn_id"], "left_anti").select(*facts.columns)
        number = store.commit(tables, base, changes, {t: KEYS[t.removeprefix("dim_")][0] for t in tables}, marks, appends={FACTS: (facts.sortWithinPartitions("date_key", "merchant_key"), by)})
        new = store.loads_since(FACTS, number - 1, number)
        added["fact"] = new.count() if new is not None else 0  # from the new files' footers
        return number

    store.retry(step)
    return added


def of_days(facts: DataFrame, days: list[int]) -> DataFrame:
    """Facts of some days, given as keys: literal, so that partitions are pruned when the query is planned."""
    months = sorted({d // 100 for d in days})
    return facts.filter(F.col("month_key").isin(*months) & F.col("date_key").isin(*days))


def between_days(facts: DataFrame, first: int, last: int) -> DataFrame:
    """Facts from one day key to another; see of_days()."""
    return facts.filter(F.col("month_key").between(first // 100, last // 100) & F.col("date_key").between(first, last))


def load_day(spark: SparkSession, extract: DataFrame, warehouse: str, dry_run: bool = False) -> dict[str, int]:
    """Add a day's extracted rows to the star under `warehouse`; see load(). dry_run only counts."""
    if dry_run:
        return {"fact": extract.count()}
    with scratch(spark):
        return load(Snapshots(spark, f"{warehouse}/star"), extract)


def unmatched(facts: DataFrame) -> DataFrame:
    """Facts by surrogate key that is null: what inner joins would drop."""
    return facts.agg(*(F.count_if(F.col(k).isNull()).alias(f"no_{k}") for k in ("merchant_key", "customer_key", "pm_key", "geo_key")))
