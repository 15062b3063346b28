"""Change events: streaming and batch sources, decoding, dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard import schemas

RAW = "value string, topic string, partition int, offset bigint, timestamp timestamp"
RAW_LIMIT = 500


@dataclass(frozen=True)
class ChangeSource:
    """Where change messages come from: a folder of JSON files with the RAW fields, or a broker's topic.

    start is `earliest` or `latest`; it holds for topics, and for a first start only.
    """

    path: str | None = None
    topic: str | None = None
    servers: str | None = None
    start: str = "earliest"
    max_files: int | None = None


def topic_options(source: ChangeSource) -> dict[str, str]:
    """Options of Spark's Kafka source."""
    return {"kafka.bootstrap.servers": source.servers, "subscribe": source.topic, "startingOffsets": source.start}


def read_changes(spark: SparkSession, source: ChangeSource, streaming: bool = True) -> DataFrame:
    """Messages with the RAW fields. The topic source needs Spark's Kafka package."""
    reader = spark.readStream if streaming else spark.read
    if source.topic:
        found = reader.format("kafka").options(**topic_options(source)).load()
        return found.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")
    reader = reader.schema(RAW)
    if streaming and source.max_files:
        reader = reader.option("maxFilesPerTrigger", source.max_files)
    return reader.json(source.path)


def parse(messages: DataFrame, schema: T.StructType = schemas.CHANGE_ROW, keep_deleted: bool = False) -> DataFrame:
    """Messages with what they say: row (a struct), instant (its created_at, or else the message's time), error (null for one that can be read) and kept (whether decode() gives its row).

    Each message is parsed once, and its row is built once: both come out of
    generators, into which no filter or later expression is pushed, as they
    would parse it again or make code too long to be compiled. Its keys are
    looked for only where the parsed envelope does not tell, or where the text
    may hold NaN or an infinity, which from_json takes and JSON does not know.
    """
    envelope = T.StructType([T.StructField("payload", T.StructType([T.StructField("after", schema)])), T.StructField("after", schema), *schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    value, m, keys = F.col("value"), F.col("_m"), F.col("_keys")

    parsed = messages.select(*messages.columns, F.explode_outer(F.array(F.from_json(value, envelope, options))).alias("_m"))
    odd = value.contains("NaN") | value.contains("INF") | value.contains("Infinity")
    told = F.coalesce((m["payload"].isNotNull() | m["after"].isNotNull()) & ~odd, F.lit(False))
    parsed = parsed.withColumn("_keys", F.when(told, F.array(F.lit("after"))).otherwise(F.json_object_keys(value)))
    enveloped = F.coalesce(F.array_contains(keys, "payload") | F.array_contains(keys, "after"), F.lit(False))
    flat = F.struct(*(m[f.name].alias(f.name) for f in schema.fields))
    row = F.when(enveloped, F.coalesce(m["payload"]["after"], m["after"])).otherwise(flat)
    found = F.struct(row.alias("row"), (m["_corrupt"].isNotNull() | keys.isNull()).alias("broken"))
    parsed = parsed.select(*messages.columns, F.explode_outer(F.array(found)).alias("_found")).select(*messages.columns, "_found.*")

    has_time = "created_at" in schema.fieldNames()
    time = F.col("row.created_at").try_cast("timestamp") if has_time else F.lit(None).cast("timestamp")
    bad_time = (F.col("row.created_at").isNotNull() & time.isNull()) if has_time else F.lit(False)
    error = F.when(value.isNull(), "null value").when(F.col("broken"), "not a JSON object of the expected types").when(bad_time, "created_at cannot be read")
    parsed = parsed.select(*messages.columns, "row", F.coalesce(time, F.col("timestamp")).alias("instant"), error.alias("error"))
    kept = F.col("error").isNull() & F.col("row").isNotNull()
    if "__deleted" in schema.fieldNames() and not keep_deleted:
        kept &= F.coalesce(F.col("row.__deleted"), F.lit("false")) != "true"
    return parsed.withColumn("kept", kept)


def decode(messages: DataFrame, schema: T.StructType = schemas.CHANGE_ROW, keep_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of the change messages, and dead letters.

    A message is the row itself or an envelope {payload: {after}} or {after}.
    Rows of deleted records are left out (with keep_deleted they stay, and
    __deleted tells), as are envelopes without an after image. A null value, text that is no JSON object, and a created_at or
    amount that cannot be read give a dead letter: error, raw_value (500
    characters at most), topic, partition, offset, timestamp. Each result
    parses the messages; see parse() for both in one pass.
    """
    parsed = parse(messages, schema, keep_deleted)
    dead = parsed.filter("error IS NOT NULL").select("error", F.substring("value", 1, RAW_LIMIT).alias("raw_value"), "topic", "partition", "offset", "timestamp")
    good = parsed.filter("kept").select("row.*", "instant", "offset")
    if "created_at" in schema.fieldNames():
        good = good.drop("created_at").withColumnRenamed("instant", "created_at")
    if "__deleted" in schema.fieldNames() and not keep_deleted:
        good = good.drop("__deleted")
    return good, dead


def unscored(rows: DataFrame) -> DataFrame:
    """Without the echo of our own write-back: rows that have a score already, and rows without a customer."""
    return rows.filter("fraud_score IS NULL AND customer_id IS NOT NULL").drop("fraud_score")
