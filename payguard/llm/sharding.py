"""K-d tree partitioning of rows into shards of equal bytes, in DataFrame operations alone.

At each level every node is split at the weighted median of its widest
metadata dimension. The median is exact: rows are dealt by range on (node,
value), so that a node of any size, and any number of equal values, spreads
over many tasks, and running weights come from the tasks' totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm.common import Rounds, as_row, free_name, materialize, prefix_sums


def kd_tree(rows: DataFrame, dims: list[str], weight: str, target: int, ties: list[str], name: str = "leaf") -> DataFrame:
    """Add `name`, a leaf (0 to 2**levels - 1), to rows; leaves weigh `target` at most, up to one row.

    dims are numeric columns (null counts as 0); their widths are compared in
    units of the whole table's range. weight is a positive bigint column. The
    order along a dimension continues with `ties`, so rows that agree in all
    of those stay on one side unless the median falls among them. Repeated
    rows are placed one by one. An empty table stays empty. All columns stay,
    whatever their names; `name` gets underscores where rows has it already.
    """
    name, n = free_name(rows, name), len(dims)
    point = F.array(*(F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in dims))
    now = rows.select(as_row(rows), point.alias("point"), F.col(weight).alias("weight"), F.struct(*ties).alias("tie"), F.lit(0).alias("node"))
    span = [F.max(F.col("point")[i]) - F.min(F.col("point")[i]) for i in range(n)]
    whole = now.agg(F.sum("weight").alias("total"), *(x.alias(f"w{i}") for i, x in enumerate(span))).first()
    if not whole["total"]:
        return rows.withColumn(name, F.lit(0))
    levels = max(0, math.ceil(math.log2(whole["total"] / target) - 1e-9))
    units = [whole[f"w{i}"] or 1.0 for i in range(n)]
    columns, rounds = now.columns, Rounds(rows.sparkSession, "kd")
    for level in range(levels):
        if level == 0:  # one node, whose numbers are known
            widths = [whole[f"w{i}"] / u for i, u in enumerate(units)]
            keyed = now.withColumns({"total": F.lit(whole["total"]), "key": F.col("point")[widths.index(max(widths))]})
        else:
            stats = now.groupBy("node").agg(F.sum("weight").alias("total"), F.array(*(x / F.lit(u) for x, u in zip(span, units, strict=True))).alias("width"))
            stats = stats.select("node", "total", F.array_position("width", F.array_max("width")).cast("int").alias("axis"))
            keyed = now.join(stats, "node").withColumn("key", F.element_at("point", F.col("axis")))
        ranked, _ = prefix_sums(keyed, ["node"], ["key", "tie"], {"before": F.col("weight")}, "kd", rounds)
        right = 2 * F.col("before") + F.col("weight") > F.col("total")
        now = ranked.withColumn("node", 2 * F.col("node") + right.cast("int")).select(*columns)
    return now.select("row.*", F.col("node").alias(name))


def _place(column: str) -> Column:
    """A name's place on a line: its checksum."""
    return F.crc32(F.coalesce(F.col(column), F.lit("")))


def shard_documents(docs: DataFrame, target: int | None = None, shards: int | None = None) -> DataFrame:
    """Shards of `target` bytes (or about `shards` equal ones, a power of two) for (doc_id, text, lang, source) rows; one row each: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Dimensions: log of the size, source, language. size is the text's UTF-8
    bytes (null: none) plus 1. Slots count from 0 within a shard. Null doc_ids
    come first among ties; other columns are left out. Texts are read once:
    sizes, checksums and coordinates are written before the tree is built.
    """
    text = F.coalesce("text", F.lit(""))
    meta = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _place("source").alias("source_at"), _place("lang").alias("lang_at"))
    meta = materialize(meta.withColumn("log_size", F.log2("size")), "shard-rows")
    if target is None:
        target = math.ceil((meta.agg(F.sum("size")).first()[0] or 1) / shards)
    ties = ["text_crc32", "size", "doc_id"]
    leaves = kd_tree(meta, ["log_size", "source_at", "lang_at"], "size", target, ties, "shard")
    placed, _ = prefix_sums(leaves, ["shard"], ties, {"slot": F.lit(1).cast("long")}, "slots")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Shards of the query.
SHARDS = 8


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal bytes."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=SHARDS)


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a time, as DuckDB has no function for it."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(f"{c}::BIGINT")

    def step(c: str) -> str:
        return f"xor({c} >> 4, ([{', '.join(table)}])[({c} & 15) + 1])"

    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step(step('xor(c, b)'))}), 4294967295::BIGINT)"


def _levels_sql(levels: int) -> str:
    """CTEs n1, n2, ... with the nodes of each level of the tree, from n0, which has them all as node 0."""
    span = [f"(max({d}) - min({d})) / any_value(u{i})" for i, d in enumerate(("log_size", "source_at", "lang_at"))]
    out = []
    for k in range(levels):
        out.append(f"""
a{k} AS (SELECT node, sum(size) AS total, list_position([{", ".join(span)}], greatest({", ".join(span)})) AS axis FROM n{k}, u GROUP BY node),
k{k} AS (SELECT n{k}.*, total, CASE axis WHEN 1 THEN log_size WHEN 2 THEN source_at ELSE lang_at END AS key FROM n{k} JOIN a{k} USING (node)),
n{k + 1} AS (
  SELECT doc_id, size, text_crc32, log_size, source_at, lang_at, (2 * node + (2 * sum(size) OVER (PARTITION BY node ORDER BY key, text_crc32, size, doc_id ROWS UNBOUNDED PRECEDING) - size > total)::INT)::INT AS node
  FROM k{k})""")
    return ",".join(out)


#: The tree has log2(SHARDS) levels. grown_shard has the type that pandas gives a column of nulls.
ORACLE = f"""
WITH n0 AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32,
    log2(octet_length(encode(coalesce(text, ''))) + 1)::DOUBLE AS log_size, {_crc32_sql("coalesce(source, '')")}::DOUBLE AS source_at, {_crc32_sql("coalesce(lang, '')")}::DOUBLE AS lang_at, 0 AS node
  FROM documents),
u AS (SELECT coalesce(nullif(max(log_size) - min(log_size), 0), 1) AS u0, coalesce(nullif(max(source_at) - min(source_at), 0), 1) AS u1, coalesce(nullif(max(lang_at) - min(lang_at), 0), 1) AS u2 FROM n0),{_levels_sql(SHARDS.bit_length() - 1)}
SELECT doc_id, size, text_crc32, 'bytes' AS law, node AS shard, row_number() OVER (PARTITION BY node ORDER BY text_crc32, size, doc_id) - 1 AS slot, NULL::DOUBLE AS grown_shard
FROM n{SHARDS.bit_length() - 1}
"""
