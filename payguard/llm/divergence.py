"""Source divergence audit: how far each source's term use lies from the other sources of its language and from the language.

Strings are materialised late. Counting shuffles 64-bit digests of terms only.
For the digests that enough documents hold, the least and the greatest string
are found; where these differ, two terms share a digest, and the terms of such
a digest are counted again by their strings. Kept terms then have a place in
UTF-8 order, a number that stands for them in joins and ties; the text is
joined back to the rows that are returned.

A pair of sources differs from its smoothed floor only at terms that one of
them has. Terms of one source alone are summed by their count; terms of both
are met term by term, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payguard.llm import words as W
from payguard.llm.common import bitmap_of, bound_batches, in_bitmap, materialize, text_buffer, text_slices

#: Documents of a language that a kept term is in, at least, and ranks of terms that are returned.
MIN_DOCS, RANKS = 3, 200
#: Probabilities are whole numbers of this part.
UNIT = 1_000_000_000
#: Bytes of text, and pairs of one term's sources, that a task holds at a time.
SLICE, PAIRS = 2 << 20, 1 << 20
#: A group's terms are ranked in so many parts first, so that no task ranks all of them.
RANK_PARTS = 32
_GAPS = np.ones(256, np.bool_)
_GAPS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _terms(batch: pa.RecordBatch, bits: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a batch as bytes, their digests, and the term number and row of each occurrence."""
    buffer, offsets = text_buffer(batch["text"])
    starts, ends, rows = W.split(buffer, offsets, _GAPS)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = W._LOWER[buffer[~_GAPS[buffer]]]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(letters)]).dictionary_encode()
    data, at = text_buffer(found.dictionary)
    digests = W.hashes(data, at[:-1], at[1:]) & np.uint64((1 << bits) - 1)
    return found.dictionary, digests.view(np.int64), found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def _counted(batch: pa.RecordBatch, bits: int) -> tuple[pa.Array, np.ndarray, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """Terms and digests of a batch; its groups, and for each (group, term) the term's number, occurrences and documents, in order of groups."""
    terms, digests, ids, rows = _terms(batch, bits)
    langs, sources = (batch[c].dictionary_encode() for c in ("lang", "source"))
    codes = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
    width = max(1, len(terms))
    in_row, n = np.unique(rows * width + ids, return_counts=True)
    key, inverse, docs = np.unique(codes[in_row // width] * width + in_row % width, return_inverse=True, return_counts=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, n)
    known, first = np.unique(codes, return_index=True)
    group = pa.array(first[np.searchsorted(known, key // width)])
    columns = pa.RecordBatch.from_arrays([batch["lang"].take(group), batch["source"].take(group)], ["lang", "source"])
    return terms, digests, columns, key % width, total, docs


def _mapped(rows: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            yield step(batch)

    return rows.mapInArrow(run, schema)


def _digest_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, n, docs), strings of terms left out."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, digests, groups, ids, n, docs = _counted(batch, bits)
        return pa.RecordBatch.from_arrays([*groups.columns, pa.array(digests[ids]), pa.array(n), pa.array(docs)], ["lang", "source", "digest", "n", "docs"])

    found = _mapped(rows, step, "lang string, source string, digest bigint, n bigint, docs bigint")
    return found.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _string_counts(rows: DataFrame, collided: DataFrame, bits: int) -> DataFrame:
    """(lang, source, term, n, docs) of the terms whose digest is among the collided ones."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap_of(collided, "digest"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, digests, groups, ids, n, docs = _counted(batch, bits)
        keep = in_bitmap(sent.value, digests[ids])
        mask, ids = pa.array(keep), ids[keep]
        return pa.RecordBatch.from_arrays([*(c.filter(mask) for c in groups.columns), pa.array(digests[ids]), terms.take(pa.array(ids)).cast(pa.string()), pa.array(n[keep]), pa.array(docs[keep])], ["lang", "source", "digest", "term", "n", "docs"])

    found = _mapped(rows, step, "lang string, source string, digest bigint, term string, n bigint, docs bigint")
    found = found.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.join(collided, "digest", "left_semi").drop("digest")


def _strings(rows: DataFrame, kept: DataFrame, bits: int) -> DataFrame:
    """(digest, low, high): the least and greatest string of each kept digest. A bitmap of them leaves most others out before the shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap_of(kept, "digest"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, digests, _, _ = _terms(batch, bits)
        keep = pa.array(in_bitmap(sent.value, digests))
        return pa.RecordBatch.from_arrays([pa.array(digests).filter(keep), terms.filter(keep).cast(pa.string())], ["digest", "term"])

    found = _mapped(rows, step, "digest bigint, term string").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    return found.join(kept, "digest", "left_semi")


def _kept(counts: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Counts of the keys in at least min_docs documents of their language, with the language's occurrences. A key has a row for each source."""
    of_lang = Window.partitionBy("lang", key)
    counts = counts.withColumns({"n_lang": F.sum("n").over(of_lang), "docs_lang": F.sum("docs").over(of_lang)})
    return counts.filter(F.col("docs_lang") >= min_docs).select("lang", "source", key, "n", "n_lang")


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Kept terms (term, place), and their counts (lang, source, place, n, n_lang), both written.

    bits: width of the digests; fewer make collisions, which are split all the same.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    by_digest = materialize(_kept(_digest_counts(rows, bits), "digest", min_docs), "divergence-digests")
    kept = materialize(by_digest.select("digest").distinct(), "divergence-kept")
    strings = materialize(_strings(rows, kept, bits), "divergence-strings")
    single = strings.filter("low = high").select(F.col("low").alias("term"), "digest")
    collided = strings.filter("low <> high").select("digest")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def placed(terms: DataFrame) -> DataFrame:
        """Numbers in UTF-8 order of the terms, with gaps."""
        dealt = terms.repartitionByRange(parts, "term").sortWithinPartitions("term")
        return materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "divergence-terms")

    if collided.isEmpty():
        terms = placed(single)
        counts = by_digest.join(terms, "digest")
    else:
        by_string = materialize(_kept(_string_counts(rows, collided, bits), "term", min_docs), "divergence-split")
        terms = placed(single.unionByName(by_string.select("term", F.lit(None).cast("bigint").alias("digest")).distinct()))
        counts = by_digest.join(terms, "digest").drop("digest").unionByName(by_string.join(terms.filter("digest IS NULL"), "term").drop("digest"))
    return terms.select("term", "place"), materialize(counts.select("lang", "source", "place", "n", "n_lang"), "divergence-counts")


def _p(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)), as 38-digit decimals; null without terms."""
    return F.expr(f"CASE WHEN v > 0 THEN 1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(19,0)) div CAST({total} + v AS DECIMAL(20,0))) END")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Each (lang, source) with its number in UTF-8 order, occurrences (total), the language's (total_lang), kept terms (v) and p of a term that it lacks (p0)."""
    spark = docs.sparkSession
    of_lang = counts.select("lang", "place", "n_lang").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    joined = names.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["v", "total", "total_lang"])
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = joined.withColumn("p0", _p("0", "total")).repartitionByRange(parts, "lang", "source").sortWithinPartitions("lang", "source")
    return materialize(dealt.withColumn("gid", F.monotonically_increasing_id()), "divergence-groups")


def _met(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Sums over the terms that two groups share, of what their value differs from the sum of both alone. Whole terms, sorted."""
    gid, p, p0 = (batch[c].to_numpy() for c in ("gid", "p", "p0"))
    lang = batch["lang"].dictionary_encode().indices.to_numpy()
    place = batch["place"].to_numpy()
    new = np.ones(len(gid), np.bool_)
    new[1:] = (place[1:] != place[:-1]) | (lang[1:] != lang[:-1])
    term = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(gid)))[term]
    ends = np.cumsum(size)
    at = 0
    while at < len(gid):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = size[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[term[a]]
        apart = gid[a] != gid[b]
        a, b = a[apart], b[apart]

        def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (x - y) * (x - y) // y

        value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
        ids, code = np.unique(gid, return_inverse=True)
        key, inverse = np.unique(code[a] * len(ids) + code[b], return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, inverse, value)
        yield pa.RecordBatch.from_arrays([pa.array(ids[key // len(ids)]), pa.array(ids[key % len(ids)]), pa.array(sums)], ["a", "b", "value"])
        at = stop


def _shared(rows: DataFrame) -> DataFrame:
    """_met() over all terms: (a, b, value), several rows a pair. Terms are dealt by their hash, so a large language spreads over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < PAIRS // 16:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = whole.num_rows - 1
            while last and whole["place"][last - 1] == whole["place"][last] and whole["lang"][last - 1] == whole["lang"][last]:
                last -= 1
            if last:
                yield from _met(whole.slice(0, last))
            held = [whole.slice(last)]
        if held and (rest := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield from _met(rest.to_batches()[0])

    dealt = rows.select("lang", "place", "gid", "p", "p0").repartition("lang", "place").sortWithinPartitions("lang", "place")
    return dealt.mapInArrow(run, "a bigint, b bigint, value bigint")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, bits: int = 64) -> DataFrame:
    """Divergences of all sources: lang, source, part, item, value, rank.

    Part `pair`: value of each other source of the language, over all kept
    terms. Part `term`: the terms that a source has more of than its language,
    up to `ranks`. A null text, lang or source is ''; each row is a document
    of its own, so repeated rows count each; groups without a kept term have
    pairs of value 0 and no terms; an empty table gives an empty result. Other
    columns are not read.
    """
    terms, counts = term_counts(docs, min_docs, bits)
    groups = _groups(docs, counts)
    rows = counts.join(groups, ["lang", "source"]).withColumns({"p": _p("n", "total"), "q": _p("n_lang", "total_lang")})
    exact = "decimal(38,0)"

    over = rows.filter("p > q").select("gid", "lang", "source", "place", F.expr(_f("p", "q")).alias("value"))
    for part in ([F.pmod(F.xxhash64("place"), F.lit(RANK_PARTS))], []):
        order = Window.partitionBy("gid", *part).orderBy(F.desc("value"), "place")
        over = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    of_terms = over.join(terms, "place").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    a = groups.select("lang", "source", F.col("gid").alias("a"), F.col("p0").alias("pa"), "v")
    b = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("p0").alias("pb"))
    pairs = materialize(a.join(b, "lang").filter("a <> b"), "divergence-pairs")
    bins = materialize(rows.groupBy("gid", "p").agg(F.count(F.lit(1)).alias("m")), "divergence-bins")

    def alone(side: str, value: str) -> DataFrame:
        """Sum over one side's terms of what they add to the floor, as if the other had none of them."""
        return pairs.join(bins.withColumnRenamed("gid", side), side).select("a", "b", (F.col("m").cast(exact) * F.expr(f"{value} - {_f('pa', 'pb')}")).alias("value"))

    sums = alone("a", _f("p", "pb")).unionAll(alone("b", _f("pa", "p"))).unionAll(_shared(rows)).groupBy("a", "b").agg(F.sum(F.col("value").cast(exact)).alias("more"))
    floor = F.coalesce(F.col("v").cast(exact) * F.expr(_f("pa", "pb")), F.lit(0))
    whole = pairs.join(sums, ["a", "b"], "left").withColumn("value", (floor + F.coalesce("more", F.lit(0))).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "item"))
    of_pairs = whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return of_pairs.unionByName(of_terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, id, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT c.lang, c.source, c.term, sum(c.n)::BIGINT AS n FROM c JOIN kept ON c.lang = kept.lang AND c.term = kept.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
gn AS (SELECT lang, source, sum(n)::BIGINT AS n FROM gc GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(gc.n, 0) AS n, 1 + ({UNIT} * (coalesce(gc.n, 0) + 1)) // (coalesce(gn.n, 0) + v.v) AS p, 1 + ({UNIT} * (k.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= {RANKS}
"""
