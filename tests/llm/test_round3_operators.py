"""Source divergence, WARC archives and vector codes against plain Python, on awkward rows."""

import hashlib
import json
import re
from collections import Counter
from pathlib import Path
from unicodedata import lookup

import numpy as np
import pytest
from pyspark.sql import functions as F

from payguard.llm import divergence, vector_codes, warc
from payguard.llm.common import new_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- op11


def divergence_brute(rows, min_docs=3, ranks=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))) for text, lang, source in rows]
    groups, out = {(a, b) for a, b, _ in docs}, []
    for lang in {a for a, _, _ in docs}:
        mine = [(b, c) for a, b, c in docs if a == lang]
        seen = Counter(t for _, c in mine for t in c)
        kept = sorted((t for t in seen if seen[t] >= min_docs), key=str.encode)
        sources = sorted({b for a, b in groups if a == lang}, key=str.encode)

        def p_of(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        counts = {s: sum((c for b, c in mine if b == s), Counter()) for s in sources}
        p, q = {s: p_of(counts[s]) for s in sources}, p_of(sum((c for _, c in mine), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= ranks]
    return sorted(out)


AWKWARD = [
    ("The cat, the CAT and don't", "en", "a"), ("the cat sat; a cat", "en", "b"), ("cat the dog dog dog", "en", "a"), ("dog the", "en", None), ("dog", "en", ""), (None, "en", "void"), ("", None, "a"), ("", None, "b"),
    ("\x00alpha\x7fbeta{gamma}", "fr", "a"), ("alpha beta gamma Été été " + lookup("SMILING FACE WITH SMILING EYES"), "fr", "a"), ("ALPHA beta Été", "fr", "b\x00c"), ("Été beta", "fr", "b\x00c"),
    ("tie one two", "de", "x"), ("tie one two", "de", "x"), ("tie one two", "de", "x"), ("tie", "de", "y"), ("cat " * 30_000 + "the", "en", "long"), ("x" * 100_000 + " cat", "en", "long"),
]


def as_docs(spark, rows):
    return spark.createDataFrame([(i, *r, i, "q") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, place int, digest string")


@pytest.mark.parametrize("bits", [64, 3])
def test_divergence_equals_brute_force(spark, bits):
    got = divergence.audit(as_docs(spark, AWKWARD), bits=bits).collect()
    assert sorted(tuple(r) for r in got) == divergence_brute(AWKWARD)


def test_divergence_splits_colliding_digests(spark, monkeypatch):
    """With 8 bits of 400 terms nearly all collide; ranks are cut and ties are by UTF-8."""
    rng = np.random.default_rng(1)
    rows = [(" ".join(f"w{chr(97 + x % 26)}{'abcdefghij'[x // 26 % 10]}" for x in rng.zipf(1.3, 60) % 400), lang, f"s{rng.integers(5)}") for lang in ("en", "de") for _ in range(60)]
    want = divergence_brute(rows, ranks=7)
    terms, counts = divergence.term_counts(as_docs(spark, rows), bits=8)
    assert [r.term for r in terms.orderBy("place").collect()] == sorted({r.term for r in terms.collect()}, key=str.encode)
    assert counts.groupBy("lang", "source", "place").count().filter("count > 1").isEmpty()
    assert sorted(tuple(r) for r in divergence.audit(as_docs(spark, rows), ranks=7, bits=8).collect()) == want
    monkeypatch.setattr(divergence, "PAIRS", 16)  # blocks that end inside terms
    assert sorted(tuple(r) for r in divergence.audit(as_docs(spark, rows), ranks=7).collect()) == want


def test_divergence_of_nothing(spark):
    assert divergence.audit(as_docs(spark, AWKWARD).filter("false")).count() == 0
    alone = divergence.audit(as_docs(spark, [("a b c", "en", "s"), ("x", "en", "t")])).collect()
    assert sorted(tuple(r) for r in alone) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_divergence_of_large_counts(spark):
    """(count + 1) * 10^9 passes 64 bits."""
    rows = spark.range(1).select(F.lit(5).alias("v"), F.lit(1 << 40).alias("n"), F.lit(1 << 42).alias("total"))
    assert rows.select(divergence._p("n", "total")).first()[0] == 1 + 10**9 * ((1 << 40) + 1) // ((1 << 42) + 5)


# ---- op12


def as_pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "page_id long, url string, html string, archive int, digest string")


def test_archives_give_back_what_was_written(spark):
    long, same = "<p>" + "lorem ipsum é " * 60_000, "<html>" + "body " * 40
    rows = [(5, "http://a/x y\r\n", same), (3, "http://b/é", same), (9, None, same), (4, "u", "short"), (6, "u", "short"), (-7, "neg", None), (8, "e", ""), (1 << 62, "big", long), (-(1 << 63), "least", long), (None, "no id", same), (None, "no id", same)]
    rows += [(100 + i, f"http://c/{i}", f"<div class='item'>{i} " + "common boilerplate words of a page " * 10 + str(i * i)) for i in range(300)]
    folder = new_path(spark, "warc")
    manifest = warc.archive(as_pages(spark, rows).repartition(3), folder)
    read = warc.read_archives(manifest, folder, with_payload=True).collect()
    assert len(read) == len(rows) == manifest.count()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h or "")
        revisit = i is not None and len(data) >= 100 and i > first
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in read) == want
    urls = {r.page_id: r.url for r in read}
    assert urls[5] == "http://a/x%20y%0D%0A" and urls[3] == "http://b/%C3%A9" and urls[9] == warc.record_id(9)
    for r in manifest.filter("page_id = 3 OR page_id = 5").collect():
        fields, http, payload = warc.read_record(folder, r.archive, r.offset, r.length)
        assert warc.page_of(fields["warc-record-id"]) == r.page_id and fields["warc-payload-digest"].endswith(hashlib.sha256(same.encode()).hexdigest())
        assert int(http["content-length"]) == len(same) and payload == (same.encode() if r.page_id == 3 else b"")


def test_archives_begin_with_their_dictionary(spark):
    import zstandard

    common = " ".join(f"<li class='{chr(97 + i % 26)}{i * 7919 % 997}'>entry</li>" for i in range(40))
    rows = [(i, f"http://c/{i}", f"<div>{i * 7919}{common}{i * i}</div>") for i in range(500)]
    folder = new_path(spark, "warc")
    manifest = warc.archive(as_pages(spark, rows).repartition(2), folder)
    files = sorted({r.archive for r in manifest.collect()})
    with_dictionary = 0
    for name in files:
        data = (Path(folder.removeprefix("file:")) / name).read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        assert d.dict_id() and zstandard.get_frame_parameters(data[8 + size :]).dict_id == d.dict_id()
        with_dictionary += len(data)
    one_by_one = sum(len(zstandard.compress(warc.encode_record(i, u, h.encode(), hashlib.sha256(h.encode()).hexdigest(), len(h), None, "1970-01-01T00:00:00Z"), warc.LEVEL)) for i, u, h in rows)
    assert with_dictionary < 0.7 * one_by_one


def test_archives_of_few_or_no_pages(spark):
    folder = new_path(spark, "warc")
    none = warc.archive(as_pages(spark, [(1, "u", "x")]).filter("false"), folder)
    assert none.count() == 0 and warc.read_archives(none, folder).count() == 0
    one = warc.archive(as_pages(spark, [(1, "u", "x")]), folder)
    assert [tuple(r) for r in warc.read_archives(one, folder).collect()] == [(1, "u", "response", 1, hashlib.sha256(b"x").hexdigest(), None)]


def test_records_tell_damage():
    record = warc.encode_record(1, "u", b"payload", "00", 7, None, "1970-01-01T00:00:00Z")
    assert warc.decode_record(record)[2] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(record[:-1])
    for i in (0, 1, -1, (1 << 63) - 1, -(1 << 63)):
        assert warc.page_of(warc.record_id(i)) == i
    assert warc.page_of(warc.record_id(None, 5)) is None


# ---- op13


def codes_brute(rows):
    kept = [(i, lab, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // 4
    parts = [[r[2][k * width : (k + 1) * width] for r in kept] for k in range(4)]
    books = [[list(x) for x in p[:256]] for p in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(4):
        for k in range(4):
            mine = {}
            for x in parts[k]:
                mine.setdefault(nearest(x, books[k])[1], []).append(x)
            for e, xs in mine.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    best = [[nearest(x, books[k]) for x in parts[k]] for k in range(4)]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    errors = [sum(best[k][j][0] for k in range(4)) for j in range(len(kept))]
    by_label = Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    return [(i, "".join(f"{best[k][j][1]:02x}" for k in range(4)), errors[j], by_label[lab], digest) for j, (i, lab, _) in enumerate(kept)]


def as_vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, lab, "c", 0) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code string, row int")


def key_of(rows):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in map(tuple, rows))


def test_vector_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAVES", 7)
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=(330, 8)) * 4) / 64  # many equal parts and prefixes
    rows = [(int(i), [float(x) for x in v], int(i) % 4 if i % 4 else None) for i, v in zip(rng.permutation(330) - 20, values, strict=True)]
    rows += [(1000, None, 1), (1001, [0.0] * 7 + [None], 1), (1002, [float("nan")] * 8, 2), (1003, [float("inf")] + [0.0] * 7, None), (5, rows[0][1], 3), (None, rows[1][1], None)]
    got = vector_codes.compress(as_vectors(spark, rows)).collect()
    assert key_of(got) == key_of(codes_brute(rows))


def test_vector_codes_of_large_components(spark):
    """Squares that pass 32 and 64 bits."""
    for scale in (3.0, 4000.0, 3e9):
        rows = [(i, [scale * ((i * 37 + d * 11) % 23 - 11) for d in range(4)], i % 2) for i in range(270)]
        assert key_of(vector_codes.compress(as_vectors(spark, rows, "double")).collect()) == key_of(codes_brute(rows))


def test_vector_codes_of_few_rows_and_odd_lengths(spark):
    assert vector_codes.compress(as_vectors(spark, [(1, [1.0] * 4, 1)]).filter("false")).collect() == []
    odd = vector_codes.compress(as_vectors(spark, [(2, [1.0] * 5, 1), (3, [2.0] * 4, 1), (1, [0.5] * 5, None)])).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in odd) == [(1, "00000000", 0, 0), (2, "01010100", 0, 0)]
    empty = vector_codes.compress(as_vectors(spark, [(1, [], 1)])).collect()
    assert empty == []
    assert json.loads("[]") == empty


def test_trie_shares_prefixes_between_blocks():
    leaves = np.array(sorted({(a, b, c) for a in range(3) for b in range(4) for c in range(5)}), np.int64)
    book = np.array([[0, 0, 0], [2, 3, 4], [1, 1, 1]], np.int64)
    whole = vector_codes.Trie(book).visit(leaves)
    trie = vector_codes.Trie(book)
    pieces = [trie.visit(leaves[i : i + 7]) for i in range(0, len(leaves), 7)]
    want = ((leaves[:, None, :] - book[None]) ** 2).sum(axis=2)
    for got in (whole, tuple(np.concatenate(x) for x in zip(*pieces, strict=True))):
        assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()
