"""Word splitting, hashing and windows against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from payguard.llm import words as W
from payguard.llm.common import text_buffer, text_slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té\x85\xa0", max_size=40)), min_size=1, max_size=6)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    buffer, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows = W.split(buffer, offsets)
    expected = [(t or "").encode().split() for t in texts]
    data = buffer.tobytes()
    assert [[data[a:b] for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)] for lo, hi in zip(rows[:-1], rows[1:], strict=True)] == expected
    row, _ = W.shingles(buffer, offsets)
    lower = bytes(W._LOWER)
    sets = [{tuple(x.translate(lower) for x in w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in expected]
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(s) for s in sets]


def test_equal_words_have_equal_hashes_across_segments():
    text = " ".join(["x" * 70_000, "word", "y" * 10, "word"])
    buffer, offsets = text_buffer(pa.array([text]))
    starts, ends, _ = W.split(buffer, offsets)
    h = W.hashes(buffer, starts, ends)
    assert h[1] == h[3] and len(set(h.tolist())) == 3


def test_rolling_and_sliding_min():
    h = np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64)
    for n in (1, 2, 5, 8, 50, 60, 61):
        got = W.rolling(h, n)
        assert len(got) == max(0, 61 - n)
        assert all(got[i] == W.rolling(h[i : i + n].copy(), n)[0] for i in range(len(got)))
    for w in (1, 3, 43):
        assert W.sliding_min(h, w).tolist() == [h[i : i + w].min() for i in range(60 - w + 1)]


def test_slices_respect_the_limit_and_sliced_columns():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, "", "c"])], ["text"]).slice(1)
    got = list(text_slices(iter([batch]), limit=12))
    assert [b.num_rows for b in got] == [1, 1, 2] or sum(b.num_rows for b in got) == 4
    assert text_buffer(got[-1]["text"])[0].tobytes().endswith(b"c")
