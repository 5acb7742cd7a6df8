"""Word hashing, slices and parts against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import common, neardup, substrings

TEXT = st.text(alphabet="aAbé \n\t\x0b\x0c\r\x1c\x85.ß漢", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_words_have_equal_hashes_exactly_if_equal(texts):
    raw = [t.encode() for t in texts]
    for lower in (False, True):
        hashes, counts = common.hashed_words(raw, lower)
        own = [(t.lower() if lower else t).split() for t in raw]
        assert counts.tolist() == [len(w) for w in own]
        flat = [w for ws in own for w in ws]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
        heads = common.hashed_words(raw, lower, prefix=2)[0].tolist()
        assert len(set(zip([w[:2] for w in flat], heads, strict=True))) == len({w[:2] for w in flat}) == len(set(heads))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 5))
def test_ngrams_stay_within_texts(texts, n):
    hashes, counts = common.hashed_words([t.encode() for t in texts])
    ok = common.inside(counts, n)
    assert int(ok.sum()) == sum(max(0, c - n + 1) for c in counts.tolist())
    assert len(common.ngrams(hashes, n)) == len(ok)


@given(st.lists(st.binary(max_size=30), max_size=20), st.integers(1, 50))
def test_slices_cover_all(texts, limit):
    spans = list(common.slices(texts, limit))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(texts)))
    assert all(b - a == 1 or sum(len(t) + 1 for t in texts[a:b]) <= limit + 1 for a, b in spans)


@given(st.lists(st.none() | st.text(max_size=9), max_size=20), st.integers(1, 30))
def test_parts_keep_rows_in_order(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["i", "t"])
    parts = list(common.in_parts([batch, batch.slice(0, 0)], 1, limit))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90))
def test_equal_windows_have_equal_anchors(values):
    text = " ".join(f"w{v}" for v in values).encode()
    hashes, counts = common.hashed_words([text])
    at, fp, place = substrings.anchors(hashes, counts)
    assert len(at) == max(0, len(values) - substrings.WINDOW + 1)
    assert ((place >= at) & (place <= at + substrings.WINDOW - substrings.GRAM)).all()
    assert (np.diff(place) >= 0).all()
    seen = {}
    for i, f in zip(at.tolist(), fp.tolist(), strict=True):
        assert seen.setdefault(tuple(values[i : i + substrings.WINDOW]), f) == f


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.sampled_from([50, 80, 85, 100]))
def test_exact_similarity(a, b, percent):
    if a and b:
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert neardup.jaccard_at_least(x, y, percent) == (100 * len(a & b) >= percent * len(a | b))
