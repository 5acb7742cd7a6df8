"""Operator 11 against plain versions: fingerprints, the code, links, components."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.common import table

from .brute import lower, words
from .test_operators import EMPTY, corpus, frame, got
from .test_pipeline import SF, needs_data


def plain_fingerprint(text, n=3):
    own = words(lower(text or ""))
    grams = [" ".join(own[i : i + n]) for i in range(max(1, len(own) - n + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint, least id reachable) by comparing all rows."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)], key=repr)


def test_code_words_are_perfect():
    """Every word is within radius of exactly one code word, its home."""
    rng = np.random.default_rng(2)
    codes = [m << 11 for m in range(1 << simhash.DIMENSION)]
    codes = np.array(codes) ^ simhash._remainder(np.array(codes))
    assert not simhash._remainder(codes).any()
    for w in rng.integers(0, 1 << simhash.LENGTH, 200):
        near = codes[np.bitwise_count(codes ^ w) <= simhash.RADIUS]
        assert len(near) == 1
        assert int(simhash.homes(np.array([w], np.uint64))[0]) >> simhash.DIMENSION == int(near[0]) >> 11


def test_visits_are_all_anchors_within_radius_and_threshold():
    rng = np.random.default_rng(3)
    codes = np.arange(1 << simhash.DIMENSION) << 11
    codes ^= simhash._remainder(codes)
    for f in rng.integers(0, 2**64, 20, dtype=np.uint64):
        a, b = (int(f) >> s & ((1 << 23) - 1) for s in (0, 23))
        excess = [np.maximum(np.bitwise_count(codes ^ w).astype(int) - 3, 0) for w in (a, b)]
        want = {(int(codes[i]) >> 11) << 12 | int(codes[j]) >> 11 for i in np.flatnonzero(excess[0] <= 3) for j in np.flatnonzero(excess[1] <= 3 - excess[0][i])}
        row, found = simhash.visits(np.array([f]))
        assert not row.any() and len(found) == len(want) and set(found.tolist()) == want


@pytest.mark.parametrize("block", [2_000, 8])
def test_links_join_what_is_near(spark, monkeypatch, block):
    """Clusters around some fingerprints and chains of steps of three bits; with
    a small block most anchors are hot."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
        for _ in range(60):
            centre ^= sum(1 << b for b in rng.sample(range(64), 3))
            fps.add(centre)
    fps = np.array(sorted(fps), np.uint64)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CELL", 500)
    monkeypatch.setattr(simhash, "PAIRS", 1_000)
    df = spark.createDataFrame([(int(x), int(h)) for x, h in zip(fps.view(np.int64), simhash.homes(fps), strict=True)], "fp bigint, home int")
    links = [tuple(r) for r in simhash.links(df).select("a", "b").collect()]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    x, y = np.nonzero(np.triu(near, 1))
    assert len(x) > 500
    want = dict(zip(*(z.tolist() for z in simhash.forest(fps[x], fps[y])), strict=True))
    ends = np.array(links, np.int64).reshape(-1, 2).view(np.uint64)
    assert dict(zip(*(z.tolist() for z in simhash.forest(ends[:, 0], ends[:, 1])), strict=True)) == want
    assert len(links) < 20 * len(fps)


def test_documents(spark):
    rows = corpus(31, 60) + [(7, "another text of the same id"), (None, "One"), (None, "nobody is near this text"), (None, None)]
    base = [f"g{i}" for i in range(400)]
    for d in range(100, 140):
        own = list(base)
        for _ in range(d % 4):
            own[random.Random(d).randrange(400)] = f"h{d}"
        rows.append((d, " ".join(own)))
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("fp", "home", "component", "rep", "a", "b")})
    assert got(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == plain_components(rows)
    assert simhash.near_duplicates(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 70_000])
def test_fingerprint(n):
    text = " ".join(f"W{i * i % 977}" for i in range(n)) + "\té\x0b"
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@needs_data
def test_query_over_a_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert got(simhash.op11_anchor_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == plain_components([tuple(r) for r in docs])
