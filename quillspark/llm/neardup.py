"""MinHash near-duplicates by fast similarity sketching (operator 9).

A document's set is its distinct word shingles.  Its sketch has t coordinates
filled in rounds (Dahlgaard, Knudsen, Thorup 2017): in round i < t every element
is hashed to a coordinate and leaves the value (i, hash) there, the least value
wins; in round t + i every element goes to coordinate i.  Rounds end once all
coordinates are full, which takes few rounds of the whole set instead of t, and
each coordinate of two sketches agrees with probability equal to the Jaccard
similarity, with concentration bounds.

Bands of coordinates retrieve candidates; ``band_plan`` sizes them so that a
pair at the threshold is missed with a chance below ``MISS``.  Pairs are looked
for within a band bucket, never within whatever buckets chain together:

1. Documents with equal sets form classes; one member stands for its class.
2. Stars: each representative is compared with the least member of a bucket, the
   one it shares most buckets with.  That is one pair a document; it joins most
   of a large group of near copies.
3. Buckets whose members are still of several components compare the sketches
   of members of different components, above ``BLOCK`` members in a task for
   each pair of blocks.  A pair that shares several buckets counts in the first.
   Each member of a plausible pair is named once a bucket, with the least member
   that plausible pairs lead to there.
4. These members meet by their texts: whole groups that plausible pairs chain
   together, or bucket by bucket where that sends fewer texts (a long chain).
   Above ``BLOCK`` members they are divided into blocks, a large component into
   blocks of its own; only blocks of different components meet.  There sketches
   rule out distant pairs, and pairs not yet connected are confirmed.
5. Components over the confirmed links, joined back to all documents.

A plausible pair's sketches agree in at most ``SKETCH_MARGIN`` standard
deviations less than at the threshold; links are confirmed on the full sets.  No
link between different texts that share a bucket is lost, whatever the bucket's
size.  Stars send one text a document, in tasks of about ``CELL``; what is
compared in squares is a bucket's unconnected members, by sketches of bounded
size, and the plausible ones among them.

Edge cases: null, empty and wordless texts have no shingles, are linked with
nothing and kept; texts shorter than a shingle are one shingle; the rows of one
doc_id count as one document and share its component; a row without doc_id
takes the component of its class and is kept only if that is null too; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, in_parts, join_bounded, map_batches, materialize, mix, ngrams, slices, table, text_bytes
from .components import connected_components

SHINGLE = 5
BANDS = 36
MISS = 1e-6
BLOCK = 1_500  # members of a bucket a task
BLOCK_SHINGLES = 4_000_000
CELL, CELL_SHINGLES = 500, 1_000_000  # texts, and their shingles, a task, of stars and of small units
SKETCH_CELL = 4_000  # sketches of small buckets that share a task
JUMPS = 3  # of the stars' pointers
SKETCH_MARGIN = 5.0  # standard deviations below the threshold that still get confirmed
MAX_BROADCAST_ROWS = 1_000_000
_SEED = np.uint64(0x5851F42D4C957F2D)


def band_plan(threshold: float, bands: int = BANDS, miss: float = MISS) -> int:
    """Rows per band: as many as keep the chance to miss a pair at the threshold
    below ``miss``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def shingles(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = hashed_words(texts, lower=True)
    grams = ngrams(hashes, n)
    out, begin = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(grams[begin : begin + count - n + 1]))
        elif count:
            # A short text is one shingle, told apart by its number of words.
            out.append(mix(ngrams(hashes[begin : begin + count], count) + np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
        begin += count
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """len(sets) x t coordinates; rows of empty sets stay at the largest value."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    open_ = np.flatnonzero(sizes)
    elements = np.concatenate([sets[i] for i in open_]) if len(open_) else np.empty(0, np.uint64)
    owner = np.repeat(open_, sizes[open_])
    low = np.uint64(54)
    for i in range(2 * t):
        if not len(open_):
            break
        h = mix(elements + np.uint64((int(_SEED) * (i + 1)) % 2**64))
        bins = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        # The round stands above the hash, so earlier rounds win.
        value = (np.uint64(i) << low) | (mix(h) >> np.uint64(10))
        np.minimum.at(out, owner * t + bins, value)
        full = (out.reshape(-1, t)[open_] != np.iinfo(np.uint64).max).all(axis=1)
        open_ = open_[~full]
        if full.any():
            stay = np.isin(owner, open_)
            elements, owner = elements[stay], owner[stay]
    return out.reshape(-1, t)


def _bands(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sk[:, : bands * rows].reshape(len(sk), bands, rows)
    out = np.zeros((len(sk), bands), np.uint64)
    for j in range(rows):
        out = mix(out + parts[:, :, j] * np.uint64(2 * j + 3))
    return mix(out + np.arange(bands, dtype=np.uint64)[None, :] * _SEED)


def sketched(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the set, its band hashes, and its
    sketch at one byte a coordinate: agreement by chance only adds candidates."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            texts = text_bytes(batch.column(1))
            size, one, two, hashes, small = [], [], [], [], []
            for begin, end in slices(texts):
                sets = shingles(texts[begin:end], n)
                coordinates = sketch(sets, bands * rows)
                found = _bands(coordinates, bands, rows).astype(np.int64)
                small += [x.tobytes() for x in mix(coordinates).astype(np.uint8)]
                for s, own in zip(sets, found, strict=True):
                    size.append(len(s))
                    one.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mix(s ^ _SEED), initial=np.uint64(0)).astype(np.int64)))
                    hashes.append(own if len(s) else own[:0])
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(hashes, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
            )

    schema = f"doc_id {id_type}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"
    return map_batches(docs.select(id_col, text_col), run, schema)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_agreement(t: int, percent: int) -> int:
    """Coordinates of t in which a plausible pair agrees at least."""
    share = percent / 100
    return int(np.floor(t * (share - SKETCH_MARGIN * float(np.sqrt(share * (1 - share) / t)))))


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for begin in range(0, len(a), 4_096):
        out[begin : begin + 4_096] = (a[begin : begin + 4_096] == b[begin : begin + 4_096]).sum(axis=1)
    return out


def _sizes_allow(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int, t: int) -> DataFrame:
    """Of pairs (a, b) those whose sketches are near enough, with the number of
    shingles of ``a``."""
    least = least_agreement(t, percent)
    kind = pairs.schema["a"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, t) for c in ("sa", "sb"))
            m, n = (batch.column(c).to_numpy() for c in ("n_shingles", "nb"))
            ok = pa.array((_agreement(one, two) >= least) & _sizes_allow(m, n, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b", "n_shingles")], ["a", "b", "n_shingles"])

    sa = sketches.select(F.col("doc_id").alias("a"), "n_shingles", F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").select("a", "b", "n_shingles", "nb", "sa", "sb")
    found = map_batches(both, near, f"a {kind}, b {kind}, n_shingles bigint")
    return found.groupBy("a", "b").agg(F.max("n_shingles").alias("n_shingles"))


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, n: int, block: int, id_col: str, text_col: str, report: dict) -> DataFrame:
    """Of plausible pairs (a, b, n_shingles of a) those at or above the threshold
    on their full sets.  The texts of all partners of ``b`` meet that of ``b``."""
    pairs = materialize(pairs, "near-pairs")
    size = pairs.groupBy("b").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / min(block, CELL)), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    size = size.select("b", blocks.alias("blocks"), F.ceil(F.col("shingles") / F.col("members")).alias("mean"))
    members = pairs.join(size, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), "blocks", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("part"), "n_shingles")
    # Partners are about as long as their hub.
    hubs = size.select(F.col("b").alias("node"), F.col("b").alias("hub"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("mean").alias("n_shingles"))
    placed = materialize(members.unionByName(hubs), "near-groups")
    texts, held = placed.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    report["texts"] = texts
    # Small groups share a task, of so many texts and so many shingles.
    cells = max(1, texts // CELL, held // CELL_SHINGLES)
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("hub"), F.lit(cells))).otherwise(F.xxhash64("hub", "part"))
    all_texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    joined = join_bounded(all_texts, placed, "node", "inner", MAX_BROADCAST_ROWS).select("node", "hub", "part", "text", cell.alias("cell"))
    kind = docs.schema[id_col].dataType.simpleString()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (hub, _), part in pdf.groupby(["hub", "part"], sort=True):
            part = part.drop_duplicates(["node", "text"])
            texts_, sets = [(x or "").encode() for x in part["text"]], []
            for begin, end in slices(texts_):
                sets += shingles(texts_[begin:end], n)
            rows = list(zip(part["node"].tolist(), sets, strict=True))
            own = [s for node, s in rows if node == hub and len(s)]
            linked = {node for node, s in rows if node != hub and len(s) and any(jaccard_at_least(s, x, percent) for x in own)}
            found += [(node, hub) for node in sorted(linked)]
        return pd.DataFrame(found, columns=["a", "b"])

    return materialize(joined.groupBy("cell").applyInPandas(links, f"a {kind}, b {kind}"), "near-links")


def _roots(links: DataFrame) -> DataFrame:
    """node, component over star links (a, b): each node has one, to a smaller
    node, so following pointers doubles the reach.  What is left apart after
    ``JUMPS`` only makes more pairs candidates."""
    at = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(JUMPS):
        to = at.select(F.col("node").alias("component"), F.col("component").alias("next"))
        at = at.join(to, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialize(at, "near-roots")


def bucket_pairs(key: np.ndarray, number: np.ndarray, sketches: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, side: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the plausible pairs of rows that have one ``key`` (a bucket, of
    band ``number``; equal keys are neighbours) and are of different components,
    each in the first bucket that it shares by its rows of band ``hashes``, which
    name the buckets.  Where a bucket has both sides, 0 and 1, pairs are across."""
    least = least_agreement(sketches.shape[1], percent)
    edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1)) if len(key) else np.zeros(1, np.int64)
    size = np.repeat(np.diff(edges), np.diff(edges))
    two = np.repeat(np.array([side[a:b].any() and not side[a:b].all() for a, b in zip(edges, edges[1:], strict=False)], bool), np.diff(edges))
    out = [(np.empty(0, np.int64),) * 2]
    for d in range(1, int(size.max(initial=0))):
        i = np.flatnonzero((key[:-d] == key[d:]) & (component[:-d] != component[d:]) & (~two[d:] | (side[:-d] != side[d:])))
        i = i[_sizes_allow(sizes[i], sizes[i + d], percent)]
        i = i[_agreement(sketches[i], sketches[i + d]) >= least]
        i = i[(hashes[i] == hashes[i + d]).argmax(axis=1) == number[i]]
        out.append((i, i + d))
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    return i, j


def trees(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that occur in the pairs (i, j), and the least row that pairs lead to
    from each.  Pairs are within one ``key``."""
    ends = np.unique(np.concatenate([i, j]))
    parent = {x: x for x in ends.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return ends, np.array([root(x) for x in ends.tolist()], np.int64)


def _within_buckets(members: DataFrame, percent: int, block: int, report: dict) -> DataFrame:
    """node, root, band: members of plausible pairs, of members (doc_id, number,
    band, members, component, n_shingles, sketch, bands)."""
    blocks = F.ceil(F.col("members") / block).cast("int")
    # Block i meets block j in the task (i, j), i <= j; a block meets itself in (i, i).
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))
    rows = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("pair", F.explode(others)).select("*", "pair.i", "pair.j").drop("pair")
    report["sketches"] = sketches = members.count()
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(max(1, sketches // SKETCH_CELL)))).otherwise(F.xxhash64("band", "i", "j"))
    placed = rows.select("doc_id", "number", "band", "i", "j", "own", "component", "n_shingles", "sketch", "bands", cell.alias("cell"))
    kind = members.schema["doc_id"].dataType.simpleString()

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["band", "i", "j", "doc_id"], kind="stable")
        key = pdf.groupby(["band", "i", "j"], sort=True).ngroup().to_numpy()
        sketches = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        hashes = np.stack(pdf["bands"].to_numpy())
        component, side = pd.factorize(pdf["component"])[0], (pdf["own"] != pdf["i"]).to_numpy()
        i, j = bucket_pairs(key, pdf["number"].to_numpy(), sketches, hashes, pdf["n_shingles"].to_numpy(), side, component, percent)
        ends, roots = trees(key, i, j)
        ids = pdf["doc_id"].to_numpy()
        return pd.DataFrame({"node": ids[ends], "root": ids[roots], "band": pdf["band"].to_numpy()[ends]}).drop_duplicates()

    return materialize(placed.groupBy("cell").applyInPandas(pairs, f"node {kind}, root {kind}, band bigint"), "near-found")


def confirmed_links(ids: list, sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, percent: int, t: int) -> list[tuple]:
    """Links that connect all pairs at or above the threshold: a forest over the
    components of one task's members.  ``side`` is 0 or 1; in a task for two
    blocks, where both are present, pairs within one block are left to that
    block's own task.
    """
    n = len(ids)
    parent = [int(x) for x in np.unique(component, return_index=True)[1][np.unique(component, return_inverse=True)[1]]]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    two, least = side.any() and not side.all(), least_agreement(t, percent)
    small = mix(sketch(sets, t)).astype(np.uint8)
    sizes = np.array([len(s) for s in sets])
    links = []
    for i in range(1, n):
        agree = (small[:i] == small[i]).sum(axis=1)
        near = (agree >= least) & (component[:i] != component[i]) & _sizes_allow(sizes[:i], sizes[i], percent)
        if two:
            near &= side[:i] != side[i]
        candidates = np.flatnonzero(near)
        for j in candidates[np.argsort(-agree[candidates], kind="stable")].tolist():
            a, b = root(i), root(j)
            if a != b and jaccard_at_least(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def _units(found: DataFrame, block: int) -> DataFrame:
    """unit, node: which members of plausible pairs (node, root, band) meet."""
    groups = connected_components(found, "node", "root").withColumnRenamed("component", "grp")
    ends = found.select("node", "band").distinct().join(groups, "node")
    by_band = ends.groupBy("grp", "band").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum(F.col("n") * F.ceil(F.col("n") / block)).alias("by_band"))
    whole = groups.groupBy("grp").agg((F.count("*") * F.ceil(F.count("*") / block)).alias("whole"))
    cheaper = materialize(by_band.join(whole, "grp").select("grp", (F.col("by_band") < F.col("whole")).alias("split")), "near-choice")
    unit = F.when(F.col("split"), F.xxhash64("grp", "band")).otherwise(F.xxhash64("grp"))
    return join_bounded(ends, cheaper, "grp", "inner", MAX_BROADCAST_ROWS).select(unit.alias("unit"), "node").distinct()


def _verify(docs: DataFrame, nodes: DataFrame, percent: int, n: int, t: int, block: int, id_col: str, text_col: str, report: dict) -> DataFrame:
    """a, b: confirmed links between members of different components that meet
    (unit, node, component, n_shingles)."""
    sums = F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")
    count = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    size = nodes.groupBy("unit", "component").agg(*sums).withColumn("large", count)
    rest = size.where("large = 1").groupBy("unit").agg(F.sum("members").alias("members"), F.sum("shingles").alias("shingles")).select("unit", count.alias("small"))
    size = size.select("unit", "component", "large").join(rest, "unit", "left")
    own = F.when(F.col("large") > 1, F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("large")))).otherwise(F.pmod(F.xxhash64("component"), F.col("small")))
    of = F.when(F.col("large") > 1, F.col("component"))
    nodes = materialize(nodes.join(size, ["unit", "component"]).select("unit", "node", "component", "n_shingles", own.alias("own"), of.alias("of")), "near-units")
    # Blocks of one large component have nothing to compare.
    blocks = materialize(nodes.select("unit", "own", "of").distinct(), "near-blocks")
    other = blocks.select("unit", F.col("own").alias("j"), F.col("of").alias("of_j"))
    meet = blocks.withColumnRenamed("own", "i").join(other, "unit").where("i <= j AND (of IS NULL OR of_j IS NULL OR of <> of_j)")
    meet = meet.select("unit", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    single = blocks.groupBy("unit").agg((F.count("*") == 1).alias("single"))
    placed = materialize(nodes.drop("of").join(meet, ["unit", "own"]).join(single, "unit"), "near-groups")
    texts, held = placed.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    report["texts"] = report.get("texts", 0) + texts
    cell = F.when(F.col("single"), F.pmod(F.xxhash64("unit"), F.lit(max(1, texts // CELL, held // CELL_SHINGLES)))).otherwise(F.xxhash64("unit", "i", "j"))
    placed = placed.withColumn("cell", cell).drop("single", "n_shingles")
    all_texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    joined = join_bounded(all_texts, placed, "node", "inner", MAX_BROADCAST_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in pdf.groupby(["unit", "i", "j"], sort=True):
            part = part.drop_duplicates(["node", "text"]).sort_values("node", kind="stable")
            texts_, sets = [(x or "").encode() for x in part["text"]], []
            for begin, end in slices(texts_):
                sets += shingles(texts_[begin:end], n)
            component = pd.factorize(part["component"])[0]
            found += confirmed_links(part["node"].tolist(), sets, component, (part["own"] != part["i"]).to_numpy(), percent, t)
        return pd.DataFrame(found, columns=["a", "b"])

    return materialize(joined.groupBy("cell").applyInPandas(links, f"a {kind}, b {kind}"), "near-links")


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    n: int = SHINGLE,
    bands: int = BANDS,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    report: dict | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document, linked at a
    Jaccard similarity of ``percent`` hundredths or more.  ``report`` gets the
    numbers of texts and sketches that were sent to tasks."""
    rows, report = band_plan(percent / 100, bands), {} if report is None else report
    seen = materialize(sketched(docs, n, bands, rows, id_col, text_col), "near-sketches")
    full = seen.where("n_shingles > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "near-classes")
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"], "left_semi")
    banded = reps.select("doc_id", F.posexplode("bands").alias("number", "band"))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = materialize(banded.join(hubs, "band"), "near-buckets")
    # A representative has a row for each of its sets (an id may have several).
    sketches = materialize(reps.select("doc_id", "n_shingles", "sketch", "bands").join(shared.select("doc_id").distinct(), "doc_id", "left_semi").distinct(), "near-nodes")

    stars = shared.where("doc_id <> hub").groupBy("doc_id", "hub").agg((-F.count("*")).alias("n"))
    stars = stars.groupBy(F.col("doc_id").alias("a")).agg(F.min(F.struct("n", "hub")).alias("most")).select("a", F.col("most.hub").alias("b"))
    links = _confirmed(docs, _plausible(stars, sketches, percent, bands * rows), percent, n, block, id_col, text_col, report)
    roots = _roots(links)
    members = shared.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = members.select("doc_id", "number", "band", F.coalesce("component", "doc_id").alias("component"))
    mixed = members.groupBy("band").agg(F.count("*").alias("members"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    members = members.join(mixed.select("band", "members"), "band").join(sketches, "doc_id")
    found = _within_buckets(materialize(members, "near-members"), percent, block, report)
    if not found.isEmpty():
        nodes = _units(found, block).join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = sketches.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n_shingles"))
        links = links.unionByName(_verify(docs, nodes.join(sizes, "node"), percent, n, bands * rows, block, id_col, text_col, report))
    # Rows of one doc_id with different sets hang together through the id.
    same_id = full.join(classes, ["d1", "d2"]).where("doc_id <> rep").groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))
    own = classes.select(F.col("rep").alias("doc_id"), F.col("rep").alias("own")).distinct()
    same_id = same_id.join(own, "doc_id", "left").withColumn("reps", F.when(F.col("own").isNull(), F.col("reps")).otherwise(F.array_union("reps", F.array("own"))))
    shared = same_id.where(F.size("reps") > 1).select(F.col("doc_id").alias("a"), F.explode("reps").alias("b"))
    merged = connected_components(links.unionByName(shared))
    reps_of = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    reps_of = reps_of.select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    joined = seen.select("doc_id", "n_shingles", "d1", "d2").join(reps_of, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9_sketch_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - {SHINGLE - 2}, 2) END), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS node FROM t UNION SELECT doc_id, b FROM reach JOIN ends ON a = node),
least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""
