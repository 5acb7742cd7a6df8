"""Substring dedup with a log-structured fingerprint index (operator 6).

A window of ``WINDOW`` words is represented by its anchor: the least hash among
its ``GRAM``-word grams, leftmost on ties.  Equal windows have equal anchors, and
neighbouring windows mostly share one, so an index over anchors holds about a
seventh of the windows.

The index is a set of immutable runs in a folder: bucketed, sorted tables of
distinct fingerprints.  A batch of documents becomes a run of its own;
fingerprints that repeat within it, or that a merge join finds in an older run,
become candidates.  Runs of one level are compacted by a merge of the sorted
buckets, without a shuffle, so a corpus of n batches keeps about log n runs.  A
manifest names the runs that count: one left by a crash isn't in it, and goes
when the index is opened again; a batch that fails is taken back.

With ``digests`` a run has each distinct window, as the fingerprint (64 bits) and
a digest of all its words (64 more).  Such an index lasts: ``dedup_batch`` judges
a new batch by the runs alone, without the texts of older ones.  A corpus that
is at hand as a whole (``dedup_substrings``) needs no digests in the runs, which
are then a seventh as long; it verifies on the texts.

Candidates are verified as windows: those under a candidate anchor are shipped
as digests, a row for each anchor position, keyed by fingerprint and digest, and
so are the windows that older runs have.  Word hashes have 64 bits, and no words
are compared beyond them.  Every ``FLUSH_BYTES`` of text first
settle what they can by themselves and ship each distinct window once at most,
so a passage that a third of all documents share is shuffled once for so much
text.  Above ``DOCS_PER_SALT`` documents a further level combines the windows of
a fingerprint in several tasks before they meet in one.  Tasks read their rows
sorted and hold a few whole groups at a time, whatever a partition's size.
What starts later than an equal window is removed from its document.

Candidates and removals are broadcast behind a check of their size; beyond it
they are joined, by fingerprint and by document.

Edge cases: null and empty texts have no words and keep nothing; texts shorter
than a window keep everything; a null doc_id counts as smaller than any other;
rows of the same doc_id are compared by start alone, and equal rows never remove
each other; ids must be integers; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    create_text,
    delete_path,
    fresh_path,
    hashed_words,
    in_parts,
    inside,
    list_names,
    map_batches,
    materialize,
    mix,
    ngrams,
    read_text,
    slices,
    table,
    text_bytes,
    write_text,
)

WINDOW = 20  # fixed by the contract
GRAM = 8
BATCHES = 4
FLUSH_BYTES = 4 << 20  # of text: windows are settled so much at a time
MAX_BROADCAST_KEYS = 4_000_000
MAX_BROADCAST_DOCS = 500_000
DOCS_PER_SALT = 50_000_000
GROUP_ROWS = 50_000  # shipped rows that a task holds, or one whole group
_D = np.random.Generator(np.random.PCG64(99)).integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.iinfo(np.int64).min


def anchors(hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, fingerprint, anchor position) of each window within one text."""
    value = ngrams(hashes, gram)
    place = np.arange(len(value))
    span, want = 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        size = max(0, len(value) - step)
        later = value[step:] < value[:size]
        value = np.where(later, value[step:], value[:size])
        place = np.where(later, place[step:], place[:size])
        span += step
    at = np.flatnonzero(inside(counts, window))
    return at, value[at], place[at]


def run_starts(place: np.ndarray) -> np.ndarray:
    """Where a new anchor position begins (positions never fall)."""
    return np.flatnonzero(np.diff(place, prepend=-1))


def fingerprints(docs: DataFrame, text_col: str) -> DataFrame:
    """fp, n: distinct fingerprints of each Arrow batch and how often (1 or 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for part in in_parts([batch], 0):
                texts = text_bytes(part.column(0))
                for begin, end in slices(texts):
                    _, fp, place = anchors(*hashed_words(texts[begin:end]))
                    found.append(fp[run_starts(place)])
            fp, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fp.astype(np.int64)), pa.array(np.minimum(n, 2))], ["fp", "n"])

    return map_batches(docs.select(text_col), run, "fp bigint, n bigint")


def window_digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    digest = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        digest += hashes[at + j] * _D[j]
    return mix(digest).astype(np.int64)


def windows(docs: DataFrame, text_col: str) -> DataFrame:
    """fp, digest, n: distinct windows of each Arrow batch and how often (1 or 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 0, FLUSH_BYTES):
            parts, texts = [(np.empty(0, np.int64),) * 2], text_bytes(batch.column(0))
            for begin, end in slices(texts):
                hashes, counts = hashed_words(texts[begin:end])
                at, fp, _ = anchors(hashes, counts)
                parts.append((fp.astype(np.int64), window_digests(hashes, at)))
            fp, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((digest, fp))
            fp, digest = fp[order], digest[order]
            heads = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (digest[1:] != digest[:-1]))[: len(fp)])
            n = np.minimum(np.diff(np.append(heads, len(fp))), 2)
            yield pa.RecordBatch.from_arrays([pa.array(fp[heads]), pa.array(digest[heads]), pa.array(n, pa.int64())], ["fp", "digest", "n"])

    return map_batches(docs.select(text_col), run, "fp bigint, digest bigint, n bigint")


_RUN, _MANIFEST = re.compile(r"quillspark_run_[0-9a-f]{32}"), re.compile(r"manifest-[0-9]{12}\.json(\.part)?")
_OWNER = "owner"


class RunIndex:
    """Log-structured index of fingerprints, with or without ``digests``, in a
    folder that all executors share: ``path``, which is opened or made and lasts,
    or else one for this session.

    A lasting index is open once at a time: its folder names the owner until
    ``close``.  After a crash ``take_over=True`` opens it all the same; the one
    that had it can commit no more.  A folder with anything else in it is no
    index and is left alone, and only what the index has written is ever deleted.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digests: bool = False, fan_in: int = 2, take_over: bool = False):
        self.spark, self.fan_in, self.lasting = spark, fan_in, path is not None
        self.path = (path or fresh_path(spark, "runs")).rstrip("/")
        self.keys = ["fp", "digest"] if digests else ["fp"]
        self.runs: list[tuple[int, str]] = []  # (level, table), in order of arrival
        self.committed: list[tuple[int, str]] = []
        self.version, self.token = 0, uuid.uuid4().hex
        self._open(take_over)

    def _open(self, take_over: bool) -> None:
        names = list_names(self.spark, self.path)
        manifests = [x for x in names if _MANIFEST.fullmatch(x) and x.endswith(".json")]
        foreign = [x for x in names if not (x == _OWNER or _RUN.fullmatch(x) or _MANIFEST.fullmatch(x))]
        if foreign:
            raise ValueError(f"{self.path} is no index: it has {foreign[0]}")
        found = json.loads(read_text(self.spark, f"{self.path}/{manifests[-1]}")) if manifests else None
        if found and found["keys"] != self.keys:
            raise ValueError(f"the index at {self.path} has {found['keys']}, not {self.keys}")
        self.buckets = found["runs"][0][2] if found and found["runs"] else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.lasting:
            if _OWNER in names and take_over:
                delete_path(self.spark, f"{self.path}/{_OWNER}")
            if not create_text(self.spark, f"{self.path}/{_OWNER}", self.token):
                raise RuntimeError(f"the index at {self.path} is open; after a crash, open it with take_over=True")
        if found:
            self.version = found["version"]
            for level, name, _ in found["runs"]:
                self._register(name)
                self.runs.append((level, name))
        self.committed = list(self.runs)
        self._sweep()

    def _register(self, name: str) -> None:
        fields = ", ".join(f"{k} bigint" for k in self.keys)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({fields}, many boolean) USING parquet "
            f"CLUSTERED BY (fp) SORTED BY ({', '.join(self.keys)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )

    def _owned(self) -> bool:
        return not self.lasting or (_OWNER in list_names(self.spark, self.path) and read_text(self.spark, f"{self.path}/{_OWNER}") == self.token)

    def _sweep(self) -> None:
        """Delete runs and manifests that the present manifest doesn't name: what
        a crash left, or a commit has made obsolete."""
        kept = {name for _, name in self.runs} | {self._manifest()}
        for name in list_names(self.spark, self.path):
            if name not in kept and (_RUN.fullmatch(name) or _MANIFEST.fullmatch(name)):
                delete_path(self.spark, f"{self.path}/{name}")

    def rollback(self) -> None:
        """Take back what was added since the last commit (of a lasting index)."""
        for run in [r for r in self.runs if r not in self.committed]:
            self._forget(run, self._owned())
        for _, name in self.committed:
            self._register(name)
        self.runs = list(self.committed)

    def _manifest(self) -> str:
        return f"manifest-{self.version:012d}.json"

    def commit(self) -> None:
        """From here on the index has the runs that it has now."""
        if self.lasting:
            if not self._owned():
                raise RuntimeError(f"the index at {self.path} was taken over")
            self.version += 1
            runs = [(level, name, self.buckets) for level, name in self.runs]
            write_text(self.spark, f"{self.path}/{self._manifest()}", json.dumps({"version": self.version, "keys": self.keys, "runs": runs}))
            self.committed = list(self.runs)
            self._sweep()

    def _write(self, run: DataFrame) -> str:
        name = f"quillspark_run_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self.buckets, "fp").sortBy(*self.keys).format("parquet").option("path", f"{self.path}/{name}")
        writer.saveAsTable(name)
        return name

    def add(self, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Index a batch; return its candidates, the keys that it repeats or that
        an older run has, and of these the latter."""
        made = windows(docs, text_col) if "digest" in self.keys else fingerprints(docs, text_col)
        name = self._write(made.groupBy(*self.keys).agg((F.sum("n") > 1).alias("many")))
        rows, old = self.spark.table(name), None
        for _, run in self.runs:
            found = rows.hint("merge").join(self.spark.table(run), self.keys, "left_semi").select(*self.keys)
            old = found if old is None else old.unionByName(found)
        old = rows.select(*self.keys).limit(0) if old is None else old
        found = rows.where("many").select(*self.keys, F.lit(False).alias("old")).unionByName(old.withColumn("old", F.lit(True)))
        found = materialize(found.groupBy(*self.keys).agg(F.max("old").alias("old")), "candidates")
        self.runs.append((0, name))
        self.compact()
        return found.select(*self.keys), found.where("old").select(*self.keys)

    def compact(self) -> None:
        """Merge the runs of a level once there are ``fan_in`` of them."""
        while len(level := [r for r in self.runs if r[0] == self.runs[-1][0]]) >= self.fan_in:
            merged = self.spark.table(level[0][1]).select(*self.keys)
            for _, name in level[1:]:
                merged = merged.hint("merge").join(self.spark.table(name).select(*self.keys), self.keys, "full_outer")
            name = self._write(merged.select(*self.keys, F.lit(False).alias("many")))
            for run in level:
                self._forget(run, not self.lasting)  # a lasting index deletes once the manifest has changed
            self.runs.append((level[0][0] + 1, name))

    def _forget(self, run: tuple[int, str], delete: bool) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[1]}")
        self.runs.remove(run)
        if delete:
            delete_path(self.spark, f"{self.path}/{run[1]}")

    def close(self) -> None:
        """Let go of the runs' tables.  A lasting index keeps its files, and what
        isn't committed is swept when it is opened again."""
        for run in list(self.runs):
            self._forget(run, False)
        if not self.lasting:
            delete_path(self.spark, self.path)
        elif self._owned():
            delete_path(self.spark, f"{self.path}/{_OWNER}")


def _first(fp, digest, doc, start) -> tuple[np.ndarray, np.ndarray]:
    """Of (fp, digest) occurrences: which are the earliest, and which are the
    only ones of their place that need to be told on (one a group)."""
    order = np.lexsort((start, doc, digest, fp))
    f, d = fp[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (doc[order] == doc[order][lead]) & (start[order] == start[order][lead])
    earliest, told = np.empty(len(order), bool), np.empty(len(order), bool)
    earliest[order], told[order] = same, new
    return earliest, told


def _runs_of(*keys: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Starts of maximal stretches of equal keys and consecutive starts."""
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_SHIPPED = "fp bigint, doc_id bigint, tkey bigint, start int, n int, digests array<bigint>"


def _shipped(fp, doc, tkey, start, n, offsets, digests) -> pa.RecordBatch:
    """Rows of ``_SHIPPED``; a row without digests is a stretch already found to
    be a repeat."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(digests, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(fp), pa.array(doc), pa.array(tkey), pa.array(start, pa.int32()), pa.array(n, pa.int32()), lists],
        ["fp", "doc_id", "tkey", "start", "n", "digests"],
    )


def _settled(fp: np.ndarray, digest: np.ndarray, row: np.ndarray, start: np.ndarray, doc: np.ndarray, tkey: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows (of texts ``row``, with their doc and tkey) as shipped rows: what
    starts after an equal window of these, and one occurrence of each window."""
    earliest, told = _first(fp, digest, doc, start)
    late = np.flatnonzero(~earliest)
    heads = _runs_of(row[late], start=start[late])
    n = np.diff(np.append(heads, len(late)))
    late = late[heads]
    if len(late):
        spread = mix((doc[late] + start[late]).astype(np.uint64)).astype(np.int64)
        yield _shipped(spread, doc[late], tkey[late], start[late], n, np.zeros(len(late) + 1), [])
    open_ = np.flatnonzero(told)
    heads = _runs_of(row[open_], fp[open_], start=start[open_])
    n = np.diff(np.append(heads, len(open_)))
    rows = open_[heads]
    yield _shipped(fp[rows], doc[rows], tkey[rows], start[rows], n, np.append(heads, len(open_)), digest[open_])


def suspect_windows(docs: DataFrame, known) -> DataFrame:
    """Windows under a candidate anchor.  The candidates are ``known`` (a
    broadcast sorted array) or else each document's own column ``suspects``."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        """fp, digest, row and start of each suspected window, by slice."""
        texts = text_bytes(batch.column(1))
        for begin, end in slices(texts):
            hashes, counts = hashed_words(texts[begin:end])
            at, fp, place = anchors(hashes, counts)
            if not len(at):
                continue
            firsts = np.cumsum(counts) - counts
            doc = np.searchsorted(np.cumsum(counts), at, "right")
            heads = run_starts(place)
            own = fp[heads].astype(np.int64)
            hit = _member(own, known.value) if known is not None else _member_pairs(doc[heads], own, batch.column(3).slice(begin, end - begin))
            use = np.repeat(hit, np.diff(np.append(heads, len(at))))
            w, owner = at[use], doc[use]
            yield fp[use].astype(np.int64), window_digests(hashes, w), owner + begin, w - firsts[owner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, 1, FLUSH_BYTES):
            yield from settle(part)

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not (parts := list(found(batch))):
            return
        fp, digest, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
        doc, tkey = ids[row], batch.column(2).to_numpy()[row]
        yield from _settled(fp, digest, row, start, doc, tkey)

    return map_batches(docs, run, _SHIPPED)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _member_pairs(doc: np.ndarray, fp: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each document's own list has its fingerprint."""
    hit = np.zeros(len(fp), bool)
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)) if len(doc) else []
    for a, b in zip(edges, edges[1:], strict=False):
        own = lists[int(doc[a])].values
        if own is not None and len(own):
            hit[a:b] = np.isin(fp[a:b], own.to_numpy(zero_copy_only=False))
    return hit


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, in tables of about ``GROUP_ROWS`` rows that divide
    no group of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < GROUP_ROWS:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column, last = batch.column(k).to_numpy(), held[-2].column(k)[-1].as_py() if len(held) > 1 else batch.column(k)[0].as_py()
            new |= np.diff(column, prepend=np.int64(last)) != 0
        if len(cuts := np.flatnonzero(new)):
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _opened(t: pa.Table) -> tuple[np.ndarray, tuple]:
    """Of shipped rows: which are done, and the windows of the others (fp,
    digest, row, start)."""
    lists = t.column("digests").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    windows = t.column("fp").to_numpy()[row], lists.flatten().to_numpy(), row, t.column("start").to_numpy()[row] + within
    return sizes == 0, windows


def combined_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of shipped rows sorted by fp, shipped rows with each window once."""
    for t in whole_groups(batches, "fp"):
        done, (fp, digest, row, start) = _opened(t)
        yield from t.filter(pa.array(done)).combine_chunks().to_batches()
        doc, tkey = t.column("doc_id").to_numpy()[row], t.column("tkey").to_numpy()[row]
        yield from _settled(fp, digest, row, start, doc, tkey)


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of shipped rows sorted by fp, the stretches that repeat an earlier window:
    doc_id, tkey, start, n."""
    for t in whole_groups(batches, "fp"):
        done, (fp, digest, row, at) = _opened(t)
        doc, tkey, start, n = (t.column(c).to_numpy() for c in ("doc_id", "tkey", "start", "n"))
        earliest, _ = _first(fp, digest, doc[row], at)
        late = np.flatnonzero(~earliest)
        heads = _runs_of(row[late], start=at[late])
        first = late[heads]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([doc[done], doc[row[first]]])),
                pa.array(np.concatenate([tkey[done], tkey[row[first]]])),
                pa.array(np.concatenate([start[done], at[first]]), pa.int32()),
                pa.array(np.concatenate([n[done], np.diff(np.append(heads, len(late)))]), pa.int32()),
            ],
            ["doc_id", "tkey", "start", "n"],
        )


def merged_cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the removed words, as merged intervals [lo, hi).  Rows are
    sorted by document."""
    for t in whole_groups(batches, "doc_id", "tkey"):
        yield _cover(t)


def _cover(t: pa.Table) -> pa.RecordBatch:
    doc, tkey, start, n = (t.column(c).to_numpy() for c in ("doc_id", "tkey", "start", "n"))
    order = np.lexsort((start, tkey, doc))
    doc, tkey, lo, hi = doc[order], tkey[order], start[order].astype(np.int64), start[order].astype(np.int64) + n[order] + WINDOW - 1
    text = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])))
    # Texts laid end to end, so that one running maximum serves all of them.
    shift = text * (hi.max() + 1)
    reach = np.maximum.accumulate(hi + shift)
    new = np.append(True, lo[1:] + shift[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    ends = reach[np.append(heads[1:], len(lo)) - 1] - shift[heads]
    of = text[heads]
    firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    offsets = pa.array(np.append(firsts, len(heads)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc[heads][firsts]),
            pa.array(tkey[heads][firsts]),
            pa.ListArray.from_arrays(offsets, pa.array(lo[heads], pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int32())),
        ],
        ["doc_id", "tkey", "lo", "hi"],
    )


def _with_suspects(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The other way than broadcasting candidates: each text's fingerprints are
    joined to them and collected per text (bounded by the text's length)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            texts = list(dict.fromkeys(text_bytes(batch.column(1))))
            for begin, end in slices(texts):
                hashes, counts = hashed_words(texts[begin:end])
                at, fp, place = anchors(hashes, counts)
                heads = run_starts(place)
                doc = np.searchsorted(np.cumsum(counts), at[heads], "right")
                pairs = sorted(set(zip(doc.tolist(), fp[heads].astype(np.int64).tolist(), strict=True)))
                keys = [hashlib.sha256(t).hexdigest() for t in texts[begin:end]]
                yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d, _ in pairs], pa.string()), pa.array([f for _, f in pairs], pa.int64())], ["of_text", "fp"])

    pairs = map_batches(docs, own, "of_text string, fp bigint").distinct().join(candidates, "fp", "left_semi")
    lists = pairs.groupBy("of_text").agg(F.collect_list("fp").alias("suspects"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.join(lists, digest == F.col("of_text")).select("doc_id", "text", "tkey", "suspects")


def removed_words(
    docs: DataFrame, candidates: DataFrame, max_broadcast_keys: int = MAX_BROADCAST_KEYS, salts: int = 1, old: DataFrame | None = None
) -> DataFrame:
    """doc_id, tkey, lo, hi: merged intervals of words to remove, verified.  With
    ``salts`` above 1 the windows of a fingerprint first meet in so many tasks.
    ``old`` windows (fp, digest) come before all of these documents."""
    spark = docs.sparkSession
    known = None
    if candidates.limit(max_broadcast_keys + 1).count() <= max_broadcast_keys:
        keys = candidates.toArrow().column("fp").to_numpy()
        known = spark.sparkContext.broadcast(np.unique(keys))
        if not len(keys):
            return spark.createDataFrame([], "doc_id bigint, tkey bigint, lo array<int>, hi array<int>")
    else:
        docs = _with_suspects(docs, candidates)
    shipped = suspect_windows(docs, known)
    if old is not None:
        first = [F.lit(x).cast(k).alias(c) for c, x, k in (("doc_id", _NONE, "bigint"), ("tkey", 0, "bigint"), ("start", -1, "int"), ("n", 1, "int"))]
        shipped = shipped.unionByName(old.select("fp", *first, F.array("digest").alias("digests")))
    if salts > 1:
        salted = shipped.repartition("fp", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).sortWithinPartitions("fp")
        shipped = map_batches(salted, combined_windows, _SHIPPED)
    met = shipped.repartition("fp").sortWithinPartitions("fp")
    late = map_batches(met, later_windows, "doc_id bigint, tkey bigint, start int, n int")
    own = late.repartition("doc_id", "tkey").sortWithinPartitions("doc_id", "tkey")
    cover = map_batches(own, merged_cover, "doc_id bigint, tkey bigint, lo array<int>, hi array<int>")
    return materialize(cover, "removed-words")


def strip_words(docs: DataFrame, removed: DataFrame, max_broadcast_docs: int = MAX_BROADCAST_DOCS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space."""
    counted = removed.agg(F.count("*"), F.sum(F.size("lo"))).first()
    small = counted[0] <= max_broadcast_docs and (counted[1] or 0) <= 8 * max_broadcast_docs

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            n_words, n_removed, kept = [], [], []
            for text, lo, hi in zip(text_bytes(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                words, out, at = text.split(), [], 0
                for a, b in zip(lo or [], hi or [], strict=True):
                    out += words[at:a]
                    at = b
                out += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    removed = removed.select(F.col("doc_id").alias("rid"), F.col("tkey").alias("rkey"), "lo", "hi")
    on = (F.coalesce("doc_id", F.lit(_NONE)) == F.col("rid")) & (F.col("tkey") == F.col("rkey"))
    joined = docs.join(F.broadcast(removed) if small else removed, on, "left")
    return map_batches(joined.select("doc_id", "text", "lo", "hi"), strip, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tkey"))


def dedup_batch(
    index: RunIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_keys: int = MAX_BROADCAST_KEYS, docs_per_salt: int = DOCS_PER_SALT
) -> DataFrame:
    """doc_id, n_words, n_removed, text (what is left) of each document of a new
    batch.  All batches that the index has (with ``digests``) count as earlier,
    whatever their ids.  The batch counts once its result is written: after a
    failure before that, it is taken back and can be given again."""
    if "digest" not in index.keys:
        raise ValueError("the index has no digests of windows")
    docs = _prepared(docs, id_col, text_col)
    try:
        found, old = index.add(docs, "text")
        candidates = materialize(found.select("fp").distinct(), "candidates")
        removed = removed_words(docs, candidates, max_broadcast_keys, 1 + docs.count() // docs_per_salt, old)
        out = materialize(strip_words(docs, removed), "batch")
        index.commit()
    except BaseException:
        if index.lasting:
            index.rollback()
        raise
    return out


def dedup_substrings(
    docs: DataFrame,
    batches: int = BATCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
    docs_per_salt: int = DOCS_PER_SALT,
) -> DataFrame:
    """doc_id, n_words, n_removed, text (what is left) of each document.

    The documents enter the index in ``batches``, ranges of ids, as they would
    arrive."""
    spark = docs.sparkSession
    docs = _prepared(docs, id_col, text_col)
    shares = [i / batches for i in range(1, batches)] or [0.5]
    n, cuts = docs.select(F.count("*"), F.percentile_approx("doc_id", shares, 1000)).first()
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    doc_id = F.col("doc_id")
    ranges = [(doc_id > a) & (doc_id <= b) for a, b in zip(cuts, cuts[1:], strict=False)]
    ranges = [doc_id.isNull() | (doc_id <= cuts[0]), *ranges, doc_id > cuts[-1]] if cuts else [F.lit(True)]
    index, candidates = RunIndex(spark), None
    try:
        for own in ranges:
            found, _ = index.add(docs.where(own), "text")
            candidates = found if candidates is None else candidates.unionByName(found)
    finally:
        index.close()
    return strip_words(docs, removed_words(docs, candidates.distinct(), max_broadcast_keys, 1 + n // docs_per_salt))


def op6_fingerprint_runs(spark, sf_dir: str) -> DataFrame:
    got = dedup_substrings(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: A window is known by a digest of its words.
OP6_SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i AS start, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k FROM t, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
late AS (SELECT doc_id, start FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, start + j AS i FROM late, range(0, {WINDOW}) AS r(j)),
each AS (SELECT doc_id, i, w[i] AS word FROM t, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT * FROM each ANTI JOIN gone USING (doc_id, i)),
text AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM kept GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN text USING (doc_id)
"""
