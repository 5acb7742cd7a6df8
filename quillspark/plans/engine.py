"""The engine: ingest, index, ask and evaluate over tables."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from concurrent.futures import Future
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answering, chunking, embedding, evaluation, memory, search
from ..sources import changing
from ..sources import store as stores


@dataclass(frozen=True)
class Config:
    chunk_size: int = 512
    min_chunk_size: int = 100
    strategy: str = "structure"
    semantics: str = "intended"
    metric: str = "cosine"
    max_chunks: int = 5
    threshold: float = 0.3
    memory_turns: int = 4
    index_type: str = "flat"
    cells: int = 32
    probes: int = 4
    parts: int = 8
    timeout_s: float = 60.0

    @classmethod
    def load(cls, path: str | None = None, prefix: str = "QUILL_") -> Config:
        """Defaults, then a JSON file, then environment variables (QUILL_METRIC
        and so on); unknown keys of the file are an error."""
        given = {}
        if path is not None:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
        config = cls(**given)
        found = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return replace(config, **{k: type(getattr(config, k))(v) for k, v in found.items()})


#: Turns of this session that are held on the driver before they go to a table.
HELD_TURNS = 1_000
TIMED_OUT = object()
_TURNS = "conv_id bigint, turn bigint, role string, text string"
_META = ("doc_id", "source_page", "language", "content_type", "word_count", "char_count")


class Engine:
    """Batch question answering.  State is tables: the vector store, written when
    it is built, and the conversation's turns."""

    def __init__(self, spark: SparkSession, config: Config | None = None, embedder=None, generator=None):
        self.spark, self.config = spark, config or Config()
        if self.config.index_type not in ("flat", "ivf", "lsh"):
            raise ValueError(f"unknown index type {self.config.index_type!r}")
        self.embedder = embedder or embedding.HashingEmbedder()
        self.generator = generator or answering.ExtractiveGenerator()
        self.store: DataFrame | None = None
        self.path: str | None = None
        self.centroids = None
        self.asked, self.since = 0, time.time()
        self._old = spark.createDataFrame([], _TURNS)
        self._turns_path: str | None = None
        self._held: list[tuple] = []

    @property
    def turns(self) -> DataFrame:
        return self._old.unionByName(self.spark.createDataFrame(self._held, _TURNS))

    def build(self, pages: DataFrame, path: str | None = None) -> DataFrame:
        """Chunk, embed and index pages (doc_id, page_number, text), and write the
        store to ``path``, or to a folder of this session."""
        c = self.config
        chunks = chunking.chunk_pages(pages, c.strategy, c.chunk_size, c.min_chunk_size, c.semantics)
        embedded = embedding.encode(chunks.withColumn("text", F.col("content")), self.embedder, "text", "vector")
        rows = embedded.select(
            F.concat_ws("/", "doc_id", "chunk_id").alias("chunk_id"),
            "text",
            F.create_map(*(x for k in _META for x in (F.lit(k), F.col(k).cast("string")))).alias("metadata"),
            "vector",
        )
        return self._kept(lambda folder: stores.numbered(rows, folder=folder), path)

    def build_from_bundle(self, bundle: DataFrame, path: str | None = None) -> DataFrame:
        """Index embedded texts (text, vector, and where there are: chunk_id,
        metadata).  Rows without an id are chunk_0, chunk_1, ... by their order."""
        return self._kept(lambda folder: stores.bundle_rows(bundle, folder), path)

    def _kept(self, rows, path: str | None) -> DataFrame:
        """Keep ``rows`` of a folder that goes once they are in the store."""
        folder = stores.session_folder(self.spark, "numbered")
        try:
            return self._keep(rows(folder), path)
        finally:
            stores.delete_path(self.spark, folder)

    def rebuild(self, pages: DataFrame) -> DataFrame:
        """Build anew, beside the present store, which serves until then."""
        return self.build(pages)

    def rebuild_in_background(self, pages: DataFrame) -> Future:
        """Build anew in another thread, in a folder of its own.  Questions are
        answered from the present store until the new one is whole, which then
        takes its place at once; if it fails, the present one stays and the
        future has the error."""
        done: Future = Future()

        def run() -> None:
            try:
                other = Engine(self.spark, self.config, self.embedder, self.generator)
                other.build(pages)
                self.__dict__.update(store=other.store, centroids=other.centroids, path=other.path, config=other.config)
                done.set_result(self.store)
            except BaseException as error:
                done.set_exception(error)

        InheritableThread(target=run, daemon=True).start()
        return done

    def _keep(self, rows: DataFrame, path: str | None) -> DataFrame:
        path = path or stores.session_folder(self.spark, "store")
        self.store, self.centroids, self.path, before = rows, None, None, (self.store, self.centroids, self.path)
        try:
            if self.config.index_type == "ivf":
                self.store, self.centroids = search.build_ivf(rows, self.config.cells, "vector", metric=self.config.metric)
            elif self.config.index_type == "lsh":
                bits = max(1, (self.config.cells - 1).bit_length())
                self.store, self.centroids = search.build_lsh(rows, bits, "vector", metric=self.config.metric)
            self.save(path)
            self.load(path)
        except Exception:
            self.store, self.centroids, self.path = before
            raise
        return self.store

    def _kind(self) -> str:
        return "flat" if self.centroids is None else "lsh" if isinstance(self.centroids, search.Hyperplanes) else "ivf"

    def _place(self):
        return changing.hashed(self.config.parts) if self.centroids is None else changing.by_cell(self.centroids, self.config.metric)

    def _table(self, path: str) -> changing.ChangingStore:
        return changing.ChangingStore(self.spark, f"{path}/vectors", self._place())

    def save(self, path: str) -> None:
        if self.centroids is not None:
            stores.save_cells(self.spark, self.centroids, path)
        self._table(path).create(self.store)
        stores.save_settings(self.spark, path, metric=self.config.metric, index_type=self._kind(), dimension=self.embedder.dimension, model=self.embedder.name, parts=self.config.parts)

    def load(self, path: str) -> bool:
        """Open the store at ``path``; further changes are made there."""
        settings = stores.load_settings(self.spark, path, metric=self.config.metric, dimension=self.embedder.dimension, index_type=self.config.index_type)
        if settings is None:
            self.store = self.path = None
            return False
        self.config = replace(self.config, parts=int(settings["parts"] or self.config.parts))
        self.centroids = stores.load_cells(self.spark, path, settings["index_type"]) if settings["index_type"] in ("ivf", "lsh") else None
        self.path = path
        self._reopen()
        return True

    def _reopen(self) -> None:
        rows = self._table(self.path).read()
        self.store = rows.drop("part") if self.centroids is None else rows.withColumnRenamed("part", "cell")

    def _changed(self, change) -> None:
        if self.path is None:
            raise RuntimeError("no store: build or load one first")
        change(self._table(self.path))
        self._reopen()

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """Rows with a vector: the given one, or else their text's."""
        rows = rows if "metadata" in rows.columns else rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        return rows if "vector" in rows.columns else embedding.encode(rows, self.embedder, "text", "vector")

    def add(self, rows: DataFrame) -> None:
        """Append rows (chunk_id, text, and where there are: metadata, vector) to
        the store on disk.  Without vectors their texts are embedded."""
        self._changed(lambda table: table.append(self._embedded(rows)))

    def update(self, changes: DataFrame) -> None:
        """Text, metadata and vector of ids, on disk; see ``ChangingStore``."""
        self._changed(lambda table: table.update(self._embedded(changes)))

    def delete(self, ids: DataFrame) -> None:
        """Remove ids (chunk_id) from the store on disk."""
        self._changed(lambda table: table.delete(ids))

    def compact(self) -> None:
        self._changed(lambda table: table.compact())

    def clear(self) -> None:
        """Remove all rows of the store, on disk."""
        if self.path is not None:
            self._changed(lambda table: table.clear())
        elif self.store is not None:
            self.store = self.spark.createDataFrame([], self.store.schema)

    def _hits(self, queries, k: int, threshold: float | None, c: Config) -> DataFrame:
        """What queries, embedded, find in the store."""
        if self.store is None:
            raise RuntimeError("no store: build or load one first")
        cells = None if self.centroids is None else (self.centroids, c.probes)
        return search.topk(self.store, queries, k, c.metric, threshold, "pos", "vector", cells=cells)

    def _queries(self, texts: DataFrame, text_col: str) -> DataFrame:
        prefixed = texts.select("query_id", F.concat(F.lit("query: "), F.trim(text_col)).alias("q"))
        return embedding.encode(prefixed, self.embedder, "q", "vector", prefix=False)

    def _contents(self) -> DataFrame:
        return self.store.select("pos", "chunk_id", F.col("text").alias("content"), "metadata")

    def search(self, queries: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
        """query_id, rank, score, chunk_id, content, metadata: the k chunks nearest
        to each text of queries (query_id, text), of at least ``threshold``."""
        hits = self._hits(self._queries(queries, "text"), k or self.config.max_chunks, threshold, self.config)
        return answering.with_content(hits, self._contents(), "pos").select("query_id", "source.*")

    def search_text(self, text: str, k: int | None = None, threshold: float | None = None) -> list[dict]:
        """The chunks nearest to one text, best first."""
        rows = self.search(self.spark.createDataFrame([(0, text)], "query_id bigint, text string"), k, threshold)
        return [r.asDict() for r in rows.drop("query_id").orderBy("rank").collect()]

    def ask_batch(self, questions: DataFrame, include_sources: bool = True, **overrides) -> DataFrame:
        """Answers of questions (query_id, question) with their sources; settings
        can be overridden: max_chunks 1 to 20, threshold 0 to 1."""
        c = self._overridden(overrides)
        valid = answering.valid_questions(questions)
        out = self._answers(valid, self._hits(self._queries(valid, "question"), c.max_chunks, c.threshold, c), c)
        return out if include_sources else out.drop("context", "sources")

    def _overridden(self, overrides: dict) -> Config:
        c = replace(self.config, **overrides)
        if not 1 <= c.max_chunks <= 20 or not 0 <= c.threshold <= 1:
            raise ValueError("max_chunks must be 1 to 20 and threshold 0 to 1")
        return c

    def _answers(self, valid: DataFrame, hits: DataFrame, c: Config) -> DataFrame:
        rows = valid.join(answering.retrieve_context(hits, self._contents(), valid, "pos"), "query_id")
        if "conv_id" in valid.columns:
            recent = memory.recent_memory(self.turns, c.memory_turns).select(F.col("conv_id").alias("query_conv"), "memory")
            rows = rows.join(recent, F.col("conv_id") == F.col("query_conv"), "left").drop("query_conv")
        else:
            rows = rows.withColumn("memory", F.lit(None).cast("string"))
        return answering.answer(rows, self.generator, c.semantics)

    def ask(self, question: str, conv_id: int | None = None, timeout: float | None = None, **overrides) -> dict:
        """One answer, with the time it took.  In a conversation the last turns
        join the prompt, and an answer that was found joins the conversation.
        After ``timeout`` seconds (else the config's; 0 for none) its Spark jobs
        are cancelled and a row with ``model_used`` "timeout" comes back."""
        began, c = time.time(), self._overridden(overrides)
        if question is None or not 1 <= len(question) <= 1000:
            raise ValueError("a question has 1 to 1000 characters")

        def work():
            # One text is embedded here, which saves a job; the rest is one plan.
            vector = embedding.contained(self.embedder, ["query: " + question.strip(" ")])[0]
            hits = self._hits([(0, np.zeros(self.embedder.dimension) if vector is None else vector)], c.max_chunks, c.threshold, c)
            asked = self.spark.createDataFrame([(0, question, conv_id)], "query_id bigint, question string, conv_id bigint")
            return self._answers(asked if conv_id is not None else asked.drop("conv_id"), hits, c).first()

        got = self._within(self.config.timeout_s if timeout is None else timeout, work)
        self.asked += 1
        if got is TIMED_OUT:
            answer = {"query_id": 0, "question": question, "conv_id": conv_id, "answer": answering.TIMED_OUT, "model_used": "timeout", "confidence": 0.0, "n_sources": 0, "sources": []}
        else:
            answer = {"conv_id": conv_id} | got.asDict()
            if conv_id is not None and got["model_used"] not in ("none", "error"):
                self.remember(conv_id, question, got["answer"])
        now = time.time()
        return answer | {"response_time_ms": int(1000 * (now - began)), "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S", time.localtime(now))}

    def _within(self, seconds: float, work):
        """What ``work`` gives, or TIMED_OUT; then none of its jobs goes on."""
        if seconds <= 0:
            return work()
        sc, tag, out = self.spark.sparkContext, f"quillspark-{uuid.uuid4().hex}", {}
        expired = threading.Event()

        def run() -> None:
            sc.addJobTag(tag)
            sc.setInterruptOnCancel(True)  # a worker that waits for a model is ended too
            try:
                if not expired.is_set():
                    out["got"] = work()
            except BaseException as error:  # handed on below
                out["error"] = error
            finally:
                sc.removeJobTag(tag)

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        thread.join(seconds)
        if thread.is_alive():
            expired.set()
            while thread.is_alive():  # a job that starts between two cancellations ends by the next
                sc.cancelJobsWithTag(tag)
                thread.join(0.2)
            return TIMED_OUT
        if "error" in out:
            raise out["error"]
        return out["got"]

    def remember(self, conv_id: int, question: str, answer: str) -> None:
        held = [turn for conv, turn, _, _ in self._held if conv == conv_id]
        last = max(held) if held else self._old.where(F.col("conv_id") == conv_id).agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0]
        self._held += [(conv_id, last + 1, "user", question), (conv_id, last + 2, "assistant", answer)]
        if len(self._held) >= HELD_TURNS:
            self._turns_path = self._turns_path or stores.session_folder(self.spark, "turns")
            self.spark.createDataFrame(self._held, _TURNS).coalesce(1).write.mode("append").parquet(self._turns_path)
            self._old, self._held = self.spark.read.schema(_TURNS).parquet(self._turns_path), []

    def history(self) -> DataFrame:
        return memory.history_pairs(self.turns)

    def clear_memory(self) -> None:
        self._old, self._turns_path, self._held, self.asked = memory.clear_memory(self._old), None, [], 0

    def stats(self) -> dict:
        """The store's figures, the conversations' and the session's."""
        found = {"total_vectors": 0} if self.store is None else search.store_statistics(self.store, self._kind(), self.config.metric).first().asDict()
        state = "not_available" if self.store is None else "ready"
        return found | {"status": state, "conversation_count": max(self.asked, self.history().count()), "uptime_seconds": time.time() - self.since}

    def info(self) -> dict:
        """What runs here: the parts by name, the settings, what can be asked."""
        calls = sorted(n for n in vars(type(self)) if not n.startswith("_") and callable(getattr(self, n)))
        return {"name": "quillspark", "embedder": self.embedder.name, "generator": self.generator.name, "config": asdict(self.config), "calls": calls}

    def health(self) -> dict:
        """Of the store, the embedder and the generator, without touching memory."""
        parts = {"store": self.store is not None}
        for name, call in (("embedder", lambda: self.embedder.encode(["test"])), ("generator", lambda: self.generator.generate(["a"], ["a b."], [""]))):
            try:
                call()
                parts[name] = True
            except Exception:  # whatever a plugged-in model raises
                parts[name] = False
        status = "healthy" if all(parts.values()) else "degraded" if parts["store"] else "unhealthy"
        return {"status": status, **parts}

    def evaluate(self, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows and summary for test cases (id, question, answer).  A case without
        an id is test_1, test_2, ... by its place; one without question or answer
        is left out."""
        given = F.col("id").cast("string") if "id" in cases.columns else F.lit(None).cast("string")
        placed = stores.numbered(cases.select(given.alias("id"), "question", F.col("answer").alias("truth")), "query_id")
        placed = placed.withColumn("id", F.coalesce("id", F.concat(F.lit("test_"), F.col("query_id") + 1)))
        placed = placed.where("question IS NOT NULL AND truth IS NOT NULL")
        asked = self.ask_batch(placed.select("query_id", "question")).select("query_id", "answer", "context")
        rows = evaluation.evaluate(placed.join(asked, "query_id"), embedder=self.embedder)
        return rows, evaluation.summary(rows)
