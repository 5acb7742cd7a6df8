"""Chunking: sentences, paragraphs, sentence windows with overlap, structure.

The folds run in the row, in Arrow batches, so a document never leaves its task;
what compares chunks with each other is Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches, plain
from ..functions import patterns as P
from ..functions import text as T

SIZE, MIN_SIZE = 512, 100
_STRINGS = "array<string>"


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), T.strip), lambda s: s != "")


def sentences(text: Column, language: Column) -> Column:
    """Bengali and mixed text lose their terminators; mixed text is split both
    ways, one list after the other; anything else falls back to both sets."""

    def split(t: Column, lang: Column) -> Column:
        bengali = _parts(t, f"[।!?]+{P.SPACE}*")
        english = _parts(t, f"[.!?]+{P.SPACE}+")
        return (
            F.when(lang == "bn", bengali)
            .when(lang == "mixed", F.concat(bengali, english))
            .when(lang == "en", english)
            .otherwise(F.array().cast(_STRINGS))
        )

    def fall_back(t: Column, found: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(_parts(t, "[।.!?]+"))

    return T.let([text, language], lambda t, lang: T.let([t, split(t, lang)], fall_back))


def _windows(parts: list[str], size: int, min_size: int, overlap: int) -> list[str]:
    own, cur, out = [], "", []
    for s in parts:
        if cur and len(cur) + len(s) + 1 > size:
            if len(cur.strip()) >= min_size:
                out.append(cur.strip())
            own = [*own[-overlap:], s] if overlap else [s]
            cur = " ".join(own)
        else:
            own.append(s)
            cur = f"{cur} {s}" if cur else s
    return [*out, cur.strip()] if len(cur.strip()) >= min_size else out


def _long_split(parts: list[str], size: int, min_size: int) -> list[str]:
    cur, out = "", []
    for s in parts:
        if cur and len(cur) + len(s) + 1 > size:
            out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    return [*out, cur] if len(cur.strip()) >= min_size else out


def _folded(fold: Callable[[list[str]], list[str]], parts: Column) -> Column:
    @F.arrow_udf(_STRINGS)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else fold(r) for r in rows.to_pylist()], pa.list_(pa.string()))

    return run(parts)


def sentence_windows(parts: Column, size: int = SIZE, min_size: int = MIN_SIZE, overlap: int = 2) -> Column:
    """Contents of chunks of whole sentences; each begins with the last
    ``overlap`` sentences of the one before."""
    return _folded(lambda p: _windows(p, size, min_size, overlap), parts)


def long_split(parts: Column, size: int = SIZE, min_size: int = MIN_SIZE) -> Column:
    """Contents of chunks without overlap; only the last must reach ``min_size``."""
    return _folded(lambda p: _long_split(p, size, min_size), parts)


_CHUNK = "struct<content:string,chunk_id:string,chunk_index:int,language:string,content_type:string,word_count:int,char_count:int>"
_FIELDS = [("content", pa.string()), ("chunk_id", pa.string()), ("chunk_index", pa.int32()), ("language", pa.string()), ("content_type", pa.string()), ("word_count", pa.int32()), ("char_count", pa.int32())]


def _chunk(content: str, index: int, chunk_id: str, language: str, kind: str, raw: str | None = None) -> tuple:
    counted = content if raw is None else raw
    return content, chunk_id, index, language, kind, len(counted.split()), len(counted)


def _label(page: str | None, *rest) -> str:
    return "_".join(["page", *([] if page is None else [page]), *map(str, rest)])


def _chunked(chunks: Callable[..., list[tuple]], text: Column, page: Column, *more: Column) -> Column:
    """A column of arrays of chunks: ``chunks`` of each text, its page and ``more``
    values, in Arrow batches.  A null text has none."""

    @F.arrow_udf(f"array<{_CHUNK}>")
    def run(texts: pa.Array, pages: pa.Array, *rest: pa.Array) -> pa.Array:
        flat: list[list] = [[] for _ in _FIELDS]
        ends = [0]
        for t, *row in zip(texts, pages, *rest, strict=True):
            t = t.as_py()
            for made in chunks(t, *(x.as_py() for x in row)) if t is not None else ():
                for column, value in zip(flat, made, strict=True):
                    column.append(value)
            ends.append(len(flat[0]))
        columns = [pa.array(column, kind) for column, (_, kind) in zip(flat, _FIELDS, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in _FIELDS]))

    return run(text, page.cast("string"), *more)


def _split_chunks(text: str, page: str | None, base: int, language: str, kind: str, size: int, min_size: int) -> list[tuple]:
    parts = _long_split(plain.sentences(text, language), size, min_size)
    return [_chunk(c.strip(), base * 100 + k, _label(page, "para", base, "sub", k), language, kind, c) for k, c in enumerate(parts)]


def sentence_chunks(text: Column, page: Column, size: int = SIZE, min_size: int = MIN_SIZE, english: Callable[[Column], Column] | None = None) -> Column:
    """``english`` gives the sentences of English text (``boundaries.Boundaries``
    is one); without one the pattern does."""

    def chunks(t: str, page: str | None, own: list[str] | None = None) -> list[tuple]:
        language = plain.language(t)
        parts = own if own and language == "en" else plain.sentences(t, language)
        return [_chunk(c, k, _label(page, "sent", k), language, plain.content_type(c)) for k, c in enumerate(_windows(parts, size, min_size, 2))]

    return _chunked(chunks, text, page, *([] if english is None else [english(text)]))


def _sections(separator: str | None) -> re.Pattern:
    return re.compile(separator or f"\n{P.SPACE}*\n+")


def paragraph_chunks(text: Column, page: Column, size: int = SIZE, min_size: int = MIN_SIZE, separator: str | None = None) -> Column:
    between = _sections(separator)

    def chunks(t: str, page: str | None) -> list[tuple]:
        out = []
        for i, p in enumerate(x.strip() for x in between.split(t)):
            if len(p) >= min_size:
                language, kind = plain.language(p), plain.content_type(p)
                out += _split_chunks(p, page, i, language, kind, size, min_size) if len(p) > size else [_chunk(p, i, _label(page, "para", i), language, kind)]
        return out

    return _chunked(chunks, text, page)


def structure_chunks(
    text: Column, page: Column, size: int = SIZE, min_size: int = MIN_SIZE, separator: str | None = None, semantics: str = "intended"
) -> Column:
    """Sections merged by type.  ``observed`` keeps only the first part of an
    over-long section, as the behaviour to match does; ``intended`` keeps all."""
    between, prose = _sections(separator), ("paragraph", "definition")

    def create(content: str, page: str | None, index: int, kind: str, language: str) -> list[tuple]:
        if len(content.strip()) < min_size:
            return []
        if len(content) > size:
            split = _split_chunks(content, page, index, language, kind, size, min_size)
            return split[:1] if semantics == "observed" else split
        return [_chunk(content.strip(), index, _label(page, kind, index), language, kind, content)]

    def chunks(t: str, page: str | None) -> list[tuple]:
        out, cur, held, i = [], "", "paragraph", 0
        for s in (x.strip() for x in between.split(t)):
            if len(s) < min_size:
                continue
            kind, language = plain.content_type(s), plain.language(s)
            if kind in prose and not (cur and held != kind):
                cur, held = f"{cur}\n\n{s}" if cur else s, kind
            elif kind == "table" and cur and held in prose:
                cur = f"{cur}\n\nTable:\n{s}"
            elif kind in (*prose, "mcq", "answer_table"):
                made = create(cur, page, i, held, language) if cur else []
                out, i = out + made, i + bool(made)
                if kind in prose:
                    cur, held = s, kind
                else:
                    made = create(s, page, i, kind, language)
                    out, cur, i = out + made, "", i + bool(made)
            else:
                made = create(s, page, i, kind, language)
                out, i = out + made, i + bool(made)
        return out + create(cur, page, i, held, plain.language(cur)) if cur else out

    return _chunked(chunks, text, page)


def content_key(content: Column) -> Column:
    """Tells contents apart; case and edge space don't count."""
    return F.md5(T.strip(F.lower(content)))


def dedup_chunks(chunks: DataFrame, document: str = "doc_id", order: tuple[str, ...] = ("source_page", "seq"), min_size: int = MIN_SIZE) -> DataFrame:
    """Of equal contents (case and edge space ignored) in a document, the first;
    contents of under ``min_size`` characters are left out."""
    key = content_key(F.col("content"))
    w = Window.partitionBy(document, key).orderBy(*order)
    return chunks.where(F.col("char_count") >= min_size).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_chunks(chunks: Column, min_size: int = MIN_SIZE) -> Column:
    """The same within one array of chunks, in the row."""
    large = F.filter(chunks, lambda c: c["char_count"] >= min_size)

    def firsts(found: Column, keys: Column) -> Column:
        return F.filter(found, lambda c, i: F.array_position(keys, content_key(c["content"])) == i + 1)

    return T.let([large], lambda found: T.let([found, F.transform(found, lambda c: content_key(c["content"]))], firsts))


STRATEGIES = {
    "structure": structure_chunks,
    "paragraphs": paragraph_chunks,
    "sentences": sentence_chunks,
}


def chunk_pages(
    pages: DataFrame, strategy: str = "structure", size: int = SIZE, min_size: int = MIN_SIZE, semantics: str = "intended"
) -> DataFrame:
    """Cleaned, chunked and deduplicated pages (doc_id, page_number, text).

    An unknown strategy is the mixed one: paragraphs where the document has
    multiple-choice questions or the page says so, sentences elsewhere."""
    batches.bounded(pages.sparkSession)
    rows = pages.where(T.text_of("text") != "").select("doc_id", "page_number", T.clean_text("text").alias("text"))
    text, page = F.col("text"), F.col("page_number")
    if strategy == "structure":
        made = structure_chunks(text, page, size, min_size, semantics=semantics)
    elif strategy in STRATEGIES:
        made = STRATEGIES[strategy](text, page, size, min_size)
    else:
        # A document's flag is joined back: where the flagged documents are few,
        # by broadcast, and no text is shuffled for it.
        flags = pages.where(T.text_of("text").rlike(P.FLAGS["has_mcq"])).select(F.col("doc_id").alias("_doc"), F.lit(True).alias("_mcq")).distinct()
        rows = rows.join(flags, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
        rows = rows.withColumn("mcq", F.coalesce("_mcq", F.lit(False)) | F.contains(F.lower(text), F.lit("mcq")))
        # Each text is given to its own chunker alone.
        made = F.concat(paragraph_chunks(F.when(F.col("mcq"), text), page, size, min_size), sentence_chunks(F.when(~F.col("mcq"), text), page, size, min_size))
    exploded = rows.select("doc_id", "page_number", F.posexplode(made).alias("seq", "c"))
    exploded = exploded.select("doc_id", F.col("page_number").alias("source_page"), "seq", "c.*")
    return dedup_chunks(exploded, min_size=min_size)


def chunk_rows(
    pages: DataFrame, strategy: str = "structure", size: int = SIZE, min_size: int = MIN_SIZE, semantics: str = "intended"
) -> DataFrame:
    """``chunk_pages`` without the comparison of a document's pages with each
    other: nothing leaves its row, so it also runs on a stream.  The strategy is
    one of ``STRATEGIES``."""
    batches.bounded(pages.sparkSession)
    text, page = T.clean_text("text"), F.col("page_number")
    if strategy == "structure":
        made = structure_chunks(F.col("text"), page, size, min_size, semantics=semantics)
    else:
        made = STRATEGIES[strategy](F.col("text"), page, size, min_size)
    rows = pages.where(T.text_of("text") != "").select("doc_id", "page_number", text.alias("text"))
    exploded = rows.select("doc_id", F.col("page_number").alias("source_page"), F.posexplode(distinct_chunks(made, min_size)).alias("seq", "c"))
    return exploded.select("doc_id", "source_page", "seq", "c.*")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks and mean size by content type."""
    return chunks.groupBy("content_type").agg(F.count("*").alias("n_chunks"), F.avg("char_count").alias("avg_chars"))
