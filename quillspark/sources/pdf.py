"""PDF pages, page by page: large files divided among tasks, failures contained.

Files are read by Spark's binary reader, so paths may be remote.  Each file's
pages are counted where it is read; its ranges of ``pages_per_task`` pages are
then dealt to tasks, a file that has one range once.  A page is read by the first
reader that manages it, so one that a reader fails on doesn't cost the others.
What no reader manages is a row with its ``error``, of the page, or of the file
(page 0) if none can open it.  A scanner that fails leaves the page its text.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents

_DDL = "path string, page_number int, text string, extraction_method string, grids array<array<array<string>>>, bbox array<double>, error string"
_COLUMNS = ["path", "page_number", "text", "extraction_method", "grids", "bbox", "error"]


class PageReader(Protocol):
    """Reads a file page by page; must be picklable."""

    name: str

    def open(self, data: bytes) -> Any: ...

    def count(self, opened: Any) -> int: ...

    def page(self, opened: Any, number: int) -> tuple[str, list | None, list[float] | None]:
        """Text, cells of the tables, and box of a page, from 1."""
        ...


class LayoutReader:
    name = "pdfplumber"

    def open(self, data: bytes) -> Any:
        import pdfplumber

        return pdfplumber.open(io.BytesIO(data))

    def count(self, opened: Any) -> int:
        return len(opened.pages)

    def page(self, opened: Any, number: int) -> tuple[str, list | None, list[float] | None]:
        page = opened.pages[number - 1]
        text = page.extract_text(x_tolerance=3, y_tolerance=3, layout=True, x_density=7.25, y_density=13) or ""
        found = text, page.extract_tables() if text else [], [float(x) for x in page.bbox]
        page.close()  # what it has cached would grow with the file
        return found


class PlainReader:
    name = "pypdf2"

    def open(self, data: bytes) -> Any:
        from pypdf import PdfReader

        return PdfReader(io.BytesIO(data))

    def count(self, opened: Any) -> int:
        return len(opened.pages)

    def page(self, opened: Any, number: int) -> tuple[str, list | None, list[float] | None]:
        return opened.pages[number - 1].extract_text() or "", None, None


READERS = (LayoutReader(), PlainReader())


class _File:
    """One file, with each reader's handle opened when it is first needed."""

    def __init__(self, data: bytes, readers: tuple[PageReader, ...]):
        self.data, self.readers, self.handles = data, readers, {}

    def _handle(self, i: int) -> Any:
        if i not in self.handles:
            try:
                self.handles[i] = self.readers[i].open(self.data)
            except Exception as error:  # a broken file, or a library that isn't there
                self.handles[i] = error
        if isinstance(self.handles[i], Exception):
            raise self.handles[i]
        return self.handles[i]

    def first(self, work: Callable[[PageReader, Any], Any]) -> tuple[str | None, Any, str | None]:
        """Name and result of the first reader that manages, or else the errors."""
        errors = []
        for i, reader in enumerate(self.readers):
            try:
                return reader.name, work(reader, self._handle(i)), None
            except Exception as error:  # whatever a library raises for a broken page
                errors.append(f"{reader.name}: {type(error).__name__}: {error}")
        return None, None, "; ".join(errors)


def read_pages(
    spark: SparkSession,
    path: str,
    readers: tuple[PageReader, ...] = READERS,
    scanner: Callable[[bytes, int], str] | None = None,
    least: int = 50,
    pages_per_task: int = 50,
) -> DataFrame:
    """path, page_number, text, tables, bbox, extraction_method, error of every
    PDF under ``path``.  Pages without text are left out, unless they have an
    error.  Those of under ``least`` characters go to ``scanner`` (the file, the
    page number), whose text is taken if it is longer."""

    @F.pandas_udf("struct<n:int,error:string>")
    def counted(contents: pd.Series) -> pd.DataFrame:
        found = [_File(bytes(c), readers).first(lambda r, opened: r.count(opened)) for c in contents]
        return pd.DataFrame({"n": [n or 0 for _, n, _ in found], "error": [e for _, _, e in found]})

    def scanned(data: bytes, number: int, text: str) -> str | None:
        if scanner is None or len(text.strip()) >= least:
            return None
        try:
            found = scanner(data, number) or ""
        except Exception:  # the page keeps what it has
            return None
        return found if len(found.strip()) > len(text.strip()) else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content, first, last, broken in batch.itertuples(index=False):
                if broken is not None:
                    yield pd.DataFrame([(path_, 0, "", "", None, None, broken)], columns=_COLUMNS)
                    continue
                data, rows = bytes(content), []
                file = _File(data, readers)
                for number in range(first, last + 1):
                    name, page, error = file.first(lambda r, opened, number=number: r.page(opened, number))
                    text, grids, bbox = page or ("", None, None)
                    if (better := scanned(data, number, text)) is not None:
                        text, name = better, "ocr_fallback"
                    if text.strip() or error:
                        rows.append((path_, number, text, name or "", grids, bbox, error))
                if rows:
                    yield pd.DataFrame(rows, columns=_COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    # As many tasks as read the files, and no fewer than cores: pages cost time,
    # so tasks aren't merged by their bytes.
    tasks = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions())
    files = files.withColumn("c", counted.asNondeterministic()("content"))
    step = F.lit(pages_per_task)
    ranges = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("c.n") / step) - 1, F.lit(0))), lambda i: F.struct((i * step + 1).cast("int").alias("first"), F.least((i + 1) * step, F.col("c.n")).cast("int").alias("last")))
    dealt = files.select("path", "content", F.col("c.error").alias("broken"), F.explode(ranges).alias("r"))
    dealt = dealt.select("path", "content", "r.first", "r.last", "broken").repartition(tasks, "path", "first")
    pages = dealt.mapInPandas(read, _DDL)
    tables = F.coalesce(documents.flatten_tables(F.col("grids")), F.lit(""))
    return pages.select("path", "page_number", "text", tables.alias("tables"), "bbox", "extraction_method", "error")
