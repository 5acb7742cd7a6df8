"""Reading pages from files, and writing chunks, pages and evaluation runs."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents
from ..schemas import PAGE

_PAGE_DDL = "path string, page_number int, text string, extraction_method string, grids array<array<array<string>>>, bbox array<double>"
#: Page number, text, method, and where the reader has them the tables' cells and
#: the page's box.
Page = tuple


def _layout_pages(data: bytes) -> list[Page]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        texts = [(p, p.extract_text(x_tolerance=3, y_tolerance=3, layout=True, x_density=7.25, y_density=13) or "") for p in pdf.pages]
        return [(i + 1, text, "pdfplumber", p.extract_tables() if text else [], [float(x) for x in p.bbox]) for i, (p, text) in enumerate(texts)]


def _plain_pages(data: bytes) -> list[Page]:
    from pypdf import PdfReader

    return [(i + 1, p.extract_text() or "", "pypdf2") for i, p in enumerate(PdfReader(io.BytesIO(data)).pages)]


def first_that_reads(data: bytes, readers: tuple[Callable[[bytes], list[Page]], ...]) -> list[Page]:
    """Pages with text, by the first reader that doesn't fail, whatever the
    others raise; an error if all do."""
    for i, reader in enumerate(readers):
        try:
            return [p for p in reader(data) if p[1].strip()]
        except Exception:  # a broken file, or a library that isn't there
            if i == len(readers) - 1:
                raise
    return []


READERS = (_layout_pages, _plain_pages)


def read_pdf_pages(
    spark: SparkSession,
    path: str,
    readers: tuple[Callable[[bytes], list[Page]], ...] | Callable[[bytes], list[Page]] = READERS,
    scanner: Callable[[bytes, int], str] | None = None,
    least: int = 50,
) -> DataFrame:
    """path, page_number, text, tables, bbox, extraction_method of every PDF under
    ``path``.
    Pages of under ``least`` characters are given to ``scanner`` (the file, the
    page number), whose text is taken if it is longer; if it fails, the page's own
    stays.  A file is read whole by one task; ``pdf.read_pages`` divides it."""
    readers = readers if isinstance(readers, tuple) else (readers,)

    def scanned(data: bytes, page: Page) -> Page:
        if scanner is None or len(page[1].strip()) >= least:
            return page
        try:
            found = scanner(data, page[0]) or ""
        except Exception:  # whatever a plugged-in scanner raises; the page keeps what it has
            return page
        return (page[0], found, "ocr_fallback", *page[3:]) if len(found.strip()) > len(page[1].strip()) else page

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                rows = [(path_, *scanned(data, p), None, None)[:6] for p in first_that_reads(data, readers)]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "extraction_method", "grids", "bbox"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    pages = files.select("path", "content").mapInPandas(run, _PAGE_DDL)
    tables = F.coalesce(documents.flatten_tables(F.col("grids")), F.lit(""))
    return pages.select("path", "page_number", "text", tables.alias("tables"), "bbox", "extraction_method")


def read_text_pages(spark: SparkSession, path: str, separator: str = "\f") -> DataFrame:
    """Pages of text files, separated by form feeds."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", F.posexplode(F.split("value", separator)).alias("n", "text")).select(
        "path", (F.col("n") + 1).alias("page_number"), "text", F.lit("text").alias("extraction_method")
    )


def html_pages(pages: DataFrame) -> DataFrame:
    """Visible text of HTML pages (page_id, url, html), one page a document."""
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.lit(1).alias("page_number"),
        T.strip_tags("html").alias("text"),
        F.lit("").alias("tables"),
        F.lit(None).cast("array<double>").alias("bbox"),
        F.lit("html").alias("extraction_method"),
    ).to(PAGE)


def chunk_markdown() -> Column:
    head = F.concat(F.lit("## "), F.col("chunk_id"), F.lit(" ("), F.col("content_type"), F.lit(", "), F.col("language"), F.lit(")"))
    return F.concat(head, F.lit("\n\n"), F.col("content"), F.lit("\n\n---\n"))


def write_chunks_markdown(chunks: DataFrame, path: str) -> None:
    chunks.select(chunk_markdown().alias("value")).write.mode("overwrite").text(path)


def write_pages_text(pages: DataFrame, path: str) -> None:
    pages.select("text").write.mode("overwrite").text(path)


def write_evaluation(evaluated: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows and summary as JSON, each in a folder of its own: the rows are many
    and stay distributed."""
    evaluated.write.mode("overwrite").json(f"{path}/detailed_results")
    summary.withColumn("evaluated_at", F.current_timestamp().cast("string")).write.mode("overwrite").json(f"{path}/summary")


def report(summary: DataFrame) -> Column | str:
    """The summary as text, one line a figure."""
    row = summary.first().asDict()
    return "\n".join(f"{k}: {v}" for k, v in row.items())
