"""Page and document assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def assemble(pages: DataFrame) -> DataFrame:
    """One row a document: its full text and statistics, pages in order.  A
    document's pages are gathered in one row, so a row holds one document."""
    text = T.text_of("text")
    ordered = F.array_sort(F.collect_list(F.struct("page_number", text.alias("text"))))
    parts = F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: t != "")
    out = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.array_join(parts, "\n\n").alias("full_text"))
    return out.select("doc_id", "full_text", *(c.alias(n) for n, c in statistics(F.col("full_text"), F.col("total_pages")).items()))


def statistics(text: Column, pages: Column) -> dict[str, Column]:
    chars = F.length(text)
    return {
        "total_pages": pages.cast("int"),
        "total_characters": chars,
        "total_words": F.size(T.words(text)),
        "avg_chars_per_page": F.floor(chars / F.greatest(pages, F.lit(1))).cast("int"),
    }


def flatten_tables(tables: Column) -> Column:
    """Text of a page's cell grids: a numbered heading for each grid that has
    rows, cells joined by bars, null cells empty."""

    def row(cells: Column) -> Column:
        joined = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")
        return F.when(F.coalesce(F.size(cells), F.lit(0)) > 0, F.concat(joined, F.lit("\n"))).otherwise("")

    def grid(rows: Column, i: Column) -> Column:
        body = F.array_join(F.transform(rows, row), "")
        head = F.concat(F.lit("\nTable "), (i + 1).cast("string"), F.lit(":\n"))
        return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.concat(head, body, F.lit("\n"))).otherwise("")

    return F.array_join(F.transform(tables, grid), "")


def with_ocr_fallback(pages: DataFrame, ocr: Column, least: int = 50) -> DataFrame:
    """Replace the text of pages below ``least`` characters by ``ocr``, where
    that is longer."""
    short = F.length(T.strip(T.text_of("text"))) < least
    better = short & (F.length(T.strip(F.coalesce(ocr, F.lit("")))) > F.length(T.strip(T.text_of("text"))))
    return pages.withColumns(
        {
            "extraction_method": F.when(better, "ocr_fallback").otherwise(F.col("extraction_method")),
            "text": F.when(better, ocr).otherwise(F.col("text")),
        }
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each text (case and edge space ignored).  A partial
    aggregate by digest, so copies are combined before the shuffle."""
    key = F.sha2(T.strip(F.lower(T.text_of(text_col))), 256)
    return docs.groupBy(key.alias("text_key")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))
