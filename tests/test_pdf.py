"""PDF pages in ranges, with fake readers: what fails, and where it is read."""

import os

import pytest

from quillspark.sources import files, pdf


class Fake:
    """Files are lines; a line ``!name`` is a page that the reader of that name
    fails on, and ``?name`` the first line of a file that it can't open."""

    def __init__(self, name, log=None):
        self.name, self.log = name, log

    def open(self, data):
        lines = data.decode().split("\n")
        if lines[0] == f"?{self.name}" or lines[0] == "?all":
            raise ValueError("can't open")
        return lines

    def count(self, opened):
        return len(opened)

    def page(self, opened, number):
        if self.log:
            with open(f"{self.log}/{os.getpid()}-{number}", "w"):
                pass
        line = opened[number - 1]
        if line in (f"!{self.name}", "!all"):
            raise KeyError(line)
        return line, [[["a", None], ["b", "c"]]] if line.startswith("table") else None, [0.0, 1.0]


LONG = "a page with more than fifty characters on it, so that nobody scans it"


def rows(df):
    return sorted((os.path.basename(r["path"]), r["page_number"], r["text"], r["extraction_method"], (r["error"] or "")[:12]) for r in df.collect())


@pytest.mark.parametrize("size", [1, 2, 50])
def test_failures_are_contained(spark, tmp_path, size):
    (tmp_path / "a.pdf").write_text(f"{LONG}\n!one\n!all\n\ntable {LONG}")
    (tmp_path / "b.pdf").write_text(f"?one\n{LONG}")
    (tmp_path / "c.pdf").write_text("?all\nx")
    (tmp_path / "d.txt").write_text("no pdf")

    def scanner(data, page):
        if page == 2:
            raise RuntimeError("no scanner")
        return f"scanned page {page} of {len(data)} bytes"

    got = pdf.read_pages(spark, str(tmp_path), (Fake("one"), Fake("two")), pages_per_task=size)
    assert rows(got) == [
        ("a.pdf", 1, LONG, "one", ""),
        ("a.pdf", 2, "!one", "two", ""),
        ("a.pdf", 3, "", "", "one: KeyErro"),
        ("a.pdf", 5, f"table {LONG}", "one", ""),
        ("b.pdf", 1, "?one", "two", ""),
        ("b.pdf", 2, LONG, "two", ""),
        ("c.pdf", 0, "", "", "one: ValueEr"),
    ]
    assert [r["tables"] for r in got.where("page_number = 5").collect()] == ["\nTable 1:\na | \nb | c\n\n"]
    size_a = os.path.getsize(tmp_path / "a.pdf")
    got = rows(pdf.read_pages(spark, str(tmp_path / "a.pdf"), (Fake("one"), Fake("two")), scanner, pages_per_task=size))
    assert got[1] == ("a.pdf", 2, "!one", "two", "")  # the scanner failed
    assert got[2] == ("a.pdf", 3, f"scanned page 3 of {size_a} bytes", "ocr_fallback", "one: KeyErro")
    assert got[3] == ("a.pdf", 4, f"scanned page 4 of {size_a} bytes", "ocr_fallback", "")


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "large.pdf").write_text("\n".join(f"{LONG} {i}" for i in range(200)))
    got = pdf.read_pages(spark, str(tmp_path), (Fake("one", str(tmp_path / "log")),), pages_per_task=10)
    assert sorted(r["page_number"] for r in got.collect()) == list(range(1, 201))
    names = [x.split("-") for x in os.listdir(tmp_path / "log")]
    assert len(names) == 200 and len({pid for pid, _ in names}) > 1  # each page once, by several workers


def test_a_scanner_that_fails_in_a_whole_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")

    def scanner(data, page):
        raise RuntimeError

    got = files.read_pdf_pages(spark, str(tmp_path), lambda b: [(1, "short", "fake")], scanner).collect()
    assert [(r["text"], r["extraction_method"]) for r in got] == [("short", "fake")]
