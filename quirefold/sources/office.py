"""Office and image files as relations: spreadsheets, word-processor documents, page counts.

Files arrive by `binaryFile`, one row each, and are parsed where they are read, with the standard library only: both
office formats are zipped XML. A damaged file gives no rows (for page counts: null) rather than a failed job. Of files
that a table names, however many, the driver lists none: tasks open them by their paths.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.appended import opened
from quirefold.sources.shared import ship

# XML name spaces of the two formats.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

CELL_SCHEMA = "path string, row long, col long, value string"
WORD_SCHEMA = "path string, kind string, table_num long, row long, col long, text string"

#: Files that one task opens by their paths, and rows that it hands on together.
FILES_PER_TASK, ROWS_PER_BATCH = 2000, 4000


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n


def sheet_cells(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        for c in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{SHEET}c"):
            ref, kind, v = c.get("r"), c.get("t"), c.find(f"{SHEET}v")
            text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            if text is not None:
                yield int(re.search("[0-9]+", ref).group()), _column(ref), text


def word_parts(data: bytes) -> Iterator[tuple[str, int | None, int, int, str]]:
    """Paragraphs outside tables, and cells of tables, in document order: (kind, table, row, column, text)."""

    def text(e) -> str:
        return "".join(t.text or "" for t in e.iter(f"{WORD}t"))

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    paragraph = table = 0
    for e in body:
        if e.tag == f"{WORD}p":
            paragraph += 1
            yield "paragraph", None, paragraph, 1, text(e)
        elif e.tag == f"{WORD}tbl":
            table += 1
            for r, row in enumerate(e.iter(f"{WORD}tr")):
                for c, cell in enumerate(row.iter(f"{WORD}tc"), 1):
                    yield "cell", table, r, c, "\n".join(text(p) for p in cell.iter(f"{WORD}p"))


_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
_OBJECTS = re.compile(rb"<<[^<>]*?/Type\s*/ObjStm\b(?:[^<>]|<<[^<>]*>>)*>>\s*stream\r?\n")


def pdf_pages(data: bytes) -> int | None:
    """Page objects of a PDF, those in compressed object streams too; None if there are none or a stream cannot be read."""
    found = len(_PAGE.findall(data))
    for m in _OBJECTS.finditer(data):
        try:
            found += len(_PAGE.findall(zlib.decompressobj().decompress(data[m.end() :])))
        except zlib.error:
            return None
    return found or None


def page_count(name: str, data: bytes) -> int | None:
    """Pages of a PDF (its page objects) or TIFF (its directories); other files have one page."""
    ext = name.rsplit(".", 1)[-1].lower()
    if ext == "pdf":
        return pdf_pages(data)
    if ext in ("tif", "tiff"):
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None:
            return None
        at, n = struct.unpack(f"{order}I", data[4:8])[0], 0
        while at and at + 2 <= len(data) and n < len(data):
            n += 1
            end = at + 2 + 12 * struct.unpack(f"{order}H", data[at : at + 2])[0]
            at = struct.unpack(f"{order}I", data[end : end + 4])[0] if end + 4 <= len(data) else 0
        return n
    return 1


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(parse, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *x) for x in parse(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError):
                    continue
                frame = pd.DataFrame(rows, columns=columns)
                yield frame.astype({c: "Int64" for c in columns if c in ("row", "col", "table_num")})

    return run


def spreadsheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the first sheet of every spreadsheet, in long form."""
    return _files(spark, path, "*.xlsx").mapInPandas(_parsed(sheet_cells, ["path", "row", "col", "value"]), CELL_SCHEMA)


def spreadsheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of spreadsheets under the header in row 1, the named columns only."""
    cells = spreadsheet_cells(spark, path)
    heads = cells.filter("row = 1").select("path", "col", F.trim("value").alias("header")).filter(F.col("header").isin(*columns))
    body = cells.filter("row > 1").join(heads, ["path", "col"])
    return body.groupBy("path", "row").pivot("header", columns).agg(F.first("value")).drop("path", "row")


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs and table cells of word-processor documents, in long form."""
    return _files(spark, path, "*.docx").mapInPandas(_parsed(word_parts, ["path", "kind", "table_num", "row", "col", "text"]), WORD_SCHEMA)


def word_documents_of(files: DataFrame, folder: str) -> DataFrame:
    """The rows of `word_documents` of the files that a table names: `path` is a file's path in the folder's file system.
    The table is read twice, the first time for its number of rows. A file that is not there is an error."""
    ship(files.sparkSession)
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_PER_TASK))
    columns = ["path", "kind", "table_num", "row", "col", "text"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, rows = opened(folder)[0], []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path) as f:
                    data = f.read()
                try:
                    rows += [(path, *x) for x in word_parts(data)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError):
                    continue
                if len(rows) >= ROWS_PER_BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return files.select("path").repartition(tasks, "path").mapInArrow(run, WORD_SCHEMA)


def page_counts(spark: SparkSession, path: str, readable: tuple[str, ...] = ("pdf", "tif", "tiff")) -> DataFrame:
    """(path, extension, pages, readable) of every file below a folder."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [page_count(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "pages": pd.array(pages, dtype="Int64")})

    counted = _files(spark, path, "*").mapInPandas(count, "path string, pages long")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return counted.select("path", extension.alias("extension"), "pages", extension.isin(*readable).alias("readable"))
