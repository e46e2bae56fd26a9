"""Sections of documents as Word files.

A document's lines are sorted and streamed into the parts of its file: a heading, a paragraph with a run for each line,
a page break behind each section. Neither a document nor a section is held as one value. A file is written under a name
of its own and moved to its place when it is whole, so a repeated task leaves one file. Many files are dealt to folders,
as a store may limit what one folder holds.

Defined results: a null heading or line is empty; characters that XML cannot hold become blanks; a section without lines
has its heading only; a document without rows has no file; repeated rows are lines of their own.
"""

from __future__ import annotations

import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators.keys import document_keys
from quirefold.sources.appended import opened
from quirefold.sources.shared import ship

_NOT_XML = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")
# What a Word file holds besides its text.
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
_BREAK = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'


def _run(text: str | None, more: str = "") -> str:
    return f'<w:r>{more}<w:t xml:space="preserve">{escape(_NOT_XML.sub(" ", text or ""))}</w:t></w:r>'


class _File:
    """A document that is being written."""

    def __init__(self, system: fs.FileSystem, where: str, name: str) -> None:
        self.system = system
        self.final, self.temporary = f"{where}/{name}.docx", f"{where}/_{name}-{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.temporary)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr("[Content_Types].xml", _TYPES)
        self.zip.writestr("_rels/.rels", _RELATIONS)
        self.body = self.zip.open("word/document.xml", "w", force_zip64=True)
        self.section, self.sections, self.lines, self.in_text = None, 0, 0, False
        self._write(_HEAD)

    def _write(self, text: str) -> None:
        self.body.write(text.encode())

    def add(self, section: tuple, heading: str | None, level: int | None, line_num: int | None, text: str | None) -> None:
        if section != self.section:
            self._end_section()
            self.section, self.sections = section, self.sections + 1
            self._write(f'<w:p><w:pPr><w:pStyle w:val="Heading{min(max(level or 1, 1), 9)}"/></w:pPr>{_run(heading)}</w:p>')
        if line_num is not None or text is not None:
            self._write("" if self.in_text else "<w:p>")
            self._write(_run(text, "<w:br/>" if self.in_text else ""))
            self.in_text, self.lines = True, self.lines + 1

    def _end_section(self) -> None:
        if self.section is not None:
            self._write(("</w:p>" if self.in_text else "") + _BREAK)
            self.in_text = False

    def close(self) -> None:
        self._end_section()
        self._write("</w:body></w:document>")
        self.body.close()
        self.zip.close()
        self.stream.close()
        self.system.move(self.temporary, self.final)


def write_sections(lines: DataFrame, folder: str, folders: int = 0) -> DataFrame:
    """Write lines (document's keys, ord: the section's place, heading, level, line_num, text) as a file for each document;
    (document's keys, path, n_sections, n_lines) of the files, which are written when that is read.

    A section without lines is a row without line_num and text. folders: the number of folders within it that files are
    dealt to, by their names; all are in `folder` itself if 0."""
    ship(lines.sparkSession)
    keys = document_keys(lines)
    columns = (*keys, "ord", "heading", "level", "line_num", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, file = None, None
        system, root = opened(folder)
        made: set[str] = set()

        def start(name: str) -> _File:
            where = f"{root}/{zlib.crc32(name.encode()) % folders}" if folders else root
            if where not in made:
                system.create_dir(where, recursive=True)
                made.add(where)
            return _File(system, where, name)

        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                own, (place, heading, *rest) = row[: len(keys)], row[len(keys) :]
                if file is None or own != document:
                    if file:
                        file.close()
                        done.append((*document, file.final, file.sections, file.lines))
                    document, file = own, start("cr_" + "_".join(map(str, own)))
                file.add((place, heading), heading, *rest)
            yield taken(done)
        if file:
            file.close()
            yield taken([(*document, file.final, file.sections, file.lines)])

    names = [*keys, "path", "n_sections", "n_lines"]

    def taken(rows: list[tuple]) -> pa.RecordBatch:
        arrow = [pa.int64() for _ in keys] + [pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)], names=names)

    whole = lines.select(*[F.col(k).cast("bigint").alias(k) for k in keys], *columns[len(keys) :])
    in_order = whole.repartition(*keys).sortWithinPartitions(*keys, "ord", "heading", F.col("line_num").asc_nulls_first(), "text")
    return in_order.mapInArrow(run, ", ".join([*(f"{k} bigint" for k in keys), "path string, n_sections bigint, n_lines bigint"]))
